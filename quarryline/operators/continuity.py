"""State continuity: commitments, transitions, classes and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .policies import BANDS, DRIFT, LATER_ONLY, NEIGHBORHOOD, RISK, Policy

#: The invariants of a transition, in order; the last two need a state before.
INVARIANTS = ["commitment_bound", "witness_bound", "residual_bounded", "chart_supported", "prior_commitment_present", "neighborhood_preserved"]
STATE = ["chart", "residual", "cell", "commitment", "witness", "type"]


def committed(payload: list[str]) -> Column:
    """Commitment of a state: SHA-256 of its fields in a stated order."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in payload]), 256)


def residual_class(chart: Column, residual: Column) -> Column:
    """stable, boundary, novel or degraded, by the bands of the chart."""
    limit = lambda i: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c, b in BANDS.items() for x in (c, b[i])]), F.coalesce(chart, F.lit("default"))), F.lit(BANDS["default"][i]))
    return F.when(residual <= limit(0), "stable").when(residual <= limit(1), "boundary").when(residual <= limit(2), "novel").otherwise("degraded")


def transitions(states: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each state against the one before of its key: residual change, invariants and continuity class.

    States have the columns ``STATE``: chart, residual, cell (an array, or null), commitment, witness, type.
    """
    w = W.partitionBy(*keys).orderBy(order)
    rows = states.withColumn("before", F.lag(F.struct(*STATE)).over(w)).withColumn("band", residual_class(F.col("chart"), F.col("residual")))
    had, old = F.col("before").isNotNull(), lambda c: F.col(f"before.{c}")
    delta = F.when(had, F.round(F.coalesce("residual", F.lit(0.0)) - F.coalesce(old("residual"), F.lit(0.0)), 8))
    same_chart = old("chart").eqNullSafe(F.col("chart"))
    apart = F.aggregate(F.zip_with("cell", old("cell"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    loose = (F.col("chart") == "generic") | (old("chart") == "generic") | (F.col("type") == "space.state") | (old("type") == "space.state")
    near = ~same_chart | F.coalesce(loose, F.lit(False)) | apart.isNull() | (apart <= NEIGHBORHOOD)
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    checked = F.array(
        F.struct(F.lit(INVARIANTS[0]).alias("name"), filled(F.col("commitment")).alias("ok")), F.struct(F.lit(INVARIANTS[1]).alias("name"), filled(F.col("witness")).alias("ok")),
        F.struct(F.lit(INVARIANTS[2]).alias("name"), (F.col("band") != "degraded").alias("ok")), F.struct(F.lit(INVARIANTS[3]).alias("name"), filled(F.col("chart")).alias("ok")),
        F.when(had, F.struct(F.lit(INVARIANTS[4]).alias("name"), filled(old("commitment")).alias("ok"))), F.when(had, F.struct(F.lit(INVARIANTS[5]).alias("name"), near.alias("ok"))),
    )
    rows = rows.withColumn("delta", delta).withColumn("invariants", F.filter(checked, lambda i: i.isNotNull()))
    drift = (F.coalesce("delta", F.lit(0.0)) > DRIFT) | (F.col("band") != "stable")
    kind = F.when(~had, "INITIALIZED").when(~same_chart, "BOUNDARY_CROSSING").when(F.exists("invariants", lambda i: ~i["ok"]), "CONTINUITY_FAIL").when(drift, "PASS_WITH_DRIFT").otherwise("PASS")
    return rows.withColumn("class", kind)


def _violations(p: Policy) -> Column:
    first = (F.col("class") == "INITIALIZED") | ~F.coalesce(F.col("before.commitment") != "", F.lit(False))
    ok = F.map_from_entries("invariants")
    found = []

    def add(kind: str, name: str, wrong: Column) -> None:
        late = ~first if name in LATER_ONLY else F.lit(True)
        found.append(F.when(late & wrong, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"))))

    for name in p.required:
        add("missing_invariant", name, ~F.map_contains_key(ok, name))
    for name in p.failing:
        add("failed_invariant", name, F.coalesce(~F.element_at(ok, name), F.lit(False)))
    witness = {"next_state_witness": F.col("witness"), "prior_state_witness": F.col("before.witness")}
    for name in p.witnesses:
        add("missing_witness", name, ~F.coalesce(witness.get(name, F.lit("")) != "", F.lit(False)))
    add("residual_delta_exceeded", "", F.coalesce(F.col("delta") > p.max_delta, F.lit(False)))
    add("boundary_crossing_disallowed", "", (F.col("class") == "BOUNDARY_CROSSING") & F.lit(not p.crossing))
    moves = F.lit(False)
    for chart, to in p.moves.items():
        if to:
            moves = moves | ((F.col("before.chart") == chart) & (F.col("before.chart") != F.col("chart")) & ~F.col("chart").isin(to))
    add("chart_transition_disallowed", "", F.coalesce(moves, F.lit(False)))
    return F.filter(F.array(*found), lambda v: v.isNotNull())


def judged(moves: DataFrame, policies: list[Policy]) -> DataFrame:
    """Each transition under each policy: violations, verdict and risk.  The policies are part of the plan, so nothing is joined."""
    each = F.array(*[F.struct(F.lit(p.id).alias("policy"), _violations(p).alias("violations")) for p in policies])
    out = moves.withColumn("judged", F.explode(each)).select(*moves.columns, "judged.policy", "judged.violations")
    passed = F.size("violations") == 0
    verdict = F.when(~passed, "CONTINUITY_FAIL").when(F.col("class").isin("PASS_WITH_DRIFT", "BOUNDARY_CROSSING", "INITIALIZED"), F.col("class")).otherwise("PASS")
    out = out.withColumn("verdict", verdict)
    kinds = F.transform("violations", lambda v: v["kind"])
    risk = F.lit(0.0)
    for kind, weight in RISK.items():
        risk = risk + F.when(F.array_contains(kinds, kind), weight).otherwise(0.0)
    risk = F.when(F.col("class") == "PASS_WITH_DRIFT", F.greatest(risk, F.lit(0.25))).when(F.col("class") == "BOUNDARY_CROSSING", F.greatest(risk, F.lit(0.3))).otherwise(risk)
    risk = F.when(F.col("verdict").isin("PASS", "INITIALIZED"), F.least(risk, F.lit(0.1))).otherwise(risk)
    return out.withColumn("risk", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk)), 8))


def triggered(violations: str = "violations") -> Column:
    """The conditions that failed, as a log names them: invariants first, then what is missing, then the rest."""
    of = lambda kind, named: F.transform(F.filter(violations, lambda v: v["kind"] == kind), named)
    return F.concat(
        of("failed_invariant", lambda v: v["name"]), of("missing_invariant", lambda v: F.concat(F.lit("missing_invariant:"), v["name"])), of("missing_witness", lambda v: F.concat(F.lit("missing_witness:"), v["name"])),
        *[of(k, lambda v: v["kind"]) for k in ("residual_delta_exceeded", "boundary_crossing_disallowed", "chart_transition_disallowed")],
    )


def view(level: str, keys: dict[str, Column]) -> list[Column]:
    """Redaction: public drops values and salts, witness keeps hashes, commitment only the commitment, private all."""
    shown = {"public": ["key", "set_at"], "witness": ["key", "set_at", "witness_hash"], "commitment": ["state_commitment"], "private": list(keys)}[level]
    return [keys[k].alias(k) for k in shown]


def latest(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last event of each key of an event-sourced map."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def euler(state: Column, velocity: Column, force: Column, mass: Column, dt: float, steps: int) -> Column:
    """Position and velocity after ``steps`` of explicit Euler integration."""
    start = F.struct(state.cast("double").alias("x"), velocity.cast("double").alias("v"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.struct((s["x"] + s["v"] * dt).alias("x"), (s["v"] + force / mass * dt).alias("v")))

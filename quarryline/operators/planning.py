"""Scoring, routing, reconciliation, sessions and dependency plans."""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.formulas import to_fixed


def route_score(cost: Column, latency: Column, quality: Column, cloud: Column, budget: float, max_latency: float, min_quality: float) -> tuple[Column, Column]:
    """Eligibility under budget and service levels, and the score to two places: 50 for cost, 30 for speed, 10 a point of quality, 5 for local offers, eligible or not."""
    ok = (latency <= max_latency) & (quality >= min_quality) & (cost <= budget)
    score = (F.lit(budget) - cost) / budget * 50 + F.greatest(F.lit(0.0), (F.lit(max_latency) - latency) / max_latency * 30) + (quality - min_quality) * 10
    return ok, to_fixed(F.when(ok, score).otherwise(F.lit(0.0)) + F.when(cloud, 0.0).otherwise(5.0), 2)


def routed(offers: DataFrame, group: str, offer: str) -> DataFrame:
    """The best eligible offer of each group, else the best of all; ties go to the smallest offer."""
    some = F.max("eligible")
    out = offers.groupBy(group).agg(F.max(F.struct("eligible", "score", (-F.col(offer)).alias("o"))).alias("b"), some.alias("any_eligible"))
    return out.select(group, (-F.col("b.o")).alias(offer), F.col("b.score").alias("score"), "any_eligible")


def marketplace(catalog: DataFrame, tasks: list[str], budget: float, disk: float, quality: float, key: str, n: int) -> DataFrame:
    """The best ``n`` of a catalog (features, size, sae, memory_pack, family) by an additive score.

    20 a matching feature, 30 within budget, 20 within disk, 15 and 10 for two capabilities, and 5 for
    general models where high quality is asked for.
    """
    wanted = F.array(*map(F.lit, tasks))
    matched = F.size(F.filter("features", lambda f: F.exists(wanted, lambda t: F.contains(f, t) | F.contains(t, f))))
    worth = lambda c, v: F.when(c, v).otherwise(0)
    score = matched * 20 + worth(F.col("size") <= budget, 30) + worth(F.col("size") <= disk, 20) + worth(F.col("sae"), 15) + worth(F.col("memory_pack"), 10) + worth(F.lit(quality >= 0.9) & (F.col("family") == "general"), 5)
    return catalog.withColumn("score", score.cast("int")).orderBy(F.desc("score"), key).limit(n)


def reconciled(source: DataFrame, installed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison: missing, extra, identical, upgrade (blank to value) or conflict."""
    a = source.select(*keys, F.struct(*values).alias("s"))
    b = installed.select(*keys, F.struct(*values).alias("i"))
    both = a.join(b, keys, "full")
    blank = lambda c: c.isNull() | (c.cast("string") == "")
    same = F.lit(True)
    upgrade = F.lit(True)
    for v in values:
        equal = F.col(f"s.{v}").eqNullSafe(F.col(f"i.{v}"))
        same = same & equal
        upgrade = upgrade & (equal | blank(F.col(f"i.{v}")))
    state = F.when(F.col("i").isNull(), "missing").when(F.col("s").isNull(), "extra").when(same, "identical").when(upgrade, "upgrade").otherwise("conflict")
    return both.select(*keys, state.alias("state"))


def session_diff(a: DataFrame, b: DataFrame, step: str) -> DataFrame:
    """Steps by hash: common, only in the first, only in the second."""
    one = a.select(step).distinct().withColumn("a", F.lit(True))
    two = b.select(step).distinct().withColumn("b", F.lit(True))
    return one.join(two, step, "full").select(step, F.when(F.col("a") & F.col("b"), "common").when(F.col("a"), "only_a").otherwise("only_b").alias("side"))


def rebased(session: DataFrame, onto: DataFrame, key: str, step: str, order: str) -> DataFrame:
    """By key: ``onto``'s steps, then the session's own that ``onto`` lacks, renumbered."""
    own = session.join(onto.select(key, step).distinct(), [key, step], "left_anti")
    both = onto.select(key, F.lit(0).alias("part"), order, step).unionByName(own.select(key, F.lit(1).alias("part"), order, step))
    return both.withColumn("new_order", F.row_number().over(W.partitionBy(key).orderBy("part", order, step)))


def depths(rows: DataFrame) -> DataFrame:
    """(step, depth): how many dependencies lie before each step of a forest (step, dep); the levels are the only rounds."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # every row once, so the table bounds the rows
    roots = rows.join(rows.select(F.col("step").alias("dep")), "dep", "left_anti").select("step")
    recursion = """WITH RECURSIVE t(step, depth) AS (SELECT step, 0 FROM {roots} UNION ALL SELECT d.step, t.depth + 1 FROM {rows} d JOIN t ON d.dep = t.step) SELECT step, depth FROM t"""
    return spark.sql(recursion, roots=roots, rows=rows)


def planned(steps: dict[str, list[str]]) -> tuple[list[str], list[str]]:
    """Topological order of a plan and its errors (cycles, unknown dependencies)."""
    errors = [f"unknown dependency {d} of {s}" for s, deps in steps.items() for d in deps if d not in steps]
    try:
        return list(TopologicalSorter({s: [d for d in deps if d in steps] for s, deps in steps.items()}).static_order()), errors
    except CycleError as e:
        return [], [*errors, "cycle: " + " -> ".join(e.args[1])]


def looked_up(rows: DataFrame, table: DataFrame, key: str, fallback: str) -> DataFrame:
    """Left lookup in a table of commands, with a state for the unlisted; the planner broadcasts the table if it is small."""
    return rows.join(table, key, "left").withColumn("state", F.coalesce("state", F.lit(fallback)))


def bundle(requested: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Requested files against found ones; complete only if all exist."""
    at = requested.join(found.select(name).distinct().withColumn("__there", F.lit(True)), name, "left")
    return at.agg(F.count("*").alias("requested"), F.count("__there").alias("present"), F.coalesce(F.every(F.col("__there").isNotNull()), F.lit(True)).alias("complete"))


def within_budget(regions: DataFrame, group: str, order: str, size: str, budget: float) -> DataFrame:
    """Regions taken in order while their running size stays in the budget."""
    total = F.sum(size).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return regions.withColumn("running", total).filter(F.col("running") <= budget)


def gaussian_sigma(sensitivity: float, epsilon: Column, delta: float) -> Column:
    return sensitivity * F.sqrt(2 * F.log(F.lit(1.25 / delta))) / epsilon


def fidelity(gap: Column) -> Column:
    return F.when(gap > 0, F.greatest(F.lit(0.70), 0.98 - 0.06 * gap)).otherwise(0.98)

"""Rules over records: searches, checks, gates, plans for hydration and packing, and route rules from data."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fields that a failing transition must state.
FAIL_FIELDS = ["failed_invariants", "missing_invariants", "missing_witnesses", "residual_delta_exceeded", "boundary_crossing_disallowed", "chart_transition_disallowed"]

#: Marks in a region's name, and the sizes below which an unmarked region is warm or hot.
COLD_MARKS = ["debug", "proof", "audit", "ledger", "docs", "readme", "checksum"]
HOT_MARKS = ["manifest", "header", "config", "tokenizer", "token", "routing", "vocab", "bpe", "spm", "embed", "embed_tokens"]
SMALL_MARKS = ["sae", "fpqx", "adapter", "lora", "side-car", "small", "gate", "router"]
WARM_BYTES, HOT_BYTES = 64 << 20, 1 << 30

#: What a task needs in a memory pack.
MEMORY_PROFILES = {
    "support-classify": (512, 2048, 4, [8, 16, 22]),
    "summarize": (256, 1024, 2, [12, 22]),
    "rag": (1024, 4096, 6, [8, 16, 24]),
    "brief": (128, 512, 2, [12]),
    "classify": (256, 1024, 3, [8, 16]),
    "default": (256, 1024, 2, [12, 22]),
}


def entity_matches(artifacts: DataFrame, query: str, name: str, id_: str) -> DataFrame:
    """Artifacts whose name contains the query or whose id begins with it."""
    return artifacts.filter(F.contains(F.coalesce(name, F.lit("")), F.lit(query)) | F.startswith(F.coalesce(id_, F.lit("")), F.lit(query)))


def sanitized_ref(ref: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(ref, F.lit("")), "[^a-zA-Z0-9._-]", "-")
    return F.when(clean == "", "artifact").otherwise(clean)


def versioned(ref: Column) -> tuple[Column, Column]:
    """Base and version of a reference, the shortest base before a dash or @ and a v with a digit; else the reference itself and null."""
    pattern = r"^(.+?)[-@](v[0-9][A-Za-z0-9_.]*)$"
    hit = ref.rlike(pattern)
    return F.when(hit, F.regexp_extract(ref, pattern, 1)).otherwise(ref), F.when(hit, F.regexp_extract(ref, pattern, 2))


def fail_vector_issues(triggered: Column, fields: Column, risk: Column) -> Column:
    """What a failing node lacks: its conditions (an array), its condition fields (names, or null), its risk."""
    lacking = F.transform(F.filter(F.array(*map(F.lit, FAIL_FIELDS)), lambda f: ~F.array_contains(fields, f)), lambda f: F.concat(F.lit("missing_fail_condition_field:"), f))
    none = F.expr("cast(array() as array<string>)")
    one = lambda c, name: F.when(c, F.array(F.lit(name))).otherwise(none)
    listed = F.when(fields.isNull(), F.array(F.lit("missing_fail_condition_fields"))).otherwise(lacking)
    return F.concat(one(F.coalesce(F.size(triggered), F.lit(0)) <= 0, "missing_triggered_fail_conditions"), listed, one(risk.isNull() | F.isnan(risk), "missing_risk_score"))


def release_gate(proof: Column) -> tuple[Column, Column]:
    """Checks of a proof document (JSON text) and the verdict; text that isn't JSON fails without checks."""
    doc = F.try_parse_json(proof)
    has = lambda f: F.coalesce(F.try_variant_get(doc, f"$.{f}", "string") != "", F.lit(False))
    identity = has("artifact_id") | has("proof_root") | has("merkle_root") | has("hash")
    schema = has("schema_version")
    checks = F.when(doc.isNotNull(), F.array(F.lit(True), schema, schema & identity))
    return checks, F.when(F.coalesce(F.forall(checks, lambda c: c), F.lit(False)), "PASS").otherwise("FAIL")


def hydration(regions: DataFrame, key: str, place: str, region: str, model: str, total: str, chunk: int = 262144) -> DataFrame:
    """Byte windows that a hydration reads: repeated regions of a key count once; every window has one width and a hashed start."""
    first = regions.groupBy(key, region).agg(F.min(place).alias("p"), F.first(model).alias("m"), F.first(total).alias("total"))
    w = W.partitionBy(key)
    rows = first.withColumn("i", F.row_number().over(w.orderBy("p")) - 1).withColumn("n", F.count("*").over(w))
    window = F.greatest(F.lit(max(32768, chunk)).cast("long"), F.floor(F.col("total") / F.greatest(F.lit(2), F.col("n") + 1)))
    number = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("m").cast("string"), F.col(region).cast("string"), F.col("i").cast("string")), 256), 1, 12), 16, 10).cast("long")
    room = F.greatest(F.lit(0), F.col("total") - window)
    start = F.when(room == 0, F.lit(0)).otherwise(number % F.when(room == 0, 1).otherwise(room))
    return rows.select(key, F.col(region), F.col("i").alias("place"), start.cast("long").alias("start"), F.least(F.col("total"), start + window).cast("long").alias("stop"))


def region_priority(name: Column, size: Column) -> Column:
    """0 first at a cold start, then small parts, warm, hot and cold tensors by size, and records last."""
    n = F.lower(name)
    has = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(n, m))
    return F.when(has(COLD_MARKS), 5).when(has(HOT_MARKS), 0).when(has(SMALL_MARKS), 1).when(size < WARM_BYTES, 2).when(size < HOT_BYTES, 3).otherwise(4)


def optimized_pack(refs: DataFrame, pack: str, region: str, ord_: str, chunk: str, size: str, name: str, region_size: str) -> DataFrame:
    """New places and offsets of a pack's chunks: regions by priority, kept in order within one, each chunk at its first use."""
    rows = refs.withColumn("priority", region_priority(F.col(name), F.col(region_size)))
    first = rows.groupBy(pack, chunk).agg(F.min(F.struct("priority", region, ord_)).alias("at"), F.first(size).alias("size"))
    w = W.partitionBy(pack).orderBy("at")
    return first.select(pack, chunk, (F.row_number().over(w) - 1).alias("new_index"), F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("new_offset"))


def negotiated(disk: Column, ram: Column, quality: Column) -> dict[str, Column]:
    """A download plan from measured limits: tiny, whole or partial."""
    from ..functions.formulas import to_fixed

    half_up = lambda x: F.floor(x + 0.5)
    tiny = (quality <= 0.80) | (ram <= 4) | (disk <= 3)
    whole = quality >= 0.99
    pick = lambda a, b, c: F.when(tiny, a).when(whole, b).otherwise(c)
    download = pick(F.lit(0.9), disk, to_fixed(disk * 0.4, 1))
    return {
        "plan": pick(F.lit("tiny-local"), F.lit("full-local-hydration"), F.lit("partial-local")), "download_gb": download, "bytes_avoided_gb": to_fixed(disk - download, 1),
        "first_usable_seconds": pick(F.lit(8), F.lit(120), F.lit(18)), "full_local_minutes": pick(F.lit(3).cast("long"), half_up(disk * 1.5), half_up(disk * 0.8)), "remote_fallback": tiny | ~whole,
    }


def memory_pack(tasks: Column) -> dict[str, Column]:
    """Contents and size of the memory pack of a list of tasks; an unknown task has the default profile."""
    from ..functions.formulas import to_fixed

    of = lambda i: F.create_map(*[F.lit(x) for t, p in MEMORY_PROFILES.items() for x in (t, p[i])])
    each = lambda i: F.transform(tasks, lambda t: F.coalesce(F.element_at(of(i), t), F.lit(MEMORY_PROFILES["default"][i])))
    total = lambda i: F.aggregate(each(i), F.lit(0), lambda a, x: a + x)
    layers = F.create_map(*[x for t, p in MEMORY_PROFILES.items() for x in (F.lit(t), F.array(*map(F.lit, p[3])))])
    routing = F.array_sort(F.array_distinct(F.flatten(F.transform(tasks, lambda t: F.coalesce(F.element_at(layers, t), F.array(*map(F.lit, MEMORY_PROFILES["default"][3])))))))
    return {"centroids": total(0), "features": total(1), "adapters": total(2), "layers": routing, "slots": F.size(tasks) * 64, "size_mb": to_fixed(total(0) * 0.002 + total(1) * 0.001 + 12.0, 1)}


def cohort_check(rows: DataFrame, key: str, group: str, reference: DataFrame) -> DataFrame:
    """Per group: rows, repeated keys, and keys that the reference lacks; ok where there are neither."""
    per_key = rows.groupBy(group, key).agg(F.count("*").alias("n"))
    known = per_key.join(reference.select(key).distinct().withColumn("__known", F.lit(True)), key, "left")
    out = known.groupBy(group).agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("__known").isNull()).alias("unknown"))
    return out.withColumn("ok", (F.col("repeated") == 0) & (F.col("unknown") == 0))


def ownership_check(ledger: DataFrame, path: str, source: str, copied: str, state: str, reconciled: str) -> DataFrame:
    """What is wrong with each row of a ledger of moved files: unsafe or repeated paths, and digests that contradict the state."""
    repeated = F.count("*").over(W.partitionBy(path)) > 1
    unsafe = F.startswith(F.col(path), F.lit("/")) | F.array_contains(F.split(path, "/"), "..")
    same = F.col(source) == F.col(copied)
    wrong = F.array(F.when(unsafe, "unsafe_path"), F.when(repeated, "repeated_path"), F.when((F.col(state) == reconciled) & same, "not_a_new_blob"), F.when((F.col(state) != reconciled) & ~same, "source_drift"))
    return ledger.withColumn("issues", F.filter(wrong, lambda i: i.isNotNull()))


def routed_by(rules: str, fields: dict[str, Column], fallback: str) -> Column:
    """Route rules from JSON, in order: [{"when": {field: value or [values]}, "then": route}]; the first whose fields all match."""
    out = None
    for rule in json.loads(rules):
        hit = F.lit(True)
        for name, want in rule["when"].items():
            hit = hit & F.coalesce(fields[name].cast("string").isin([str(v) for v in (want if isinstance(want, list) else [want])]), F.lit(False))
        out = F.when(hit, rule["then"]) if out is None else out.when(hit, rule["then"])
    return F.lit(fallback) if out is None else out.otherwise(fallback)


def flattened(df: DataFrame, key: str, doc: str) -> DataFrame:
    """A two-level JSON object as rows (key, family, name, value)."""
    families = df.select(key, F.explode(F.from_json(doc, "map<string, map<string, string>>")).alias("family", "members"))
    return families.select(key, "family", F.explode("members").alias("name", "value"))

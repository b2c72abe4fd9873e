"""Registered queries of charts, record checks, gates and plans over the standard tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import formulas, jsonish
from ..operators import charts, lineage, records
from ..sources import binary
from .registry import fixed_sql, registered, table

_WORD = "(CAST('0x' || substr({h}, {a}, 8) AS BIGINT) / 4294967295::DOUBLE * 4 - 2)"


def _words(h: str) -> list[str]:
    return [_WORD.format(h=h, a=8 * i + 1) for i in range(8)]


def _rounded(columns, name="coords"):
    return F.transform(columns, lambda x: F.round(x, 6)).alias(name)


@registered(f"SELECT p_partkey, [{', '.join(f'round({w}, 6)' for w in _words('sha256(p_name)'))}] AS coords FROM part")
def chart_text_proof(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", _rounded(charts.by_hash(F.col("p_name"))))


_JSON = """'{"s":' || CAST(s_suppkey AS VARCHAR) || '}'"""
_LIN = "((least(greatest({x}, {a}::DOUBLE), {b}::DOUBLE) - {a}) / ({b}::DOUBLE - {a}) * 4 - 2)"


def _chart_sql(values: list[str | None]) -> str:
    fallback = _words(f"sha256({_JSON})")
    return f"SELECT s_suppkey, [{', '.join(f'round({f if v is None else f'coalesce({v}, {f})'}, 6)' for v, f in zip(values, fallback))}] AS coords FROM supplier"


_K = "CAST(s_suppkey AS DOUBLE)"
_NULLED = "CASE WHEN s_suppkey % 3 <> 0 THEN {} END"


def _supplier(spark, sf_dir):
    k = F.col("s_suppkey").cast("double")
    return table(spark, sf_dir, "supplier"), k, F.concat(F.lit('{"s":'), F.col("s_suppkey").cast("string"), F.lit("}"))


@registered(_chart_sql([_LIN.format(x=f"({_K} % 200 - 100)", a=-90, b=90), _NULLED.format(_LIN.format(x=f"({_K} % 400 - 200)", a=-180, b=180)), f"(least(greatest(ln(1 + {_K}), 0), ln(2001::DOUBLE)) / ln(2001::DOUBLE) * 4 - 2) * 2 - 2",
                        None, None, _LIN.format(x=f"({_K} % 20)", a=0, b=16), None, _LIN.format(x=f"({_K} % 10 / 10)", a=0, b=1) + " * -2 + 0"]))
def chart_geo_runtime(spark, sf_dir):
    s, k, text = _supplier(spark, sf_dir)
    fields = {"lat": k % 200 - 100, "lon": F.when(F.col("s_suppkey") % 3 != 0, k % 400 - 200), "latency_ms": k, "relay_count": k % 20, "error_rate": k % 10 / 10}
    return s.select("s_suppkey", _rounded(charts.by_fields("geo_runtime", fields, text)))


@registered(_chart_sql([_LIN.format(x=_K, a=0, b=1000), None, None, _LIN.format(x=f"log2(greatest({_K}, 1))", a=0, b=16) + " * 2 - 2", None, _NULLED.format(_LIN.format(x=f"({_K} * 7)", a=0, b=512)), _LIN.format(x=f"({_K} * 31 % 256)", a=0, b=255), _WORD.format(h="sha256(s_name)", a=1)]))
def chart_memory(spark, sf_dir):
    s, k, text = _supplier(spark, sf_dir)
    fields = {"task_count": k, "sae_dim": k, "cache_slots": F.when(F.col("s_suppkey") % 3 != 0, k * 7), "revision": k * 31, "proof_hash": F.concat(F.lit("sha256:"), F.sha2("s_name", 256))}
    return s.select("s_suppkey", _rounded(charts.by_fields("memory", fields, text)))


@registered(_chart_sql([_LIN.format(x=f"({_K} % 13 / 10)", a=0, b=1), None, _LIN.format(x=f"({_K} % 17)", a=0, b=10), _LIN.format(x=f"log2(greatest({_K}, 1))", a=0, b=12) + " * 2 - 2", None, None, _LIN.format(x=f"({_K} % 300)", a=0, b=256), "CASE WHEN s_suppkey % 2 = 0 THEN " + _WORD.format(h="sha256('attn')", a=1) + " END"]))
def chart_model_block(spark, sf_dir):
    s, k, text = _supplier(spark, sf_dir)
    fields = {"eta_L": k % 13 / 10, "spectral_gap": k % 17, "effective_rank": k, "layer_index": k % 300, "block_type": F.when(F.col("s_suppkey") % 2 == 0, "attn").otherwise("")}
    return s.select("s_suppkey", _rounded(charts.by_fields("model_block", fields, text)))


@registered("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'model_block' WHEN 1 THEN 'geo_runtime' WHEN 2 THEN 'memory' WHEN 3 THEN 'text_proof' WHEN 4 THEN 'generic' ELSE 'text_proof' END AS chart FROM events""")
def chart_detect(spark, sf_dir):
    names = [["text", "eta_L"], ["region_index"], ["slot_count", "x"], ["proof_hash"], ["k"]]
    keys = F.try_element_at(F.array(*[F.array(*map(F.lit, n)) for n in names]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", charts.detected(keys).alias("chart"))



@registered("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ed') OR starts_with(sha256(p_name), 'ed')")
def entity_search(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("id", F.sha2("p_name", 256))
    return records.entity_matches(p, "ed", "p_name", "id").select("p_partkey", "p_name")


@registered("""SELECT event_id, array_to_string(list_concat(list_concat(CASE WHEN event_type <> 'error' THEN ['missing_triggered_fail_conditions'] ELSE [] END,
    CASE WHEN event_id % 4 = 0 THEN ['missing_fail_condition_fields'] WHEN event_id % 4 = 1 THEN ['missing_fail_condition_field:missing_witnesses', 'missing_fail_condition_field:residual_delta_exceeded', 'missing_fail_condition_field:boundary_crossing_disallowed', 'missing_fail_condition_field:chart_transition_disallowed'] ELSE [] END),
    CASE WHEN event_id % 3 = 0 THEN ['missing_risk_score'] ELSE [] END), ',') AS issues FROM events""")
def fail_vector_issues(spark, sf_dir):
    i = F.col("event_id")
    triggered = F.when(F.col("event_type") == "error", F.array(F.lit("witness_bound")))
    fields = F.when(i % 4 == 1, F.array(F.lit("failed_invariants"), F.lit("missing_invariants"))).when(i % 4 != 0, F.array(*map(F.lit, records.FAIL_FIELDS)))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(records.fail_vector_issues(triggered, fields, F.when(i % 3 != 0, F.col("value"))), ",").alias("issues"))


@registered("""SELECT user_id, COUNT(*) FILTER (WHERE event_type IN ('view', 'x')) AS pass, COUNT(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS warn, COUNT(*) FILTER (WHERE event_type = 'error') AS fail, COUNT(*) FILTER (WHERE event_type = 'signup') AS info FROM events GROUP BY 1""")
def lineage_status(spark, sf_dir):
    names = {"view": "PASS", "click": "PASS_WITH_DRIFT", "purchase": "BOUNDARY_CROSSING", "error": "CONTINUITY_FAIL", "signup": "INITIALIZED"}
    verdict = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("event_type"))
    s = table(spark, sf_dir, "events").select("user_id", lineage.status(verdict).alias("status"))
    return s.groupBy("user_id").agg(*[F.count_if(F.col("status") == v.upper()).alias(v) for v in ("pass", "warn", "fail", "info")])


@registered("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'FAIL' ELSE 'FAIL' END AS verdict, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS passed FROM orders""")
def release_gate(spark, sf_dir):
    k = F.col("o_orderkey")
    doc = F.when(k % 4 == 0, '{"schema_version": "v1", "merkle_root": "ab"}').when(k % 4 == 1, '{"schema_version": "v1", "hash": ""}').when(k % 4 == 2, '{"artifact_id": "x"}').otherwise("{not json")
    checks, verdict = records.release_gate(doc)
    return table(spark, sf_dir, "orders").select("o_orderkey", verdict.alias("verdict"), F.size(F.filter(checks, lambda c: c)).alias("passed"))


@registered("""WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '-') || '-v' || CAST(p_size AS VARCHAR) || '.1' WHEN 1 THEN replace(p_name, ' ', '_') || '@v2' ELSE p_name || '/v' END AS ref FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN regexp_extract(ref, '^(.+?)[-@](v[0-9][A-Za-z0-9_.]*)$', 1) ELSE ref END AS base, CASE WHEN p_partkey % 3 < 2 THEN regexp_extract(ref, '^(.+?)[-@](v[0-9][A-Za-z0-9_.]*)$', 2) END AS version, regexp_replace(ref, '[^a-zA-Z0-9._-]', '-', 'g') AS clean FROM r""")
def version_refs(spark, sf_dir):
    k = F.col("p_partkey")
    ref = F.when(k % 3 == 0, F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-v"), F.col("p_size").cast("string"), F.lit(".1"))).when(k % 3 == 1, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("@v2"))).otherwise(F.concat("p_name", F.lit("/v")))
    base, version = records.versioned(ref)
    return table(spark, sf_dir, "part").select("p_partkey", base.alias("base"), version.alias("version"), records.sanitized_ref(ref).alias("clean"))


@registered(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {fixed_sql('l_extendedprice / l_quantity / 7', 4)} AS four, {fixed_sql('l_extendedprice * l_discount', 2)} AS two FROM lineitem")
def fixed_decimals(spark, sf_dir):
    price, quantity = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", formulas.to_fixed(price / quantity / 7, 4).alias("four"), formulas.to_fixed(price * F.col("l_discount").cast("double"), 2).alias("two"))


@registered(f"""WITH s AS (SELECT s_suppkey, CAST(s_suppkey % 60 AS DOUBLE) / 4 AS disk, CAST(s_suppkey % 33 AS DOUBLE) AS ram, CAST(70 + s_suppkey % 31 AS DOUBLE) / 100 AS quality FROM supplier),
    t AS (SELECT *, quality <= 0.80::DOUBLE OR ram <= 4 OR disk <= 3 AS tiny, quality >= 0.99::DOUBLE AS whole FROM s),
    d AS (SELECT *, CASE WHEN tiny THEN 0.9::DOUBLE WHEN whole THEN disk ELSE {fixed_sql('disk * 0.4::DOUBLE', 1)} END AS dl FROM t)
    SELECT s_suppkey, CASE WHEN tiny THEN 'tiny-local' WHEN whole THEN 'full-local-hydration' ELSE 'partial-local' END AS plan, dl AS download_gb, sign(disk - dl) * {fixed_sql('abs(disk - dl)', 1)} AS bytes_avoided_gb,
    CASE WHEN tiny THEN 8 WHEN whole THEN 120 ELSE 18 END AS first_usable_seconds, CASE WHEN tiny THEN 3 WHEN whole THEN CAST(floor(disk * 1.5::DOUBLE + 0.5) AS BIGINT) ELSE CAST(floor(disk * 0.8::DOUBLE + 0.5) AS BIGINT) END AS full_local_minutes, tiny OR NOT whole AS remote_fallback FROM d""")
def negotiate_plan(spark, sf_dir):
    k = F.col("s_suppkey")
    plan = records.negotiated((k % 60).cast("double") / 4, (k % 33).cast("double"), (70 + k % 31).cast("double") / 100)
    return table(spark, sf_dir, "supplier").select("s_suppkey", *[c.alias(n) for n, c in plan.items()])


_PROFILES = ", ".join(f"('{t}', {a}, {b}, {c}, {d})" for t, (a, b, c, d) in records.MEMORY_PROFILES.items())


@registered(f"""WITH p AS (SELECT * FROM (VALUES {_PROFILES}) v(task, centroids, features, adapters, layers)),
    t AS (SELECT n_nationkey, unnest(['rag', CASE n_nationkey % 3 WHEN 0 THEN 'brief' WHEN 1 THEN 'unheard-of' ELSE 'classify' END]) AS task FROM nation),
    j AS (SELECT n_nationkey, p.* FROM t JOIN p ON p.task = CASE WHEN t.task IN (SELECT task FROM p) THEN t.task ELSE 'default' END)
    SELECT n_nationkey, CAST(SUM(centroids) AS BIGINT) AS centroids, CAST(SUM(features) AS BIGINT) AS features, CAST(SUM(adapters) AS BIGINT) AS adapters, array_to_string(list_sort(list_distinct(flatten(list(layers)))), ',') AS layers, COUNT(*) * 64 AS slots, round(SUM(centroids) * 0.002 + SUM(features) * 0.001 + 12.0, 1)::DOUBLE AS size_mb FROM j GROUP BY 1""")
def memory_pack(spark, sf_dir):
    k = F.col("n_nationkey")
    pack = records.memory_pack(F.array(F.lit("rag"), F.when(k % 3 == 0, "brief").when(k % 3 == 1, "unheard-of").otherwise("classify")))
    whole = {n: c.cast("long") if n in ("centroids", "features", "adapters", "slots") else F.array_join(F.transform(c, lambda x: x.cast("string")), ",") if n == "layers" else c for n, c in pack.items()}
    return table(spark, sf_dir, "nation").select("n_nationkey", *[c.alias(n) for n, c in whole.items()])


@registered("""WITH r AS (SELECT l_orderkey AS k, 'r' || CAST(l_partkey % 20 AS VARCHAR) AS region, MIN(l_linenumber * 100000 + l_partkey) AS p FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p) - 1 AS i, COUNT(*) OVER (PARTITION BY k) AS n, k * 1000 + 300000 AS total FROM r),
    w AS (SELECT *, greatest(262144, total // greatest(2, n + 1)) AS w FROM n), s AS (SELECT *, greatest(0, total - w) AS room FROM w),
    t AS (SELECT *, CASE WHEN room = 0 THEN 0 ELSE CAST('0x' || substr(sha256('m' || ':' || region || ':' || CAST(i AS VARCHAR)), 1, 12) AS BIGINT) % room END AS start FROM s)
    SELECT k AS l_orderkey, region, i AS place, start, least(total, start + w) AS stop FROM t""")
def hydration_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("p"), F.concat(F.lit("r"), (F.col("l_partkey") % 20).cast("string")).alias("region"), F.lit("m").alias("model"), (F.col("l_orderkey") * 1000 + 300000).cast("long").alias("total"))
    return records.hydration(rows, "l_orderkey", "p", "region", "model", "total").withColumn("place", F.col("place").cast("long"))


_PACK = """SELECT l_suppkey % 7 AS pack, l_orderkey AS region, l_linenumber * 1000000 + l_partkey AS ord, l_partkey AS chunk, l_partkey % 50 + 1 AS size, CASE WHEN l_orderkey % 9 = 0 THEN 'audit' WHEN l_orderkey % 9 = 1 THEN 'Tokenizer' WHEN l_orderkey % 9 = 2 THEN 'lora_a' ELSE 'tensor' END AS name, l_orderkey * 40000 AS bytes FROM lineitem"""


@registered(f"""WITH l AS ({_PACK}), f AS (SELECT pack, chunk, MIN((CASE name WHEN 'audit' THEN 5 WHEN 'Tokenizer' THEN 0 WHEN 'lora_a' THEN 1 ELSE CASE WHEN bytes < 67108864 THEN 2 WHEN bytes < 1073741824 THEN 3 ELSE 4 END END, region, ord)) AS place_at, MIN(size) AS size FROM l GROUP BY 1, 2)
    SELECT pack, chunk, row_number() OVER (PARTITION BY pack ORDER BY place_at) - 1 AS new_index, CAST(COALESCE(SUM(size) OVER (PARTITION BY pack ORDER BY place_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_offset FROM f""")
def pack_optimize(spark, sf_dir):
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("pack"), k.alias("region"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"), F.col("l_partkey").alias("chunk"), (F.col("l_partkey") % 50 + 1).alias("size"),
        F.when(k % 9 == 0, "audit").when(k % 9 == 1, "Tokenizer").when(k % 9 == 2, "lora_a").otherwise("tensor").alias("name"), (k.cast("long") * 40000).alias("bytes"),
    )
    return records.optimized_pack(rows, "pack", "region", "ord", "chunk", "size", "name", "bytes")


@registered("""WITH r AS (SELECT o_custkey AS k, o_orderpriority AS g FROM orders), p AS (SELECT g, k, COUNT(*) AS n FROM r GROUP BY 1, 2)
    SELECT g, CAST(SUM(n) AS BIGINT) AS rows, COUNT(*) FILTER (WHERE n > 1) AS repeated, COUNT(*) FILTER (WHERE c.c_custkey IS NULL) AS unknown, COUNT(*) FILTER (WHERE n > 1) = 0 AND COUNT(*) FILTER (WHERE c.c_custkey IS NULL) = 0 AS ok FROM p LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3) c ON c.c_custkey = p.k GROUP BY 1""")
def cohort_check(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("g"))
    return records.cohort_check(rows, "k", "g", table(spark, sf_dir, "customer").filter("c_nationkey != 3").select(F.col("c_custkey").alias("k")))


@registered("""WITH l AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '/abs' || p_name WHEN 1 THEN 'a/../' || p_name WHEN 2 THEN 'dup' ELSE 'x/' || CAST(p_partkey AS VARCHAR) END AS path, p_partkey % 2 AS a, p_partkey % 3 % 2 AS b, CASE WHEN p_partkey % 7 = 0 THEN 'merged' ELSE 'copied' END AS state FROM part),
    c AS (SELECT *, COUNT(*) OVER (PARTITION BY path) AS n FROM l)
    SELECT p_partkey, concat_ws(',', CASE WHEN starts_with(path, '/') OR list_contains(string_split(path, '/'), '..') THEN 'unsafe_path' END, CASE WHEN n > 1 THEN 'repeated_path' END, CASE WHEN state = 'merged' AND a = b THEN 'not_a_new_blob' END, CASE WHEN state <> 'merged' AND a <> b THEN 'source_drift' END) AS issues FROM c""")
def ownership_check(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("/abs"), "p_name")).when(k % 5 == 1, F.concat(F.lit("a/../"), "p_name")).when(k % 5 == 2, "dup").otherwise(F.concat(F.lit("x/"), k.cast("string")))
    ledger = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), (k % 2).alias("a"), (k % 3 % 2).alias("b"), F.when(k % 7 == 0, "merged").otherwise("copied").alias("state"))
    return records.ownership_check(ledger, "path", "a", "b", "state", "merged").select("p_partkey", F.array_join("issues", ",").alias("issues"))


_RULES = '[{"when": {"type": "error"}, "then": "quarantine"}, {"when": {"type": ["click", "view"], "small": "true"}, "then": "sampled"}, {"when": {"small": "true"}, "then": "queue"}]'


@registered("SELECT event_id, CASE WHEN event_type = 'error' THEN 'quarantine' WHEN event_type IN ('click', 'view') AND value < 20 THEN 'sampled' WHEN value < 20 THEN 'queue' ELSE 'direct' END AS route FROM events")
def route_rules(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", records.routed_by(_RULES, {"type": F.col("event_type"), "small": F.col("value") < 20}, "direct").alias("route"))


@registered("""SELECT event_id AS key, ['z', 'props', 'a'] AS top_keys, 3 AS top_key_count, false AS is_array, 3 AS depth, sha256('{"a":' || CAST(event_id AS VARCHAR) || ',"props":{"y":[1],"b":2},"z":"' || event_type || '"}') AS shallow_hash FROM events""")
def json_shape(spark, sf_dir):
    doc = F.concat(F.lit('{"z": "'), "event_type", F.lit('", "props": {"y": [1], "b": 2}, "a": '), F.col("event_id").cast("string"), F.lit("}"))
    return jsonish.shaped(table(spark, sf_dir, "events").select("event_id", doc.alias("doc")), "event_id", "doc")


@registered("""SELECT r_regionkey, 'core' AS family, 'name' AS name, r_name AS value FROM region UNION ALL SELECT r_regionkey, 'core', 'size', CAST(r_regionkey * 2 AS VARCHAR) FROM region UNION ALL SELECT r_regionkey, 'edge', 'on', 'true' FROM region""")
def capability_flatten(spark, sf_dir):
    doc = F.concat(F.lit('{"core": {"name": "'), "r_name", F.lit('", "size": '), (F.col("r_regionkey") * 2).cast("string"), F.lit('}, "edge": {"on": true}}'))
    return records.flattened(table(spark, sf_dir, "region").select("r_regionkey", doc.alias("doc")), "r_regionkey", "doc")


_KINDS = "CASE WHEN p_size % 6 = 0 THEN 'L.Q_PROJ' WHEN p_size % 6 = 1 THEN 'enc_dec.attn' WHEN p_size % 6 = 2 THEN 'ffn_1' WHEN p_size % 6 = 3 THEN 'tok_emb' WHEN p_size % 6 = 4 THEN 'ln_f' ELSE 'conv' END"


@registered("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'self_attention' WHEN 1 THEN 'cross_attention' WHEN 2 THEN 'ffn' WHEN 3 THEN 'embedding' WHEN 4 THEN 'norm' ELSE 'layer' END AS kind FROM part")
def tensor_kinds(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", binary.kind_of(F.expr(_KINDS)).alias("kind"))


@registered("""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, COALESCE(regexp_replace(list_filter(l, lambda s: regexp_matches(s, '^#\\s'))[1], '^#+\\s*', ''), 'doc-' || CAST(doc_id AS VARCHAR)) AS title, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word_count FROM t""")
def repurpose_json(spark, sf_dir):
    """What a text gives as JSON: its first heading, or a name for it, and its words."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    heading = F.try_element_at(F.filter(F.split("text", "\r?\n"), lambda s: s.rlike(r"^#\s")), F.lit(1))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long")
    return d.select("doc_id", F.coalesce(F.regexp_replace(heading, r"^#+\s*", ""), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("title"), words.alias("word_count"))


@registered("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def latest_by_time(spark, sf_dir):
    """The newest row of each key, as of files by their times."""
    newest = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").filter("ts IS NOT NULL").withColumn("r", F.row_number().over(newest)).filter("r = 1").select("user_id", "event_id")

"""Registered queries of the engine's own operators over the standard tables, with equivalent SQL.

In the tables, an event's user_id stands for the model, its event_type for the command, its
value for the quantity; an order's parts stand for the chunks of a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import formulas, jsonish, tensors, text
from ..operators import chunks, continuity, lineage, metering, planning, vectors
from ..operators.policies import BANDS, POLICIES
from ..sources import sinks
from ..streaming import events as streams
from .predicate import query, typed_fields, where
from .registry import QUERIES, SQL, fixed_sql, registered, table

SINCE = "2024-01-15 00:00:00"
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"

# --- metering and ledger -----------------------------------------------------------------------------


@registered(f"""SELECT user_id AS model, event_type AS event, CAST(GROUPING(user_id) AS INT) AS by_event_only,
    CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, COUNT(*) AS n, {_STAMP.format('MIN(ts)')} AS first_at, {_STAMP.format('MAX(ts)')} AS last_at
    FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '{SINCE}' GROUP BY GROUPING SETS ((event_type), (user_id, event_type))""")
def usage_report_grouping_sets(spark, sf_dir):
    return metering.usage_report(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "ts", SINCE)


@registered("SELECT event_type, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, COUNT(*) AS n FROM events GROUP BY 1")
def meter_summary(spark, sf_dir):
    return metering.summary(table(spark, sf_dir, "events"), ["event_type"], "value")


@registered(f"SELECT event_id, user_id, event_type, value FROM events WHERE user_id = 7 AND (ts IS NULL OR ts >= TIMESTAMP '{SINCE}')")
def meter_list_since(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.filter((F.col("user_id") == 7) & (F.col("ts").isNull() | (F.col("ts") >= F.lit(SINCE).cast("timestamp")))).select("event_id", "user_id", "event_type", "value")


@registered(f"SELECT concat_ws(',', CAST(event_id AS VARCHAR), {_STAMP.format('ts')}, CAST(user_id AS VARCHAR), event_type) AS line FROM events")
def ledger_export(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat_ws(",", F.col("event_id").cast("string"), metering.stamp("ts"), F.col("user_id").cast("string"), "event_type").alias("line"))


@registered("SELECT DISTINCT user_id FROM events")
def distinct_models(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id").distinct()


@registered("SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1")
def queue_stats(spark, sf_dir):
    return metering.counts(table(spark, sf_dir, "events"), "event_type")


@registered("""SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS models FROM events
    WHERE starts_with(event_type, 'c') OR starts_with(event_type, 'p') GROUP BY 1""")
def wire_report_prefix(spark, sf_dir):
    rows = metering.prefix_report(table(spark, sf_dir, "events"), "event_type", ["c", "p"])
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("models"))


@registered("""SELECT n_regionkey, string_agg(DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN n_name END, ',' ORDER BY CASE WHEN n_nationkey % 2 = 0 THEN n_name END) AS even,
    string_agg(DISTINCT CASE WHEN n_nationkey % 2 = 1 THEN n_name END, ',' ORDER BY CASE WHEN n_nationkey % 2 = 1 THEN n_name END) AS odd FROM nation GROUP BY 1""")
def family_pivot(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("state", F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd"))
    return metering.family_lists(n, "n_regionkey", "state", "n_name", ["even", "odd"])


@registered("""SELECT l_orderkey, CAST(SUM(CAST(COALESCE(l_quantity, 1) AS DECIMAL(18,2)) * CAST(COALESCE(l_extendedprice, 0) AS DECIMAL(18,2))) AS DOUBLE) AS total,
    COUNT(*) AS lines FROM lineitem GROUP BY 1""")
def invoice_total(spark, sf_dir):
    return metering.invoice_total(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_quantity"), F.col("l_extendedprice"))


_MARGIN = """WITH s AS (SELECT l_suppkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
    CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) * 900 AS cost FROM lineitem GROUP BY 1)"""


@registered(_MARGIN + " SELECT l_suppkey, revenue, CASE WHEN revenue <> 0 THEN (revenue - cost) * 100 / revenue END AS margin_pct FROM s")
def gross_margin(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(metering.money_sum("l_extendedprice").alias("revenue"), (metering.money_sum("l_quantity") * 900).alias("cost"))
    return s.select("l_suppkey", "revenue", metering.margin(F.col("revenue"), F.col("cost")).alias("margin_pct"))


@registered("""SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS credits, COUNT(*) AS n
    FROM orders GROUP BY 1, 2""")
def credit_settle_monthly(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("period", F.date_format("o_orderdate", "yyyy-MM"))
    return o.groupBy("period", "o_orderpriority").agg(metering.money_sum("o_totalprice").alias("credits"), F.count("*").alias("n"))


@registered("""WITH w AS (SELECT time_bucket(INTERVAL '24 hours', ts) AS s, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM events GROUP BY 1)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, spend, spend / 24 AS burn_per_hour, CASE WHEN spend > 0 THEN 5000.0::DOUBLE / (spend / 24) END AS eta_hours, spend > 0.8::DOUBLE * 5000.0::DOUBLE AS fired FROM w""")
def budget_burn(spark, sf_dir):
    return metering.burn(table(spark, sf_dir, "events"), "ts", "value", 24, 5000.0)


@registered("""SELECT l_suppkey, COUNT(*) AS n, COUNT(*) FILTER (WHERE l_quantity > 45) AS latency_violations, COUNT(*) FILTER (WHERE l_discount > 0.08) AS price_violations,
    COUNT(*) FILTER (WHERE l_quantity > 45) * 10 <= COUNT(*) AS compliant FROM lineitem GROUP BY 1""")
def sla_violations(spark, sf_dir):
    late = F.count_if(F.col("l_quantity") > 45)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), late.alias("latency_violations"), F.count_if(F.col("l_discount") > 0.08).alias("price_violations"), (late * 10 <= F.count("*")).alias("compliant"))


@registered("""WITH r AS (SELECT l_suppkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS i, COUNT(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
    SELECT l_suppkey, MAX(x) FILTER (WHERE i = least(n - 1, CAST(floor(n * 0.5) AS BIGINT))) AS p50, MAX(x) FILTER (WHERE i = least(n - 1, CAST(floor(n * 0.9) AS BIGINT))) AS p90, MAX(x) AS p99 FROM r GROUP BY 1""")
def perf_percentiles(spark, sf_dir):
    w = W.partitionBy("l_suppkey")
    r = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("x"), (F.row_number().over(w.orderBy("l_extendedprice", "l_orderkey", "l_linenumber")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    at = lambda q: F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.floor(F.col("n") * q)), F.col("x")))
    return r.groupBy("l_suppkey").agg(at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("x").alias("p99"))


@registered("""SELECT quality AS label, COUNT(*) AS n, COALESCE(CAST(SUM(CAST(toxic AS DECIMAL(18,2))) AS DOUBLE) / COUNT(toxic), 0) AS mean_score FROM labels GROUP BY 1""")
def learn_tune(spark, sf_dir):
    return metering.tune(table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic"))


@registered("""SELECT COUNT(*) AS documents, COUNT(*) FILTER (WHERE n_chars > 1000) AS hydrated, SUM(n_chars) FILTER (WHERE n_chars > 1000) AS hydrated_chars,
    CAST(COUNT(*) FILTER (WHERE n_chars > 1000) AS DOUBLE) / COUNT(*) AS readiness FROM documents""")
def hydrate_summary(spark, sf_dir):
    big = F.col("n_chars") > 1000
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count_if(big).alias("hydrated"), F.sum(F.when(big, F.col("n_chars"))).alias("hydrated_chars"), (F.count_if(big) / F.count("*")).alias("readiness"))


# --- log queries ------------------------------------------------------------------------------------


@registered("SELECT event_id, event_type, value FROM events WHERE event_type = 'click' OR value >= 90")
def log_query_or_filter(spark, sf_dir):
    return query(table(spark, sf_dir, "events"), "event_type=click OR value>=90", ["event_id", "event_type", "value"], None)


@registered("SELECT event_id, event_type FROM events WHERE event_type LIKE 'p%' OR event_type LIKE '%gn%'")
def log_query_like(spark, sf_dir):
    return query(table(spark, sf_dir, "events"), "event_type LIKE 'p%' or event_type like '%gn%'", ["event_id", "event_type"], None)


@registered("""SELECT event_id, json_extract_string(props, '$.k') AS "props.k" FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 95 OR json_extract_string(props, '$.k') = '7'""")
def log_query_json_path(spark, sf_dir):
    return query(table(spark, sf_dir, "events"), "props.k>=95 OR props.k=7", ["event_id", "props.k"], None, json_columns=("props",))


@registered("SELECT event_id, event_type FROM events WHERE event_type <> 'view' ORDER BY event_id LIMIT 25")
def log_query_limit_ord(spark, sf_dir):
    return query(table(spark, sf_dir, "events"), "event_type!=view", ["event_id", "event_type"], 25, "event_id")


@registered("SELECT COUNT(*) AS total_matched FROM events WHERE starts_with(event_type, 'pu') OR value <= 5")
def log_query_total(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.filter(where("event_type=pu% OR value<=5", typed_fields(e))).agg(F.count("*").alias("total_matched"))


@registered("""SELECT kind, id, "at" FROM (SELECT 'event' AS kind, event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "at" FROM events
    UNION ALL SELECT 'order', o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM orders) ORDER BY "at" DESC, kind, id LIMIT 20""")
def event_union_listen_topk(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), metering.stamp("ts").alias("at"))
    b = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), metering.stamp("o_orderdate").alias("at"))
    return a.unionByName(b).orderBy(F.desc("at"), "kind", "id").limit(20)


@registered("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') ORDER BY p_partkey DESC LIMIT 10")
def intake_resolve(spark, sf_dir):
    hay = F.array(F.lower("p_name"), F.lower("p_type"))
    return table(spark, sf_dir, "part").filter(F.exists(hay, lambda s: F.contains(s, F.lit("ring")))).orderBy(F.desc("p_partkey")).limit(10).select("p_partkey", "p_name")


# --- lineage, chains, trees ---------------------------------------------------------------------------

_E = "user_id AS model, event_id AS ord, sha256(event_type) AS h"


@registered(f"""WITH e AS (SELECT {_E}, lag(sha256(event_type)) OVER (PARTITION BY user_id ORDER BY event_id) AS from_hash FROM events)
    SELECT model, ord, from_hash, h AS to_hash, from_hash = h AS is_self_loop FROM e WHERE from_hash IS NOT NULL""")
def lineage_edges_lag(spark, sf_dir):
    return lineage.edges(_log(spark, sf_dir), "model", "ord", "h")


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("model"), F.col("event_id").alias("ord"), "event_type", F.sha2("event_type", 256).alias("h"))


@registered(f"""WITH f AS (SELECT user_id AS model, sha256(event_type) AS h, MIN(event_id) AS first_ord, arg_min(event_type, event_id) AS label, COUNT(*) AS times FROM events GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY model ORDER BY first_ord) - 1 AS node FROM f""")
def lineage_first_occurrence(spark, sf_dir):
    return lineage.nodes(_log(spark, sf_dir), "model", "ord", "h", "event_type")


_CE = """WITH l AS (SELECT user_id AS model, event_id AS ord, CASE WHEN event_type IN ('click', 'view') THEN CAST(CAST(value AS INT) % 10 AS VARCHAR) END AS state,
        CASE WHEN event_type <> 'error' THEN CAST(CAST(floor(value / 10) AS INT) AS VARCHAR) END AS prior, CASE WHEN event_type = 'signup' THEN 'event' ELSE event_type END AS type FROM events),
    p AS (SELECT *, lag(ord) OVER (PARTITION BY model ORDER BY ord) AS previous FROM l),
    j AS (SELECT p.model, p.ord, p.state, p.prior, p.type, p.previous, MAX(s.ord) AS source FROM p LEFT JOIN l s ON s.model = p.model AND s.state = p.prior AND s.ord <= p.ord GROUP BY ALL),
    k AS (SELECT *, CASE WHEN source IS NOT NULL THEN 'commitment-link' WHEN prior IS NOT NULL THEN 'external-prior' WHEN previous IS NOT NULL AND (state IS NOT NULL OR type <> 'event') THEN 'chronological-fallback' END AS kind FROM j)
    SELECT model, ord, CASE WHEN kind = 'commitment-link' THEN source WHEN kind = 'chronological-fallback' THEN previous END AS from_ord, kind FROM k WHERE kind IS NOT NULL"""


@registered(_CE.replace("CAST(CAST(value AS INT) % 10 AS VARCHAR)", "CAST(CAST(floor(value) AS INT) % 10 AS VARCHAR)"))
def continuity_edges(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("model"), F.col("event_id").alias("ord"),
        F.when(F.col("event_type").isin("click", "view"), (F.floor("value").cast("int") % 10).cast("string")).alias("state"),
        F.when(F.col("event_type") != "error", F.floor(F.col("value") / 10).cast("int").cast("string")).alias("prior"),
        F.when(F.col("event_type") == "signup", "event").otherwise(F.col("event_type")).alias("type"),
    )
    return lineage.continuity_edges(e)


@registered("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
    SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM b WHERE r <= 20""")
def audit_tail_n(spark, sf_dir):
    return metering.last_rows(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", 20)


@registered("""WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
    SELECT user_id, event_id, CASE WHEN b IS NULL THEN 'FIRST_OBSERVATION' WHEN b = event_type THEN 'UNCHANGED' ELSE 'CHANGED' END AS state FROM l""")
def watch_changed(spark, sf_dir):
    return lineage.changes(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("user_id", "event_id", "state")


@registered("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
    SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 95) THEN 'failed' WHEN bool_or(event_type = 'purchase') THEN 'ready' WHEN bool_or(event_type = 'click') THEN 'partial' ELSE 'none' END AS checkpoint
    FROM b WHERE r <= 20 GROUP BY 1""")
def status_inference(spark, sf_dir):
    last = metering.last_rows(table(spark, sf_dir, "events"), "user_id", "event_id", 20)
    has = lambda c: F.bool_or(c)
    t = F.col("event_type")
    return last.groupBy("user_id").agg(F.when(has((t == "error") & (F.col("value") > 95)), "failed").when(has(t == "purchase"), "ready").when(has(t == "click"), "partial").otherwise("none").alias("checkpoint"))


@registered("""WITH RECURSIVE r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events),
    t AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM r WHERE b <= 100),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, 'seed' AS acc FROM t GROUP BY 1 UNION ALL SELECT f.user_id, t.i, sha256(f.acc || '|' || t.event_type) FROM f JOIN t ON t.user_id = f.user_id AND t.i = f.i + 1),
    g AS (SELECT user_id, sha256(string_agg(event_type, '|' ORDER BY i)) AS root FROM t GROUP BY 1)
    SELECT f.user_id, arg_max(f.acc, f.i) AS accumulator, MAX(f.i) AS steps, any_value(g.root) AS root FROM f JOIN g USING (user_id) GROUP BY 1""")
def hash_chain_fold(spark, sf_dir):
    last = metering.last_rows(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", 100)
    return lineage.folded(last, ["user_id"], "seq", F.col("event_type"))


_CHAIN = """WITH RECURSIVE r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    c AS (SELECT user_id, event_id, i, sha256('seed|' || event_type) AS h FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.event_id, r.i, sha256(c.h || '|' || r.event_type) FROM c JOIN r ON r.user_id = c.user_id AND r.i = c.i + 1),"""


@registered(_CHAIN + """ t AS (SELECT user_id, i, CASE WHEN event_id % 17 = 0 THEN 'x' || substr(h, 2) ELSE h END AS h, h AS built FROM c), p AS (SELECT t.*, event_type, COALESCE(lag(t.h) OVER (PARTITION BY t.user_id ORDER BY t.i), 'seed') AS parent FROM t JOIN r USING (user_id, i))
    SELECT user_id, COUNT(*) AS links, COUNT(*) FILTER (WHERE h = sha256(parent || '|' || event_type)) AS valid_links, arg_max(built, i) AS head FROM p GROUP BY 1""")
def hash_chain_verify(spark, sf_dir):
    """Chains are built, every seventeenth link is changed, and all links are checked."""
    built = lineage.chained(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")
    changed = built.withColumn("hash", F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("x"), F.substring("built", 2, 63))).otherwise(F.col("built")))
    checked = lineage.chain_checked(changed, "user_id", "event_id", "event_type", "hash")
    return checked.groupBy("user_id").agg(F.count("*").alias("links"), F.count_if("valid").alias("valid_links"), F.max_by("built", "event_id").alias("head"))


def _merkle_sql() -> str:
    level = "l0 AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)"
    out = [level]
    for d in range(1, 7):
        p = f"l{d - 1}"
        out.append(f"l{d} AS (SELECT a.k, a.i // 2 AS i, CASE WHEN n.n > 1 THEN sha256(a.h || COALESCE(b.h, a.h)) ELSE a.h END AS h FROM {p} a JOIN (SELECT k, COUNT(*) AS n FROM {p} GROUP BY 1) n ON n.k = a.k LEFT JOIN {p} b ON b.k = a.k AND b.i = a.i + 1 WHERE a.i % 2 = 0)")
    return "WITH " + ", ".join(out) + " SELECT l6.k AS o_custkey, l6.h AS root, CAST(c.n AS INT) AS leaves FROM l6 JOIN (SELECT k, COUNT(*) AS n FROM l0 GROUP BY 1) c ON c.k = l6.k"


@registered(_merkle_sql())
def merkle_levels(spark, sf_dir):
    leaves = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("leaf"))
    return lineage.merkle_root(leaves, "o_custkey", "o_orderkey", "leaf")


@registered("""SELECT o_custkey, sha256(string_agg(sha256(CAST(o_totalprice AS VARCHAR)), ':' ORDER BY o_orderkey)) AS root, COUNT(*) AS links
    FROM (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice FROM orders) GROUP BY 1""")
def proof_chain_root(spark, sf_dir):
    link = F.struct("o_orderkey", F.sha2(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), 256).alias("h"))
    ordered = F.transform(F.array_sort(F.collect_list(link)), lambda x: x["h"])
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sha2(F.array_join(ordered, ":"), 256).alias("root"), F.count("*").alias("links"))


@registered("""SELECT COUNT(*) AS leaves, COUNT(*) FILTER (WHERE n.h <> r.h) AS mismatched, COUNT(*) FILTER (WHERE n.h IS NULL) AS missing,
    CASE WHEN COUNT(*) FILTER (WHERE n.h <> r.h) > 0 THEN 'TAMPERED' WHEN COUNT(*) FILTER (WHERE n.h IS NULL) > 0 THEN 'INCONCLUSIVE' ELSE 'PASS' END AS status
    FROM (SELECT p_partkey, sha256(p_name) AS h FROM part) r LEFT JOIN (SELECT p_partkey, sha256(CASE WHEN p_partkey % 100 = 3 THEN upper(p_name) ELSE p_name END) AS h FROM part WHERE p_partkey % 50 <> 0) n USING (p_partkey)""")
def sealed_leaves(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), "p_name")
    now = p.filter("name % 50 <> 0").select("name", F.sha2(F.when(F.col("name") % 100 == 3, F.upper("p_name")).otherwise(F.col("p_name")), 256).alias("hash"))
    return lineage.leaves_validated(p.select("name", F.sha2("p_name", 256).alias("hash")), now)


@registered("""SELECT COALESCE(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS status
    FROM (SELECT p_partkey, sha256(p_name) AS h FROM part WHERE p_partkey % 7 <> 0) a FULL JOIN (SELECT p_partkey, sha256(CASE WHEN p_size > 40 THEN p_type ELSE p_name END) AS h FROM part WHERE p_partkey % 11 <> 0) b USING (p_partkey)""")
def component_compare(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.filter("p_partkey % 7 <> 0").select("p_partkey", F.sha2("p_name", 256).alias("hash"))
    b = p.filter("p_partkey % 11 <> 0").select("p_partkey", F.sha2(F.when(F.col("p_size") > 40, F.col("p_type")).otherwise(F.col("p_name")), 256).alias("hash"))
    return lineage.compared(a, b, "p_partkey", "hash")


# --- chunk stores ---------------------------------------------------------------------------------------


def _chunks(spark, sf_dir) -> DataFrame:
    """Lines of documents as chunks."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.posexplode(F.split("text", "\n")).alias("offset", "line"))
    return d.select("ref", "offset", F.sha2("line", 256).alias("hash"), F.length("line").cast("long").alias("size"))


_CHUNKS = """c AS (SELECT doc_id AS ref, sha256(line) AS hash, length(line) AS size FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))"""


@registered(f"""WITH {_CHUNKS}, a AS (SELECT DISTINCT hash, size FROM c WHERE ref % 2 = 0), b AS (SELECT DISTINCT hash, size FROM c WHERE ref % 2 = 1),
    j AS (SELECT a.size AS sa, b.size AS sb FROM a FULL JOIN b USING (hash)),
    t AS (SELECT COUNT(*) FILTER (WHERE sa IS NOT NULL AND sb IS NOT NULL) AS shared, COUNT(*) FILTER (WHERE sb IS NULL) AS removed, COUNT(*) FILTER (WHERE sa IS NULL) AS new,
        COALESCE(SUM(sa) FILTER (WHERE sb IS NOT NULL), 0) AS shared_bytes, COUNT(*) AS e FROM j)
    SELECT shared, removed, new, CAST(shared_bytes AS BIGINT) AS shared_bytes, CAST(shared AS DOUBLE) / e AS jaccard, round(1 - CAST(shared AS DOUBLE) / e, 6) AS drift FROM t""")
def chunk_jaccard(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return chunks.pair_drift(c.filter("ref % 2 = 0").select("hash", "size").distinct(), c.filter("ref % 2 = 1").select("hash", "size").distinct())


@registered("""WITH o AS (SELECT l_orderkey % 4 AS base, 'v' || (l_linenumber % 3) AS version, l_partkey AS hash FROM lineitem GROUP BY ALL),
    f AS (SELECT base, MIN(version) AS baseline FROM o GROUP BY 1), n AS (SELECT base, version, COUNT(*) AS n FROM o GROUP BY ALL),
    s AS (SELECT o.base, o.version, COUNT(*) AS shared FROM o JOIN f USING (base) JOIN o b ON b.base = o.base AND b.version = f.baseline AND b.hash = o.hash GROUP BY ALL)
    SELECT n.base, f.baseline, n.version, COALESCE(s.shared, 0) AS shared, CAST(COALESCE(s.shared, 0) AS DOUBLE) / (n.n + nb.n - COALESCE(s.shared, 0)) AS jaccard, 1 - CAST(COALESCE(s.shared, 0) AS DOUBLE) / (n.n + nb.n - COALESCE(s.shared, 0)) AS drift
    FROM n JOIN f USING (base) JOIN n nb ON nb.base = n.base AND nb.version = f.baseline LEFT JOIN s ON s.base = n.base AND s.version = n.version WHERE n.version <> f.baseline""")
def baseline_gate(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4).alias("base"), F.concat(F.lit("v"), F.col("l_linenumber") % 3).alias("version"), F.col("l_partkey").alias("hash")).distinct()
    return chunks.baseline_drift(sets)


@registered(f"""WITH {_CHUNKS}, o AS (SELECT DISTINCT hash FROM c WHERE ref % 2 = 0)
    SELECT CASE WHEN o.hash IS NULL THEN 'inline' ELSE 'reuse' END AS op, COUNT(*) AS n, CAST(SUM(size) AS BIGINT) AS bytes FROM c LEFT JOIN o USING (hash) WHERE ref % 2 = 1 GROUP BY 1""")
def chunk_delta_semi(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return chunks.delta_plan(c.filter("ref % 2 = 1"), c.filter("ref % 2 = 0")).groupBy("op").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@registered(f"""WITH {_CHUNKS}, o AS (SELECT DISTINCT hash FROM c WHERE ref % 2 = 0),
    t AS (SELECT CAST(SUM(size) AS BIGINT) AS nb, CAST(COALESCE(SUM(size) FILTER (WHERE o.hash IS NOT NULL), 0) AS BIGINT) AS rb FROM c LEFT JOIN o USING (hash) WHERE ref % 2 = 1)
    SELECT nb AS new_bytes, rb AS reused_bytes, CAST(rb AS DOUBLE) / nb AS overlap, CASE WHEN CAST(rb AS DOUBLE) / nb >= 0.25 AND rb > 0 THEN 'chunk' WHEN floor(nb * 0.6::DOUBLE + 0.5) < nb - rb THEN 'bsdiff' ELSE 'chunk' END AS strategy FROM t""")
def delta_strategy(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return chunks.delta_strategy(chunks.delta_plan(c.filter("ref % 2 = 1"), c.filter("ref % 2 = 0")))


@registered(f"""WITH {_CHUNKS}, m AS (SELECT DISTINCT hash FROM c WHERE ref % 10 < 7), s AS (SELECT DISTINCT hash, size FROM c)
    SELECT COUNT(*) FILTER (WHERE m.hash IS NULL) AS missing, CAST(COALESCE(SUM(size) FILTER (WHERE m.hash IS NULL), 0) AS BIGINT) AS missing_bytes, CAST(COUNT(m.hash) AS DOUBLE) / COUNT(*) AS sync_ratio FROM s LEFT JOIN m USING (hash)""")
def mirror_anti(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return chunks.mirror_delta(c.select("hash", "size").distinct(), c.filter("ref % 10 < 7"))


@registered(f"WITH {_CHUNKS} SELECT DISTINCT hash, size FROM c WHERE hash NOT IN (SELECT hash FROM c WHERE ref % 10 < 7)")
def gc_anti(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return chunks.unreferenced(c.select("hash", "size").distinct(), c.filter("ref % 10 < 7"))


@registered(f"""WITH {_CHUNKS}, k AS (SELECT hash, MIN(size) AS stored, SUM(size) AS logical, COUNT(*) AS refs FROM c GROUP BY 1)
    SELECT COUNT(*) AS chunks, CAST(SUM(refs) AS BIGINT) AS refs, CAST(SUM(logical) AS BIGINT) AS logical_bytes, CAST(SUM(stored) AS BIGINT) AS stored_bytes, CAST(SUM(logical) AS DOUBLE) / SUM(stored) AS dedupe_ratio FROM k""")
def dedupe_ratio(spark, sf_dir):
    return chunks.store_stats(_chunks(spark, sf_dir))


@registered("""SELECT p_brand, p_partkey, row_number() OVER w AS position, COALESCE(SUM(p_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)""")
def pack_layout(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("size"))
    return chunks.layout(p, ["size", "p_partkey"], "p_brand").select("p_brand", "p_partkey", "position", "offset")


def _cdc_sql() -> str:
    gear = ", ".join(str(g % 512) for g in chunks.gear_table())
    low = " + ".join(f"{1 << k} * COALESCE(lag(g, {k}) OVER w, 0)" if k else "g" for k in range(9))
    return f"""WITH RECURSIVE x AS (SELECT CAST(doc_id AS VARCHAR) AS ref, hex(encode(COALESCE(text, ''))) AS h FROM documents), t AS (SELECT [{gear}] AS t),
        q AS (SELECT ref, j, substr(h, 1000 * j + 1, 1000) AS piece FROM (SELECT ref, h, unnest(range(0, (CAST(length(h) / 2 AS BIGINT) + 499) // 500)) AS j FROM x)),
        b AS (SELECT ref, 500 * j + k AS p, (SELECT t FROM t)[CAST('0x' || substr(piece, 2 * k - 1, 2) AS INT) + 1] AS g FROM (SELECT ref, j, piece, unnest(range(1, CAST(length(piece) / 2 AS BIGINT) + 1)) AS k FROM q)),
        c AS (SELECT ref, p FROM (SELECT ref, p, ({low}) % 512 AS v FROM b WINDOW w AS (PARTITION BY ref ORDER BY p)) WHERE v = 0),
        l AS (SELECT ref, list(p ORDER BY p) AS cuts FROM c GROUP BY 1), n AS (SELECT x.ref, CAST(length(h) / 2 AS BIGINT) AS n, COALESCE(cuts, []::BIGINT[]) AS cuts FROM x LEFT JOIN l USING (ref)),
        r AS (SELECT ref, 0 AS i, 0::BIGINT AS s, CASE WHEN n = 0 THEN 0 ELSE COALESCE(list_min(list_filter(cuts, lambda p: p >= 256 AND p <= least(1024, n))), least(1024, n)) END AS e FROM n
            UNION ALL SELECT r.ref, i + 1, r.e, COALESCE(list_min(list_filter(cuts, lambda p: p >= r.e + 256 AND p <= least(r.e + 1024, n))), least(r.e + 1024, n)) FROM r JOIN n USING (ref) WHERE r.e < n)
        SELECT ref, CAST(i AS INT) AS index, s AS "offset", e - s AS length, sha256(unhex(substr(h, 2 * s + 1, 2 * (e - s)))) AS hash FROM r JOIN x USING (ref)"""


@registered(_cdc_sql())
def cdc_chunks(spark, sf_dir):
    blobs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    return chunks.chunked(blobs, least=256, target=1024, most=4096, bits=9)


@registered("""SELECT CAST(doc_id AS VARCHAR) AS ref, sha256(COALESCE(text, '')) AS sha, octet_length(encode(COALESCE(text, ''))) AS bytes FROM documents""")
def delta_roundtrip(spark, sf_dir):
    """Chunks, sliced while they are cut, joined back by order give the documents again."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    made = chunks.chunked(d, data=True, least=256, target=1024, most=4096, bits=9)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("index", F.hex("data").alias("h")))), lambda x: x["h"])
    return made.groupBy("ref").agg(F.sha2(F.unhex(F.array_join(ordered, "")), 256).alias("sha"), F.sum("length").alias("bytes"))


# --- text -------------------------------------------------------------------------------------------------


@registered("SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS lines, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '^#{1,6} '))) AS headings FROM documents")
def text_profile(spark, sf_dir):
    p = text.profile("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"), *[p[c].alias(c) for c in ("chars", "lines", "words", "headings")]).drop("n").select("doc_id", *[F.col(c).cast("long") for c in ("chars", "lines", "words", "headings")])


@registered("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type || ' / ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat("p_type", F.lit(" / "), "p_name", F.lit("!"))).alias("slug"))


@registered(f"""SELECT conv_id, turn, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, '{text.WHITE_SPACE}')), lambda s: s <> '')) AS sentences FROM conversations""")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.sentences(F.col("text"))).cast("long").alias("sentences"))


@registered("""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?\\n]+'), lambda s: trim(s, chr(10) || ' ')), lambda s: length(s) BETWEEN 30 AND 80) AS c FROM documents)
    SELECT doc_id, CAST(i AS INT) AS clip_id, c[i] AS clip, 'sha256:' || substr(sha256(c[i]), 1, 13) AS clip_hash FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM t)""")
def clip_extract(spark, sf_dir):
    return text.clips(table(spark, sf_dir, "documents"), "doc_id", "text", 30, 80)


_FILLERS = "(?i)\\b(um|uh|er)\\b"


@registered(f"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, '{text.WHITE_SPACE}')), lambda s: s <> '') AS l FROM conversations)
    SELECT conv_id, turn, array_to_string(list_filter(list_transform(list_filter(l, lambda s, i: list_position(l, s) = i), lambda s: trim(regexp_replace(regexp_replace(regexp_replace(s, '(?i)\\[inaudible\\]', '…', 'g'), '\\s+', ' ', 'g'), '{_FILLERS}', '', 'g'), '{text.WHITE_SPACE}')), lambda s: s <> ''), chr(10)) AS cleaned FROM l""")
def transcript_clean(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(text.transcript_lines(F.col("text")), "\n").alias("cleaned"))


@registered()
def paragraph_reflow(spark, sf_dir):
    return text.reflowed(table(spark, sf_dir, "documents"), "doc_id", "text", 72)


@registered("SELECT page_id, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, regexp_replace(trim(regexp_replace(url, '[/?=&]+', ' ', 'g')), ' +', ' ', 'g') AS squeezed FROM pages")
def page_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_escaped(F.col("url")).alias("escaped"), text.squeezed(F.regexp_replace("url", "[/?=&]+", " ")).alias("squeezed"))


@registered("SELECT b.item_id, COUNT(d.doc_id) AS documents FROM benchmark b LEFT JOIN (SELECT DISTINCT doc_id, sha256(unnest(string_split(text, chr(10)))) AS h FROM documents) d ON d.h = sha256(b.text) GROUP BY 1")
def benchmark_containment(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.sha2("line", 256).alias("h")).distinct()
    b = table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("h"))
    return b.join(lines, "h", "left").groupBy("item_id").agg(F.count("doc_id").alias("documents"))


@registered("""SELECT event_id AS key, replace(props, ' ', '') AS canonical, sha256(replace(props, ' ', '')) AS canonical_hash FROM events""")
def canonical_json_hash(spark, sf_dir):
    return jsonish.hashed(table(spark, sf_dir, "events"), "event_id", "props")


@registered("""WITH e AS (SELECT event_id AS key, json_extract_string(props, '$.k') AS k, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS v, event_type FROM events)
    SELECT key, '$.k' AS path, 'replace' AS op, k AS old, v AS new FROM e WHERE k <> v UNION ALL SELECT key, '$.t', 'add', NULL, '"' || event_type || '"' FROM e""")
def json_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props", F.concat(F.lit('{"k": '), F.floor("value").cast("string"), F.lit(', "t": "'), "event_type", F.lit('"}')).alias("other"))
    return jsonish.compared(e, "event_id", "props", "other")


# --- vectors and tensors --------------------------------------------------------------------------------


@registered("SELECT p_partkey, sha256(p_name) AS base, CAST(('0x' || substr(sha256(unhex(sha256(p_name)) || unhex('00')), 1, 4)) AS INT) AS first_word FROM part")
def embed_base(spark, sf_dir):
    base = F.sha2("p_name", 256)
    return table(spark, sf_dir, "part").select("p_partkey", base.alias("base"), F.conv(F.substring(F.sha2(F.concat(F.unhex(base), F.unhex(F.lit("00"))), 256), 1, 4), 16, 10).cast("int").alias("first_word"))


@registered("""WITH b AS (SELECT p_partkey, unhex(sha256(p_name)) AS base FROM part),
    r AS (SELECT p_partkey, list_transform(range(0, 64), lambda i: round(CAST('0x' || substr(sha256(base || unhex(lpad(hex(i), 2, '0'))), 1, 4) AS INT) / 65535::DOUBLE * 2 - 1, 6)) AS r FROM b)
    SELECT p_partkey, list_transform(r, lambda x: round(x / sqrt(list_sum(list_transform(r, lambda y: y * y))), 6)) AS vector FROM r""")
def embed_text_64d(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", vectors.embedded(F.col("p_name")).alias("vector"))


_EVERY_50TH = "(SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0)"


@registered(f"""WITH s AS (SELECT query, vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings CROSS JOIN {_EVERY_50TH})
    SELECT query, vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10""")
def vec_topk_cosine(spark, sf_dir):
    """The ten best of every 50th vector; rows without a cell are scored by their cosine alone."""
    e = table(spark, sf_dir, "embeddings")
    store = e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), F.lit(None).cast("array<double>").alias("cell"), F.lit(None).cast("double").alias("residual"))
    best = vectors.blended_each(store, store.filter("key % 50 = 0").withColumn("cell", F.array_repeat(F.lit(0.0), 8)), 10)
    return best.join(e.select(F.col("vec_id").alias("key"), "label"), "key").select("query", F.col("key").alias("vec_id"), "label", "score")


def _points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 8).alias("point"))


_POINT = "list_transform(range(1, 9), lambda i: embedding[i]::DOUBLE * 8)"
_LISTS = """e AS (SELECT vec_id AS key, embedding, {point} AS x FROM embeddings),
    w AS (SELECT *, list_transform(x, lambda v: floor(v + 0.5)) AS z, list_transform(x, lambda v: v - 0.5 - floor(v)) AS unused, list_transform(x, lambda v: floor(v - 0.5 + 0.5)) AS y FROM e),
    g AS (SELECT *, list_transform(range(1, 9), lambda i: x[i] - z[i]) AS gz, list_transform(range(1, 9), lambda i: x[i] - 0.5 - y[i]) AS gy FROM w),
    a AS (SELECT *, list_position(list_transform(gz, lambda v: abs(v)), list_max(list_transform(gz, lambda v: abs(v)))) AS iz, list_position(list_transform(gy, lambda v: abs(v)), list_max(list_transform(gy, lambda v: abs(v)))) AS iy FROM g),
    f AS (SELECT *, list_transform(range(1, 9), lambda i: z[i] + CASE WHEN i = iz AND CAST(list_sum(z) AS BIGINT) % 2 <> 0 THEN CASE WHEN gz[i] >= 0 THEN 1 ELSE -1 END ELSE 0 END) AS whole,
        list_transform(range(1, 9), lambda i: y[i] + 0.5 + CASE WHEN i = iy AND CAST(list_sum(y) AS BIGINT) % 2 <> 0 THEN CASE WHEN gy[i] >= 0 THEN 1 ELSE -1 END ELSE 0 END) AS half FROM a),
    d AS (SELECT *, list_sum(list_transform(range(1, 9), lambda i: (x[i] - whole[i]) * (x[i] - whole[i]))) AS dw, list_sum(list_transform(range(1, 9), lambda i: (x[i] - half[i]) * (x[i] - half[i]))) AS dh FROM f),
    s AS (SELECT key, embedding::DOUBLE[] AS vector, CASE WHEN dh < dw THEN half ELSE whole END AS cell, round(sqrt(least(dw, dh)), 8) AS residual FROM d),
    c AS (SELECT *, array_to_string(list_transform(cell, lambda v: CASE WHEN v <> floor(v) THEN CAST(CAST(2 * v AS BIGINT) AS VARCHAR) || 'h' ELSE CAST(CAST(v AS BIGINT) AS VARCHAR) END), ',') AS cell_key FROM s)""".replace("{point}", _POINT).replace("list_transform(x, lambda v: v - 0.5 - floor(v)) AS unused, ", "")


@registered(f"WITH {_LISTS} SELECT key, cell, cell_key, residual FROM c")
def e8_snap(spark, sf_dir):
    return vectors.snapped(_points(spark, sf_dir), "vec_id", "point")


@registered(f"""WITH {_LISTS}, p AS (SELECT q.key AS query, r.key, r.cell_key, list_cosine_similarity(r.vector, q.vector) AS cos, r.residual,
        list_sum(list_transform(range(1, 9), lambda i: (r.cell[i] - q.cell[i]) * (r.cell[i] - q.cell[i]))) AS d FROM c r CROSS JOIN (SELECT * FROM c WHERE key % 50 = 0) q),
    b AS (SELECT query, key, cell_key, round(0.8::DOUBLE * cos + 0.15::DOUBLE * CASE WHEN d = 0 THEN 1 WHEN d = 2 THEN 0.8 WHEN d = 4 THEN 0.5 WHEN d <= 8 THEN 0.2 ELSE 0 END + 0.05::DOUBLE * (1 - least(1, residual / 2)), 6) AS score FROM p)
    SELECT query, key, cell_key, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS r FROM b) WHERE r <= 10""")
def vec_topk_blended(spark, sf_dir):
    p = _points(spark, sf_dir)
    store = vectors.snapped(p, "vec_id", "point").join(p.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), "key")
    best = vectors.blended_each(store, store.filter("key % 50 = 0"), 10)
    return best.join(store.select("key", "cell_key"), "key").select("query", "key", "cell_key", "score")


@registered("""SELECT vec_id, round(list_avg(e), 6) AS mean, round(sqrt(greatest(list_sum(list_transform(e, lambda x: x * x)) / len(e) - list_avg(e) * list_avg(e), 0)), 6) AS stddev, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS l2,
    round(list_avg(list_transform(e, lambda x: abs(x))), 6) AS mean_abs, list_max(list_transform(e, lambda x: abs(x))) AS max_abs, list_sort(list_transform(e, lambda x: abs(x)))[CAST(floor((len(e) - 1) * 0.5) AS INT) + 1] AS p50, list_sort(list_transform(e, lambda x: abs(x)))[CAST(floor((len(e) - 1) * 0.95) AS INT) + 1] AS p95
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def vector_stats(spark, sf_dir):
    s = tensors.vector_stats(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(s[k], 6).alias(k) for k in ("mean", "stddev", "l2", "mean_abs")], *[s[k].alias(k) for k in ("max_abs", "p50", "p95")])


@registered("""SELECT vec_id, CAST(floor(power(list_sum(list_transform(e, lambda x: x * x)), 2) / list_sum(list_transform(e, lambda x: x * x * x * x)) + 0.5) AS BIGINT) AS effective_rank FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def effective_rank(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", tensors.effective_rank(F.col("embedding")).alias("effective_rank"))


@registered("""SELECT event_id, user_id, round(CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) / COUNT(*) OVER w, 6) AS average FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING)""")
def moving_average_16(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(-16, 16)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.sum(F.col("value").cast("decimal(18,2)")).over(w).cast("double") / F.count("*").over(w), 6).alias("average"))


@registered("""WITH b AS (SELECT vec_id, unnest(range(1, 65)) AS i, embedding::DOUBLE[] AS e FROM embeddings)
    SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: power(list_avg(e[greatest(i - 16, 1):least(i + 16, 64)]), 2))), 6) AS low_energy FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def low_pass_energy(spark, sf_dir):
    low = tensors.moving_average(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(low, F.lit(0.0), lambda s, x: s + x * x), 6).alias("low_energy"))


_ENERGIES = """l AS (SELECT vec_id AS key, e, list_transform(range(1, len(e) + 1), lambda i: list_avg(e[greatest(i - 16, 1):least(i + 16, len(e))])) AS low FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
    r AS (SELECT key, e, low, list_transform(range(1, len(e) + 1), lambda i: e[i] - low[i]) AS rest, list_sort(list_transform(e, lambda v: abs(v))) AS a FROM l),
    n AS (SELECT *, list_sum(list_transform(low, lambda v: v * v)) AS el, list_sum(list_transform(rest, lambda v: v * v)) AS er, list_sum(list_transform(e, lambda v: v * v)) AS two, list_sum(list_transform(e, lambda v: v * v * v * v)) AS four,
        a[CAST(floor((len(a) - 1) * 0.5) AS INT) + 1] AS p50, a[CAST(floor((len(a) - 1) * 0.95) AS INT) + 1] AS p95, list_sum(list_transform(range(1, len(e) + 1), lambda i: low[i] * rest[i])) AS lr FROM r)"""


@registered(f"""WITH {_ENERGIES} SELECT key, round(el / greatest(el + er, 1e-12), 6) AS eta_low, round(er / greatest(el + er, 1e-12), 6) AS eta_rest, round((p95 + 1e-12) / (p50 + 1e-12), 4) AS spectral_gap,
    greatest(1, CAST(floor(two * two / greatest(four, 1e-12) + 0.5) AS BIGINT)) AS effective_rank, CAST(least(8, floor(len(list_filter(e, lambda v: abs(v) < 1e-8)) / len(e) * 32 + 0.5)) AS BIGINT) AS ghost_rank, round(sqrt(two), 6) AS norm,
    CASE WHEN el / greatest(el + er, 1e-12) < 0.06 THEN 'residual-heavy' WHEN el / greatest(el + er, 1e-12) > 0.20 THEN 'lowrank-heavy' ELSE 'balanced' END AS kind,
    'pass' AS energy_closure, CASE WHEN abs(lr) / greatest(1e-9, sqrt(el) * sqrt(er)) < 0.05 THEN 'pass' ELSE 'fail' END AS subspace_compatibility FROM n""")
def block_inspect(spark, sf_dir):
    return tensors.inspected(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


_SQUARES = """m AS (SELECT vec_id // 4 AS block, list(embedding::DOUBLE[] ORDER BY vec_id) AS l FROM embeddings GROUP BY 1), s AS (SELECT block, flatten(l) AS a FROM m WHERE len(l) = 4)"""


@registered(f"""WITH {_SQUARES}, p AS (SELECT x.block, x.a AS a, y.a AS b FROM s x JOIN s y ON y.block = x.block + 1),
    g AS (SELECT p.block, a, b, i, j FROM p, range(0, 16) r(i), range(0, 16) c(j)),
    ab AS (SELECT block, i, j, list_sum(list_transform(range(0, 16), lambda k: a[16 * i + k + 1] * b[16 * k + j + 1])) AS x, list_sum(list_transform(range(0, 16), lambda k: b[16 * i + k + 1] * a[16 * k + j + 1])) AS y FROM g),
    t AS (SELECT block AS key, sqrt(SUM((x - y) * (x - y))) / (sqrt(SUM(x * x)) + sqrt(SUM(y * y))) AS c FROM ab GROUP BY 1)
    SELECT key, round(c, 9) AS commutator, c < 0.05 AS safe FROM t""")
def commutator(spark, sf_dir):
    """Four vectors make a matrix of sixteen rows; each matrix against the next one."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("block"), F.struct("vec_id", "embedding").alias("v"))
    m = e.groupBy("block").agg(F.array_sort(F.collect_list("v")).alias("l")).filter("size(l) = 4").select("block", F.flatten(F.transform("l", lambda v: v["embedding"])).alias("a"))
    pairs = m.join(m.select((F.col("block") - 1).alias("block"), F.col("a").alias("b")), "block")
    return tensors.commuted(pairs, "block", "a", "b").withColumn("commutator", F.round("commutator", 9))


@registered("""WITH c AS (SELECT p_partkey, [{'cost': p_size * 8.0, 'r': 0, 'n': 'dense'}, {'cost': p_size * 2.0 + 40, 'r': 1, 'n': 'lowrank'}, {'cost': p_size * 4.0 + 10, 'r': 2, 'n': 'sparse'}] AS o FROM part)
    SELECT p_partkey, list_sort(o)[1].n AS family FROM c""")
def operator_plan(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", tensors.cheapest([("dense", s * 8.0), ("lowrank", s * 2.0 + 40), ("sparse", s * 4.0 + 10)]).alias("family"))


@registered("""WITH h AS (SELECT page_id, hex(encode(url)) AS x FROM pages), b AS (SELECT page_id, unnest(list_transform(range(0, CAST(length(x) / 2 AS BIGINT)), lambda i: substr(x, 2 * i + 1, 2))) AS b FROM h),
    c AS (SELECT page_id, b, COUNT(*) AS n FROM b GROUP BY ALL), t AS (SELECT page_id, SUM(n) AS t FROM c GROUP BY 1)
    SELECT page_id, CAST(t AS BIGINT) AS bytes, round(-SUM(n / t * log2(n / t)), 4) AS entropy FROM c JOIN t USING (page_id) GROUP BY page_id, t""")
def entropy(spark, sf_dir):
    return tensors.entropy_bits(table(spark, sf_dir, "pages"), "page_id", "url")


# --- sessions, continuity, routing ---------------------------------------------------------------------

_SIDE = "(SELECT DISTINCT sha256(text) AS step FROM conversations WHERE conv_id % 2 = {})"


@registered(f"""SELECT COALESCE(a.step, b.step) AS step, CASE WHEN a.step IS NOT NULL AND b.step IS NOT NULL THEN 'common' WHEN a.step IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS side
    FROM {_SIDE.format(0)} a FULL JOIN {_SIDE.format(1)} b USING (step)""")
def session_diff(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.sha2("text", 256).alias("step"))
    return planning.session_diff(c.filter("conv_id % 2 = 0"), c.filter("conv_id % 2 = 1"), "step")


@registered("""WITH c AS (SELECT conv_id, turn, sha256(text) AS step FROM conversations), o AS (SELECT n.conv_id, c.turn, c.step FROM (SELECT DISTINCT conv_id FROM c) n JOIN c ON c.conv_id = n.conv_id - 1),
    u AS (SELECT conv_id, 0 AS part, turn, step FROM o UNION ALL SELECT conv_id, 1, turn, step FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.conv_id = c.conv_id AND o.step = c.step))
    SELECT conv_id, part, turn, step, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY part, turn, step) AS INT) AS new_order FROM u""")
def session_rebase(spark, sf_dir):
    """Every conversation onto the one before it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("step"))
    onto = c.withColumn("conv_id", F.col("conv_id") + 1).join(c.select("conv_id").distinct(), "conv_id", "left_semi")
    return planning.rebased(c, onto, "conv_id", "step", "turn")


_CHART_OF = {"click": "geo_runtime", "view": "memory", "purchase": "execution_batch", "signup": "generic", "error": "liquidity_topology"}


def _moves(spark, sf_dir) -> DataFrame:
    """Each user's events as states: the type is the chart, a tenth of the value the residual."""
    value = F.col("value").cast("decimal(18,2)").cast("double")
    chart = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _CHART_OF.items() for x in kv]), F.col("event_type")), F.lit("text_proof"))
    cell = F.array(*[(F.shiftright("event_id", i) % 2).cast("double") for i in range(8)])
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("ord"), chart.alias("chart"), (value / 80).alias("residual"), F.when(F.col("event_id") % 5 != 0, cell).alias("cell"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("commitment"), F.when(F.col("event_id") % 7 != 0, F.sha2("event_type", 256)).alias("witness"), F.when(F.col("event_id") % 11 == 0, "space.state").otherwise("event").alias("type"),
    )
    return continuity.transitions(e, ["key"], "ord")


def _quoted(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _moves_sql() -> str:
    chart = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CHART_OF.items()) + " ELSE 'text_proof' END"
    bands = ", ".join(f"('{c}', {a}::DOUBLE, {b}::DOUBLE, {d}::DOUBLE)" for c, (a, b, d) in BANDS.items())
    return f"""WITH e AS (SELECT user_id AS key, event_id AS ord, {chart} AS chart, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) / 80 AS residual, event_id % 5 <> 0 AS placed,
        event_id % 7 <> 0 AS witnessed, event_id % 11 = 0 AS space FROM events),
    l AS (SELECT *, lag(ord) OVER w AS p_ord, lag(chart) OVER w AS p_chart, lag(residual) OVER w AS p_residual, lag(placed) OVER w AS p_placed, lag(witnessed) OVER w AS p_witnessed, lag(space) OVER w AS p_space FROM e WINDOW w AS (PARTITION BY key ORDER BY ord)),
    b AS (SELECT * FROM (VALUES {bands}) v(c, stable, boundary, novel)),
    d AS (SELECT l.*, round(residual - p_residual, 8) AS delta, CASE WHEN residual <= b.stable THEN 'stable' WHEN residual <= b.boundary THEN 'boundary' WHEN residual <= b.novel THEN 'novel' ELSE 'degraded' END AS band,
        bit_count(xor(ord % 256, p_ord % 256)) AS apart FROM l JOIN b ON b.c = CASE WHEN chart IN {_quoted(BANDS)} THEN chart ELSE 'default' END),
    i AS (SELECT *, p_ord IS NULL AS first, p_ord IS NULL OR p_chart <> chart OR chart = 'generic' OR p_chart = 'generic' OR space OR p_space OR NOT placed OR NOT p_placed OR apart <= 4.05 AS near FROM d),
    m AS (SELECT *, CASE WHEN first THEN 'INITIALIZED' WHEN p_chart <> chart THEN 'BOUNDARY_CROSSING' WHEN NOT witnessed OR band = 'degraded' OR NOT near THEN 'CONTINUITY_FAIL' WHEN delta > 0.2::DOUBLE OR band <> 'stable' THEN 'PASS_WITH_DRIFT' ELSE 'PASS' END AS class FROM i)"""


def _policy_sql() -> str:
    rows, moves = [], []
    for p in POLICIES:
        yes = lambda names, n: str(n in names).lower()
        rows.append(f"('{p.id}', {p.max_delta}::DOUBLE, {str(p.crossing).lower()}, {yes(p.required, 'neighborhood_preserved')}, {yes(p.required, 'prior_commitment_present')}, {yes(p.failing, 'witness_bound')}, {yes(p.failing, 'residual_bounded')}, {yes(p.failing, 'neighborhood_preserved')}, {yes(p.witnesses, 'prior_state_witness')})")
        moves += [f"('{p.id}', '{a}', {list(to)})" for a, to in p.moves.items()]
    return f"""{_moves_sql()}, p AS (SELECT * FROM (VALUES {', '.join(rows)}) v(policy, mx, crossing, need_near, need_prior, fail_witness, fail_residual, fail_near, prior_too)),
    g AS (SELECT * FROM (VALUES {', '.join(moves)}) v(g_policy, g_from, g_to)),
    v AS (SELECT key, ord, class, policy, (fail_witness AND NOT witnessed) OR (fail_residual AND band = 'degraded') OR (fail_near AND NOT first AND NOT near) AS failed,
        NOT witnessed OR (prior_too AND NOT first AND NOT p_witnessed) AS unwitnessed, coalesce(delta > mx, false) AS jumped, class = 'BOUNDARY_CROSSING' AND NOT crossing AS crossed,
        coalesce(p_chart <> chart AND g_to IS NOT NULL AND NOT list_contains(g_to, chart), false) AS moved FROM m CROSS JOIN p LEFT JOIN g ON g_policy = policy AND g_from = p_chart),
    s AS (SELECT *, failed OR unwitnessed OR jumped OR crossed OR moved AS bad, 0.35::DOUBLE * failed::INT + 0.25::DOUBLE * unwitnessed::INT + 0.2::DOUBLE * jumped::INT + 0.15::DOUBLE * crossed::INT + 0.15::DOUBLE * moved::INT AS r FROM v),
    t AS (SELECT policy, CASE WHEN bad THEN 'CONTINUITY_FAIL' WHEN class IN ('PASS_WITH_DRIFT', 'BOUNDARY_CROSSING', 'INITIALIZED') THEN class ELSE 'PASS' END AS verdict,
        CASE class WHEN 'PASS_WITH_DRIFT' THEN greatest(r, 0.25::DOUBLE) WHEN 'BOUNDARY_CROSSING' THEN greatest(r, 0.3::DOUBLE) ELSE r END AS r FROM s)
    SELECT policy, verdict, COUNT(*) AS n, round(SUM(CASE WHEN verdict IN ('PASS', 'INITIALIZED') THEN least(r, 0.1::DOUBLE) ELSE least(r, 1::DOUBLE) END), 4) AS risk FROM t GROUP BY ALL"""


@registered(_moves_sql() + " SELECT key, ord, band, delta, near, class FROM m")
def continuity_transitions(spark, sf_dir):
    near = F.coalesce(F.element_at(F.map_from_entries("invariants"), "neighborhood_preserved"), F.lit(True))
    return _moves(spark, sf_dir).select("key", "ord", "band", "delta", near.alias("near"), "class")


@registered(_policy_sql())
def policy_eval(spark, sf_dir):
    return continuity.judged(_moves(spark, sf_dir), POLICIES).groupBy("policy", "verdict").agg(F.count("*").alias("n"), F.round(F.sum("risk"), 4).alias("risk"))


@registered("""SELECT user_id, event_type, arg_max(value, event_id) AS value, MAX(event_id) AS event_id FROM events GROUP BY 1, 2""")
def space_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return continuity.latest(e, ["user_id", "event_type"], "event_id")


@registered("""WITH RECURSIVE s AS (SELECT p_partkey, 0 AS i, CAST(p_size AS DOUBLE) AS x, 1.0::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, i + 1, x + v * 0.5::DOUBLE, v + 2.0::DOUBLE / 4.0::DOUBLE * 0.5::DOUBLE FROM s WHERE i < 8)
    SELECT p_partkey, x, v FROM s WHERE i = 8""")
def physics_run(spark, sf_dir):
    end = continuity.euler(F.col("p_size"), F.lit(1.0), F.lit(2.0), F.lit(4.0), 0.5, 8)
    return table(spark, sf_dir, "part").select("p_partkey", end.alias("e")).select("p_partkey", "e.x", "e.v")


@registered(f"""WITH o AS (SELECT s_nationkey, s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE) / 100 AS cost, CAST(s_suppkey % 90 AS DOUBLE) AS latency, CAST(s_suppkey % 10 AS DOUBLE) / 10 AS quality, s_suppkey % 4 <> 0 AS cloud FROM supplier),
    e AS (SELECT *, latency <= 60 AND quality >= 0.3::DOUBLE AND cost <= 80 AS eligible, (80 - cost) / 80 * 50 + greatest(0::DOUBLE, (60 - latency) / 60 * 30) + (quality - 0.3::DOUBLE) * 10 AS s FROM o),
    g AS (SELECT *, {fixed_sql('CASE WHEN eligible THEN s ELSE 0::DOUBLE END + CASE WHEN cloud THEN 0::DOUBLE ELSE 5::DOUBLE END', 2)} AS score FROM e),
    f AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY eligible DESC, score DESC, s_suppkey) AS r, bool_or(eligible) OVER (PARTITION BY s_nationkey) AS any_eligible FROM g)
    SELECT s_nationkey, s_suppkey, score, any_eligible FROM f WHERE r = 1""")
def arb_route(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_acctbal").cast("decimal(18,2)").cast("double") / 100).alias("cost"), (F.col("s_suppkey") % 90).cast("double").alias("latency"), ((F.col("s_suppkey") % 10).cast("double") / 10).alias("quality"))
    ok, score = planning.route_score(F.col("cost"), F.col("latency"), F.col("quality"), F.col("s_suppkey") % 4 != 0, 80.0, 60.0, 0.3)
    return planning.routed(s.withColumns({"eligible": ok, "score": score}), "s_nationkey", "s_suppkey")


@registered("""SELECT p_partkey, p_name, CAST(len(list_filter(string_split(p_name, ' '), lambda f: contains(f, 'ring') OR contains('ring', f) OR contains(f, 'small') OR contains('small', f))) * 20 + CASE WHEN p_size <= 30 THEN 30 ELSE 0 END + CASE WHEN p_size <= 40 THEN 20 ELSE 0 END
    + CASE WHEN p_partkey % 3 = 0 THEN 15 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 10 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 0 END AS INT) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 15""")
def marketplace_topn(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("features"), F.col("p_size").alias("size"), (k % 3 == 0).alias("sae"), (k % 5 == 0).alias("memory_pack"), F.when(k % 2 == 0, "general").otherwise("code").alias("family"))
    return planning.marketplace(p, ["ring", "small"], 30, 40, 0.9, "p_partkey", 15).select("p_partkey", "p_name", "score")


@registered("""WITH f AS (SELECT p_brand, p_partkey, p_retailprice * 24 * 2 AS cost FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY cost, p_partkey) AS i FROM f)
    SELECT p_brand, p_partkey AS cheapest, round(cost, 2) AS cost FROM r WHERE i = 1""")
def cost_forecast(spark, sf_dir):
    best = F.min(F.struct((F.col("p_retailprice") * 24 * 2).alias("cost"), "p_partkey")).alias("b")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(best).select("p_brand", F.col("b.p_partkey").alias("cheapest"), F.round("b.cost", 2).alias("cost"))


@registered("""WITH s AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0),
    i AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS c_name, CASE WHEN c_custkey % 11 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 9 <> 0)
    SELECT COALESCE(s.c_custkey, i.c_custkey) AS c_custkey, CASE WHEN i.c_custkey IS NULL THEN 'missing' WHEN s.c_custkey IS NULL THEN 'extra' WHEN s.c_name = i.c_name AND s.c_mktsegment = i.c_mktsegment THEN 'identical'
    WHEN (s.c_name = i.c_name OR i.c_name = '') AND s.c_mktsegment = i.c_mktsegment THEN 'upgrade' ELSE 'conflict' END AS state FROM s FULL JOIN i USING (c_custkey)""")
def reconcile_full_outer(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    installed = c.filter("c_custkey % 9 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 11 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return planning.reconciled(c.filter("c_custkey % 10 <> 0"), installed, ["c_custkey"], ["c_name", "c_mktsegment"])


@registered("SELECT c.c_custkey, c.c_nationkey, COALESCE(n.n_name, 'hyper-delegated') AS state FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON n.n_nationkey = c.c_nationkey")
def matrix_lookup(spark, sf_dir):
    fixed = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state"))
    return planning.looked_up(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), fixed, "c_nationkey", "hyper-delegated").select("c_custkey", "c_nationkey", "state")


@registered("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, SUM(CAST(l_quantity AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS running FROM lineitem)
    SELECT l_orderkey, COUNT(*) AS regions, CAST(MAX(running) AS DOUBLE) AS used FROM r WHERE running <= 60 GROUP BY 1""")
def pull_region(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("size", F.col("l_quantity").cast("decimal(18,2)")).withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return planning.within_budget(rows, "l_orderkey", "o", "size", 60).groupBy("l_orderkey").agg(F.count("*").alias("regions"), F.max("running").cast("double").alias("used"))


@registered("SELECT COUNT(*) AS requested, COUNT(o.o_custkey) AS present, bool_and(o.o_custkey IS NOT NULL) AS complete FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o.o_custkey = c.c_custkey")
def distribute_bundle(spark, sf_dir):
    return planning.bundle(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name")), "name")


@registered("""SELECT p_partkey, round(0.5::DOUBLE * sqrt(2 * ln(125000.0::DOUBLE)) / p_size, 6) AS sigma, CASE WHEN p_size - 25 > 0 THEN greatest(0.70::DOUBLE, 0.98::DOUBLE - 0.06::DOUBLE * (p_size - 25)) ELSE 0.98::DOUBLE END AS fidelity FROM part""")
def noise_and_fidelity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(planning.gaussian_sigma(0.5, F.col("p_size"), 1e-5), 6).alias("sigma"), planning.fidelity(F.col("p_size") - 25).alias("fidelity"))


@registered("""WITH f AS (SELECT o_custkey, arg_min(o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS nx FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT o_orderkey, CASE WHEN o_orderkey = nx THEN 'claimed' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'done' END AS state FROM orders LEFT JOIN f USING (o_custkey)""")
def queue_work(spark, sf_dir):
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    tasks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("queue"), F.col("o_orderkey").alias("task_id"), at.alias("enqueued_at"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("state"))
    return streams.claimed(tasks).select(F.col("task_id").alias("o_orderkey"), "state")


# --- relational and streaming extensions -----------------------------------------------------------------


@registered("SELECT n_name, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_inner_rollup(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), metering.money_sum("o_totalprice").alias("total"))


@registered("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@registered("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@registered("SELECT e.event_id, (SELECT MAX(o.event_id) FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'signup' AND o.event_id <= e.event_id) AS last_signup FROM events e WHERE e.event_type = 'purchase'")
def join_as_of(spark, sf_dir):
    """As-of join by one window over both sides: no pairs are formed."""
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    return e.withColumn("last_signup", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w)).filter("event_type = 'purchase'").select("event_id", "last_signup")


@registered("SELECT o.o_orderkey, COUNT(e.event_id) AS events FROM orders o LEFT JOIN events e ON e.user_id = o.o_custkey AND e.value >= o.o_totalprice / 10000 AND e.value < o.o_totalprice / 10000 + 12 GROUP BY 1")
def join_range(spark, sf_dir):
    """A join on a key and a range: ranges are cut into bins of their width, so equal bins meet and no key's rows are all paired."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", "value", F.floor(F.col("value") / 12).alias("bin"))
    low = F.col("o_totalprice") / 10000
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), low.alias("low"))
    o2 = o.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / 12), F.floor((F.col("low") + 12) / 12))))
    hit = o2.join(e, ["k", "bin"]).filter((F.col("value") >= F.col("low")) & (F.col("value") < F.col("low") + 12))
    return o.join(hit.groupBy("o_orderkey").agg(F.count("*").alias("events")), "o_orderkey", "left").select("o_orderkey", F.coalesce("events", F.lit(0)).alias("events"))


@registered("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), metering.money_sum("l_quantity").alias("quantity"))


@registered("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@registered("SELECT s_suppkey, rank() OVER w AS rk, dense_rank() OVER w AS drk, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS quartile FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)")
def ranking_windows(spark, sf_dir):
    w = W.partitionBy("s_nationkey").orderBy("s_acctbal")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("drk"), F.ntile(4).over(W.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")).alias("quartile"))


@registered("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("k")))


@registered("SELECT k, CAST(GREATEST(a - b, 0) AS BIGINT) AS left_over FROM (SELECT n_nationkey AS k, (SELECT COUNT(*) FROM customer WHERE c_nationkey = n_nationkey) AS a, (SELECT COUNT(*) FROM supplier WHERE s_nationkey = n_nationkey) AS b FROM nation) WHERE a > b")
def set_except_all(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return a.exceptAll(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))).groupBy("k").agg(F.count("*").alias("left_over"))


@registered("SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, true AS sketch_is_near FROM lineitem GROUP BY 1")
def approx_distinct(spark, sf_dir):
    """The sketch beside the exact count; its stated relative deviation is 0.02, and four times that is allowed."""
    exact, sketch = F.count_distinct("l_partkey"), F.approx_count_distinct("l_partkey", 0.02)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(exact.alias("parts"), (F.abs(sketch - exact) <= 0.08 * exact).alias("sketch_is_near"))


@registered("SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf_dir):
    out = streams.windowed(table(spark, sf_dir, "events"), "ts", "event_type", "value", "6 hours")
    return out.select(metering.stamp("w.start").alias("window_start"), "event_type", "n", "total")


@registered("""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM (SELECT time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours' * i AS s, event_type, value FROM events, range(0, 2) r(i)) GROUP BY 1, 2""")
def sliding_window(spark, sf_dir):
    out = streams.windowed(table(spark, sf_dir, "events"), "ts", "event_type", "value", "12 hours", "6 hours")
    return out.select(metering.stamp("w.start").alias("window_start"), "event_type", "n", "total")


@registered("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '2 hours' THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, SUM(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS session_start, COUNT(*) AS n FROM s GROUP BY user_id, k""")
def session_window(spark, sf_dir):
    out = streams.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "2 hours")
    return out.select("user_id", metering.stamp("w.start").alias("session_start"), "n")


@registered("SELECT event_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE value > 90) AS breaches FROM events GROUP BY 1")
def service_breaches(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 90).alias("breaches"))


# --- planning formulas, gates and documents --------------------------------------------------------------


@registered("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / SUM(l_quantity) OVER (PARTITION BY l_orderkey), 9) AS weight FROM lineitem")
def ensemble_weights(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(formulas.normalized(F.col("l_quantity"), "l_orderkey"), 9).alias("weight"))


@registered("SELECT CAST(floor(p_size / 13.0) AS INT) AS part_no, MIN(p_size) AS first_layer, MAX(p_size) AS last_layer, COUNT(*) AS n FROM part GROUP BY 1")
def split_ranges(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("part_no", formulas.layer_bucket(F.col("p_size"), 51, 4))
    return p.groupBy("part_no").agg(F.min("p_size").alias("first_layer"), F.max("p_size").alias("last_layer"), F.count("*").alias("n"))


@registered("""WITH t AS (SELECT p_partkey, n_nationkey, round(p_size * CAST(n_nationkey % 10 AS DOUBLE) / 10, 3) AS cached_gb, p_size FROM part JOIN nation ON p_partkey % 25 = n_nationkey)
    SELECT p_partkey, n_nationkey, cached_gb, round(p_size - cached_gb, 3) AS transfer_gb, CAST(ceil(round(p_size - cached_gb, 3) * 1024 / 64) AS BIGINT) AS chunks FROM t""")
def cdn_plan(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("n_nationkey", (F.col("p_partkey") % 25).cast("int"))
    rows = p.join(table(spark, sf_dir, "nation"), "n_nationkey")
    t = formulas.transfer(F.col("p_size").cast("double"), (F.col("n_nationkey") % 10).cast("double") / 10, F.lit(0.02), 64.0)
    return rows.select("p_partkey", "n_nationkey", *[t[k].alias(k) for k in ("cached_gb", "transfer_gb", "chunks")])


@registered("SELECT event_id, CAST(ceil(value * 1000 / 250) AS BIGINT) AS chunks, CAST(floor(value) AS BIGINT) * 2 * 32 * 8 * 128 * 2 AS kv_bytes FROM events")
def stream_and_cache_sizes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", formulas.stream_chunks(F.col("value") * 1000, 250).alias("chunks"), formulas.cache_bytes(F.floor("value"), 32, 8, 128).alias("kv_bytes"))


@registered("SELECT o_orderkey, TIMESTAMP '1998-06-01' > o_orderdate + INTERVAL '48 hours' AS expired FROM orders")
def lease_expiry(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", formulas.expired(F.col("o_orderdate"), 48, F.lit("1998-06-01").cast("timestamp")).alias("expired"))


@registered("""SELECT p_partkey, CASE WHEN contains(p_type, 'ECONOMY') THEN 8 WHEN contains(p_type, 'PROMO') THEN 16 ELSE 4 END AS bits, round(0.25::DOUBLE / (2 * power(p_size, 2)), 9) AS rho, round(0.5::DOUBLE / p_size, 9) AS laplace FROM part""")
def quantize_and_noise(spark, sf_dir):
    kind = F.when(F.contains("p_type", F.lit("ECONOMY")), "embedding").when(F.contains("p_type", F.lit("PROMO")), "norm").otherwise("mlp")
    return table(spark, sf_dir, "part").select("p_partkey", formulas.quant_bits(kind).alias("bits"), F.round(formulas.zcdp(0.5, F.col("p_size")), 9).alias("rho"), F.round(formulas.laplace_scale(0.5, F.col("p_size")), 9).alias("laplace"))


@registered("""WITH a AS (SELECT p_brand, AVG(p_size) AS x FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), b AS (SELECT p_brand, AVG(p_size) AS y FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
    SELECT p_brand, round(y - x, 6) AS delta, row_number() OVER (ORDER BY abs(round(y - x, 6)) DESC, p_brand) AS rk FROM a JOIN b USING (p_brand)""")
def feature_drift(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mean = lambda k, n: p.filter(f"p_partkey % 2 = {k}").groupBy("p_brand").agg(F.avg("p_size").alias(n))
    d = mean(0, "x").join(mean(1, "y"), "p_brand").select("p_brand", F.round(F.col("y") - F.col("x"), 6).alias("delta"))
    return d.withColumn("rk", F.row_number().over(W.orderBy(F.abs("delta").desc(), "p_brand")))  # a row a brand


@registered("SELECT s_nationkey, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) AS adapters, COUNT(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def adapter_list(spark, sf_dir):
    ids = F.transform(F.array_sort(F.collect_list(F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))), lambda x: x.cast("long").cast("string"))
    return table(spark, sf_dir, "supplier").filter("s_acctbal > 0").groupBy("s_nationkey").agg(F.array_join(ids, ",").alias("adapters"), F.count("*").alias("n"))


@registered("SELECT c_custkey, n_name IS NOT NULL AS pinned, COALESCE(r_name, 'unpinned') AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2 LEFT JOIN region ON r_regionkey = n_regionkey")
def geo_pin(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_regionkey != 2").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.select("c_custkey", F.col("n_name").isNotNull().alias("pinned"), F.coalesce("r_name", F.lit("unpinned")).alias("region"))


@registered("""SELECT o_custkey, bool_and(o_totalprice > 0) AS has_value, bool_and(o_orderstatus IN ('F', 'O', 'P')) AS known_status, CASE WHEN COUNT(*) < 3 THEN 'INCONCLUSIVE' WHEN bool_and(o_totalprice > 1500) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM orders GROUP BY 1""")
def integrity_gate(spark, sf_dir):
    every = lambda c: F.every(c)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(every(F.col("o_totalprice") > 0).alias("has_value"), every(F.col("o_orderstatus").isin("F", "O", "P")).alias("known_status"), F.when(F.count("*") < 3, "INCONCLUSIVE").when(every(F.col("o_totalprice") > 1500), "PASS").otherwise("FAIL").alias("verdict"))


@registered("""SELECT conv_id, COUNT(*) AS steps, COUNT(*) FILTER (WHERE role = 'user') AS user_steps, sha256(string_agg(sha256(text), '|' ORDER BY turn)) AS session_hash FROM conversations GROUP BY 1""")
def session_state(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.sha2("text", 256).alias("h")))), lambda x: x["h"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("steps"), F.count_if(F.col("role") == "user").alias("user_steps"), F.sha2(F.array_join(ordered, "|"), 256).alias("session_hash"))


@registered("SELECT doc_id, 'sha256:' || sha256(text) AS artifact_id, length(text) AS size FROM documents")
def emit_artifact(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = sinks.artifacts(d, F.col("doc_id"), F.col("text"))
    return a.select(F.col("name").alias("doc_id"), "artifact_id", "size")


@registered("SELECT substr(sha256(text), 1, 2) AS prefix, COUNT(*) AS files, COUNT(DISTINCT sha256(text)) AS kinds FROM documents GROUP BY 1")
def ingest_layout(spark, sf_dir):
    h = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").groupBy(F.substring(h, 1, 2).alias("prefix")).agg(F.count("*").alias("files"), F.count_distinct(h).alias("kinds"))


@registered("SELECT doc_id AS key, octet_length(encode(coalesce(text, ''))) AS raw_bytes, sha256(coalesce(text, '')) AS restored, true AS smaller_where_long FROM documents")
def compress_family(spark, sf_dir):
    """Texts deflated and restored; long ones must shrink."""
    c = sinks.compressed(table(spark, sf_dir, "documents"), "doc_id", "text")
    return c.select("key", "raw_bytes", F.sha2(sinks.inflated(F.col("packed")), 256).alias("restored"), ((F.col("raw_bytes") < 400) | (F.length("packed") < F.col("raw_bytes"))).alias("smaller_where_long"))


@registered("""SELECT event_id AS key, '$.run[0]' AS path, '{"id":' || CAST(event_id AS VARCHAR) || ',"verdict":"CONTINUITY_FAIL"}' AS node FROM events WHERE event_type = 'error'""")
def fail_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"run": [{"id": '), F.col("event_id").cast("string"), F.lit(', "verdict": "'), F.when(F.col("event_type") == "error", "CONTINUITY_FAIL").otherwise("PASS"), F.lit('"}]}')).alias("doc"))
    return jsonish.found(e, "event_id", "doc", "verdict", "CONTINUITY_FAIL")


@registered("SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || 'Type ' || lower(p_type) || ', size ' || CAST(p_size AS VARCHAR) || '.' AS narration FROM part")
def narrate_brief(spark, sf_dir):
    body = F.concat(F.lit("Type "), F.lower("p_type"), F.lit(", size "), F.col("p_size").cast("string"), F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", text.narration(F.col("p_name"), body).alias("narration"))


@registered("""SELECT p_partkey, CASE WHEN contains(p_name, 'small') THEN 'tiny' WHEN contains(p_type, 'STANDARD') THEN 'standard' WHEN p_size > 40 THEN 'bulk' ELSE 'other' END AS kind FROM part""")
def classify_first_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.contains("p_name", F.lit("small")), "tiny").when(F.contains("p_type", F.lit("STANDARD")), "standard").when(F.col("p_size") > 40, "bulk").otherwise("other").alias("kind"))


@registered("""WITH RECURSIVE d AS (SELECT p_partkey AS step, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS dep FROM part),
    t AS (SELECT step, 0 AS depth FROM d WHERE dep IS NULL OR dep NOT IN (SELECT step FROM d) UNION ALL SELECT d.step, t.depth + 1 FROM d JOIN t ON d.dep = t.step) SELECT step, CAST(depth AS INT) AS depth FROM t""")
def pipeline_depth(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("step"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 2)).alias("dep"))
    return planning.depths(rows)


from . import records  # noqa: E402, F401  # registers its queries

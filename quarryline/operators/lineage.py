"""Ordered logs as graphs: nodes, edges, folds, chains and trees of hashes."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _sha(c: Column) -> Column:
    return F.sha2(c, 256)


def status(verdict: Column) -> Column:
    return F.when(verdict == "CONTINUITY_FAIL", "FAIL").when(verdict.isin("PASS_WITH_DRIFT", "BOUNDARY_CROSSING"), "WARN").when(verdict == "INITIALIZED", "INFO").otherwise("PASS")


def nodes(log: DataFrame, model: str, order: str, hash_: str, label: str) -> DataFrame:
    """Distinct hashes of each model numbered by first appearance, with their first row's label."""
    first = log.groupBy(model, hash_).agg(F.min(order).alias("first_ord"), F.min_by(label, order).alias("label"), F.count("*").alias("times"))
    return first.withColumn("node", F.row_number().over(W.partitionBy(model).orderBy("first_ord")) - 1)


def edges(log: DataFrame, model: str, order: str, hash_: str) -> DataFrame:
    """From each row's hash to the next row's; equal hashes make a loop."""
    before = F.lag(hash_).over(W.partitionBy(model).orderBy(order))
    out = log.withColumn("from_hash", before).filter(F.col("from_hash").isNotNull())
    return out.select(model, order, "from_hash", F.col(hash_).alias("to_hash"), (F.col("from_hash") == F.col(hash_)).alias("is_self_loop"))


def continuity_edges(log: DataFrame, model: str = "model", order: str = "ord") -> DataFrame:
    """Each row's link: to the latest row, itself included, that committed its prior state; else external; else the row before."""
    w = W.partitionBy(model).orderBy(order)
    rows = log.withColumn("previous", F.lag(order).over(w))
    # both sides in one window by state: of rows up to here, the last that committed it
    made = rows.filter("state is not null").select(model, F.col("state").alias("at"), F.col(order).alias("source"), F.col(order).alias("place"), F.lit(0).alias("asks"))
    asked = rows.filter("prior is not null").select(model, F.col("prior").alias("at"), F.lit(None).cast(log.schema[order].dataType).alias("source"), F.col(order).alias("place"), F.lit(1).alias("asks"))
    until = W.partitionBy(model, "at").orderBy("place", "asks").rowsBetween(W.unboundedPreceding, 0)
    found = made.unionByName(asked).withColumn("source", F.last("source", ignorenulls=True).over(until)).filter("asks = 1 AND source IS NOT NULL").select(model, F.col("place").alias(order), "source")
    best = rows.join(found, [model, order], "left")
    kind = F.when(F.col("source").isNotNull(), "commitment-link").when(F.col("prior").isNotNull(), "external-prior").when(F.col("previous").isNotNull() & (F.col("state").isNotNull() | (F.col("type") != "event")), "chronological-fallback")
    at = F.when(kind == "commitment-link", F.col("source")).when(kind == "chronological-fallback", F.col("previous"))
    return best.select(model, order, at.alias("from_ord"), kind.alias("kind")).filter("kind is not null")


def folded(rows: DataFrame, keys: list[str], order: str, item: Column, seed: str = "seed") -> DataFrame:
    """acc = sha256(acc | item) over each key's rows in order; the caller bounds a key's rows (a log's tail)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x"))))
    acc = F.aggregate(ordered, F.lit(seed), lambda a, x: _sha(F.concat_ws("|", a, x["x"])))
    return rows.groupBy(*keys).agg(acc.alias("accumulator"), F.count("*").alias("steps"), _sha(F.array_join(F.transform(ordered, lambda x: x["x"]), "|")).alias("root"))


def chained(log: DataFrame, key: str, order: str, payload: str, seed: str = "seed") -> DataFrame:
    """Adds ``built``: each row's link, the hash of the link before it and its payload.  Links depend on all before them, so a key is one task, a row at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, link, out = pdf.sort_values(order, ignore_index=True), seed, []
        for value in pdf[payload]:
            link = hashlib.sha256(f"{link}|{value}".encode()).hexdigest()
            out.append(link)
        return pdf.assign(built=out)

    rows = log.select(key, order, payload)
    return rows.groupBy(key).applyInPandas(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", built string")


def chain_checked(chain: DataFrame, key: str, order: str, payload: str, hash_: str, seed: str = "seed") -> DataFrame:
    """Whether each link's hash is that of the hash before it and its payload; one row at a time."""
    before = F.coalesce(F.lag(hash_).over(W.partitionBy(key).orderBy(order)), F.lit(seed))
    return chain.withColumn("parent_hash", before).withColumn("valid", F.col(hash_) == _sha(F.concat_ws("|", "parent_hash", payload)))


#: Levels of a tree that are folded in one row, over at most 2 ** LEVELS leaves.
LEVELS = 10


def merkle_root(leaves: DataFrame, key: str, order: str, leaf: str) -> DataFrame:
    """Pairwise hashes of hex text, level by level; the last of an odd level is paired with itself.

    Rows of at most 1024 neighbours are folded by ten levels at once, so a key with very many
    leaves is spread over rows and each round leaves a thousandth; the rounds are the only loop.
    """
    width = 1 << LEVELS
    rows = leaves.select(F.col(key).alias("k"), (F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).alias("i"), F.col(leaf).alias("h"))
    count = leaves.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("leaves"))
    longest = count.agg(F.max("leaves").alias("n")).first()["n"] or 0
    rows = rows.join(count, "k").withColumn("n", F.col("leaves"))
    pair = lambda lv: F.transform(F.sequence(F.lit(0), F.floor((F.size(lv) - 1) / 2).cast("int")), lambda i: _sha(F.concat(F.element_at(lv, 2 * i + 1), F.element_at(lv, F.least(2 * i + 2, F.size(lv))))))
    while True:
        one = rows.groupBy("k", "leaves", "n", F.floor(F.col("i") / width).alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("level"))
        # beside other rows all levels are climbed, a single node being paired with itself; alone, until one node is left
        climbed = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.col("level"), lambda lv, _: F.when(F.col("beside") | (F.size(lv) > 1), pair(lv)).otherwise(lv))
        one = one.withColumn("beside", F.col("n") > width).withColumn("h", F.element_at(climbed, 1))
        rows = one.select("k", "leaves", F.ceil(F.col("n") / width).alias("n"), F.col("b").alias("i"), "h")
        longest = -(-longest // width)
        if longest <= 1:
            return rows.select(F.col("k").alias(key), F.col("h").alias("root"), F.col("leaves").cast("int").alias("leaves"))


def leaves_validated(recorded: DataFrame, current: DataFrame, key: str = "name") -> DataFrame:
    """Recorded leaf hashes against current ones: PASS, TAMPERED, or INCONCLUSIVE where a source is missing."""
    at = recorded.join(current.select(key, F.col("hash").alias("now")), key, "left")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    bad, gone = n(F.col("now") != F.col("hash")), n(F.col("now").isNull())
    return at.agg(F.count("*").alias("leaves"), bad.alias("mismatched"), gone.alias("missing"), F.when(bad > 0, "TAMPERED").when(gone > 0, "INCONCLUSIVE").otherwise("PASS").alias("status"))


def changes(observations: DataFrame, path: str, order: str, hash_: str) -> DataFrame:
    """Each observation against the one before of its path."""
    before = F.lag(hash_).over(W.partitionBy(path).orderBy(order))
    state = F.when(before.isNull(), "FIRST_OBSERVATION").when(before == F.col(hash_), "UNCHANGED").otherwise("CHANGED")
    return observations.withColumn("state", state)


def compared(a: DataFrame, b: DataFrame, key: str, hash_: str) -> DataFrame:
    """Components of two manifests by full join: same, changed, added, removed."""
    both = a.select(key, F.col(hash_).alias("old")).join(b.select(key, F.col(hash_).alias("new")), key, "full")
    return both.select(key, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed").alias("status"))

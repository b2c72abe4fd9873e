"""Set algebra on (ref, hash, size) chunk tables: drift, delta, mirrors, collection, ratios; and the chunker."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KIB = 1024
MIN_SIZE, TARGET_SIZE, MAX_SIZE, MASK_BITS = 256 * KIB, 1024 * KIB, 4096 * KIB, 20


def chunk_set(chunks: DataFrame) -> DataFrame:
    """One row per (ref, hash); of several sizes the last by offset holds."""
    return chunks.groupBy("ref", "hash").agg(F.max_by("size", "offset").alias("size") if "offset" in chunks.columns else F.max("size").alias("size"))


def pair_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared, removed and new chunks of two sets, Jaccard similarity (1 if both are empty) and drift."""
    both = a.select("hash", F.col("size").alias("sa")).join(b.select("hash", F.col("size").alias("sb")), "hash", "full")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    in_a, in_b = F.col("sa").isNotNull(), F.col("sb").isNotNull()
    out = both.agg(n(in_a & in_b).alias("shared"), n(in_a & ~in_b).alias("removed"), n(~in_a & in_b).alias("new"), F.coalesce(F.sum(F.when(in_a & in_b, F.col("sa"))), F.lit(0)).alias("shared_bytes"), F.count("*").alias("everything"))
    j = F.when(F.col("everything") == 0, F.lit(1.0)).otherwise(F.col("shared") / F.col("everything"))
    return out.select("shared", "removed", "new", "shared_bytes", j.alias("jaccard"), F.round(1 - j, 6).alias("drift"))


def baseline_drift(sets: DataFrame, base: str = "base", version: str = "version") -> DataFrame:
    """Drift of each version from the first version, by string order, of its base; (base, version, hash) are distinct."""
    first = sets.groupBy(base).agg(F.min(version).alias("baseline"))
    held = sets.groupBy(base, "hash").agg(F.collect_set(version).alias("versions")).join(first, base)  # versions of one chunk
    in_base = F.array_contains("versions", F.col("baseline"))
    each = held.select(base, "baseline", in_base.alias("old"), F.explode("versions").alias(version))
    out = each.groupBy(base, "baseline", version).agg(F.count("*").alias("n"), F.count_if("old").alias("shared"))
    out = out.withColumn("n_base", F.max(F.when(F.col(version) == F.col("baseline"), F.col("n"))).over(W.partitionBy(base))).filter(F.col(version) != F.col("baseline"))
    j = F.col("shared") / (F.col("n") + F.col("n_base") - F.col("shared"))
    return out.select(base, "baseline", version, "shared", j.alias("jaccard"), (1 - j).alias("drift"))


def delta_plan(new: DataFrame, old: DataFrame) -> DataFrame:
    """Operations that build ``new``: reuse a chunk of ``old`` or carry it inline."""
    have = old.select("hash").distinct().withColumn("__have", F.lit(True))
    return new.join(have, "hash", "left").select(*new.columns, F.when(F.col("__have"), "reuse").otherwise("inline").alias("op"))


def delta_strategy(plan: DataFrame) -> DataFrame:
    """Bytes of the candidate strategies; chunks are chosen if a quarter of the new bytes is reused, else the cheapest."""
    totals = plan.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("new_bytes"), F.coalesce(F.sum(F.when(F.col("op") == "reuse", F.col("size"))), F.lit(0)).alias("reused_bytes"))
    changed = F.col("new_bytes") - F.col("reused_bytes")
    costs = F.array(*[F.struct(b.cast("long").alias("bytes"), (-F.lit(s)).alias("rank"), F.lit(n).alias("strategy")) for n, b, s in (("chunk", changed, 3), ("range", F.floor(changed * 1.15 + 0.5), 2), ("bsdiff", F.floor(F.col("new_bytes") * 0.6 + 0.5), 1), ("full", F.col("new_bytes"), 0))])
    overlap = F.when(F.col("new_bytes") > 0, F.col("reused_bytes") / F.col("new_bytes")).otherwise(F.lit(0.0))
    return totals.select("new_bytes", "reused_bytes", overlap.alias("overlap"), F.when((overlap >= 0.25) & (F.col("reused_bytes") > 0), "chunk").otherwise(F.array_min(costs)["strategy"]).alias("strategy"))


def mirror_delta(source: DataFrame, mirror: DataFrame) -> DataFrame:
    """Chunks the mirror lacks, and the share of chunks in step (1 if the source is empty)."""
    at = source.join(mirror.select("hash").distinct().withColumn("__there", F.lit(True)), "hash", "left")
    total, there = F.count("*"), F.count("__there")
    return at.agg((total - there).alias("missing"), F.coalesce(F.sum(F.when(F.col("__there").isNull(), F.col("size"))), F.lit(0)).alias("missing_bytes"), F.when(total == 0, F.lit(1.0)).otherwise(there / total).alias("sync_ratio"))


def unreferenced(stored: DataFrame, live: DataFrame, key: str = "hash") -> DataFrame:
    """Garbage: what is stored and no live manifest names."""
    return stored.join(live.select(key).distinct(), key, "left_anti")


def store_stats(chunks: DataFrame) -> DataFrame:
    """Logical and stored bytes, distinct chunks, and their ratio (1 if nothing is stored)."""
    kinds = chunks.groupBy("hash").agg(F.first("size").alias("stored"), F.sum("size").alias("logical"), F.count("*").alias("refs"))
    out = kinds.agg(F.count("*").alias("chunks"), F.sum("refs").alias("refs"), F.sum("logical").alias("logical_bytes"), F.sum("stored").alias("stored_bytes"))
    return out.withColumn("dedupe_ratio", F.when(F.col("stored_bytes") > 0, F.col("logical_bytes") / F.col("stored_bytes")).otherwise(F.lit(1.0)))


def layout(regions: DataFrame, order: list, group: str, size: str = "size") -> DataFrame:
    """Offsets of regions in a stated order: the running sum of sizes before each."""
    w = W.partitionBy(group).orderBy(*order)
    return regions.withColumn("position", F.row_number().over(w)).withColumn("offset", F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def gear_table() -> list[int]:
    """256 words of a linear congruential sequence."""
    seed, out = 0x9E3779B9, []
    for _ in range(256):
        seed = (seed * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(seed)
    return out


_GEAR = np.array(gear_table(), np.uint32)


def cut_points(data: bytes, least: int = MIN_SIZE, target: int = TARGET_SIZE, most: int = MAX_SIZE, bits: int = MASK_BITS) -> list[int]:
    """Ends of content-defined chunks: where the rolling hash of the last 32 bytes has ``bits`` zero bits, ``least`` bytes from the start or later.

    The hash is taken at all places together, by doubling the window; a chunk shorter than the
    window can't end by it, because ``least`` is at least 32.
    """
    if least < 32:
        raise ValueError("a chunk must be at least as long as the hash's window")
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        h[s:] = h[s:] + (h[:-s] << np.uint32(s)) if len(h) > s else h[s:]
    marks = np.flatnonzero((h & np.uint32((1 << bits) - 1)) == 0) + 1
    out, start, n = [], 0, len(data)
    while start < n:
        end = min(start + min(target, most), n)
        at = np.searchsorted(marks, start + least)
        start = int(marks[at]) if at < len(marks) and marks[at] <= end else end
        out.append(start)
    return out or [0]


def chunked(blobs: DataFrame, ref: str = "path", content: str = "content", data: bool = False, **sizes: int) -> DataFrame:
    """One row per chunk (ref, index, offset, length, hash, and its bytes if asked for) of each blob; an empty blob has one empty chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, blob in zip(pdf["ref"], pdf["content"]):
                blob, start = bytes(blob or b""), 0
                for i, end in enumerate(cut_points(blob, **sizes)):
                    rows.append((name, i, start, end - start, hashlib.sha256(blob[start:end]).hexdigest(), blob[start:end] if data else None))
                    start = end
            yield pd.DataFrame(rows, columns=["ref", "index", "offset", "length", "hash", "data"])

    out = blobs.select(F.col(ref).alias("ref"), F.col(content).alias("content")).mapInPandas(run, "ref string, index int, offset long, length long, hash string, data binary")
    return out if data else out.drop("data")


def chunk_root(chunks: DataFrame) -> DataFrame:
    """A blob's root: the hash of its chunks' hash:offset:length lines in order."""
    line = F.struct("index", F.concat_ws(":", "hash", "offset", "length").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    return chunks.groupBy("ref").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("root"), F.count("*").alias("chunks"), F.sum("length").alias("bytes"))

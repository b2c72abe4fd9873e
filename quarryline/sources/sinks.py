"""Writers: append-only rows, exports, artifacts, and the chunk store."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def meter_rows(df: DataFrame, model: Column, event: Column, quantity: Column, unit: Column, at: Column) -> DataFrame:
    """Rows of a meter log; the id is the hash of the row, so a repeated write repeats the id."""
    out = df.select(model.alias("model"), event.alias("event"), quantity.cast("double").alias("quantity"), unit.alias("unit"), at.alias("recorded_at"))
    return out.withColumn("event_id", F.substring(F.sha2(F.to_json(F.struct(*out.columns)), 256), 1, 16))


def export_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """A fixed list of columns with a header."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def artifacts(df: DataFrame, name: Column, payload: Column) -> DataFrame:
    """Payloads wrapped with their content hash."""
    return df.select(name.alias("name"), payload.alias("payload"), F.concat(F.lit("sha256:"), F.sha2(payload, 256)).alias("artifact_id"), F.length(payload).alias("size"))


def ingested(blobs: DataFrame, path: str) -> DataFrame:
    """Binary files into a content-addressed folder, partitioned by the hash's first two digits; returns their index."""
    rows = blobs.select(F.sha2("content", 256).alias("hash"), F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("ext"), F.col("path").alias("source"), "length", "content").withColumn("prefix", F.substring("hash", 1, 2))
    rows.dropDuplicates(["hash"]).write.mode("append").partitionBy("prefix").parquet(path)
    return rows.drop("content", "prefix")


def import_chunks(new: DataFrame, store_path: str, spark: SparkSession) -> int:
    """Appends the chunks (hash, data) that the store lacks; returns how many."""
    kinds = new.dropDuplicates(["hash"])
    try:
        have = spark.read.parquet(store_path).select("hash")
        kinds = kinds.join(have, "hash", "left_anti")
    except Exception as e:  # a store that isn't there yet holds nothing
        if "PATH_NOT_FOUND" not in str(e):
            raise
    kinds = kinds.persist()
    n = kinds.count()
    kinds.write.mode("append").parquet(store_path)
    kinds.unpersist()
    return n


def materialized(refs: DataFrame, store: DataFrame) -> DataFrame:
    """Files (ref) put together from their chunks in order; a missing chunk fails."""
    at = refs.join(store.select("hash", "data"), "hash", "left")
    data = F.coalesce("data", F.raise_error(F.concat(F.lit("missing chunk "), "hash")).cast("binary"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("index", F.hex(data).alias("h")))), lambda x: x["h"])
    return at.groupBy("ref").agg(F.unhex(F.array_join(parts, "")).alias("content"))


def compressed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each text deflated: (key, raw_bytes, packed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [(t or "").encode() for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "raw_bytes": [len(r) for r in raw], "packed": [zlib.compress(r, 6) for r in raw]})

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, "key long, raw_bytes long, packed binary")


def inflated(packed: Column) -> Column:
    """The bytes again."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(zlib.decompress)

    return run(packed)


def host_map(spark: SparkSession, path: str) -> DataFrame:
    """Four fields a line, by white space; lines from # on are comments."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter("trim(value) != '' AND NOT startswith(trim(value), '#')").select(parts.alias("p"))
    return rows.select(*[F.col("p")[i].alias(n) for i, n in enumerate(("territory", "public_host", "account_host", "cms_namespace"))])


def intake_scan(spark: SparkSession, folder: str) -> DataFrame:
    """All *.meta.json below a folder."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").option("multiLine", True).json(folder)

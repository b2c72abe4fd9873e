"""Folders of JSON documents as stores: embeddings, artifacts, references and manifests; logs by model; SQLite tables."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.records import sanitized_ref
from .logs import jsonl, since, text_at


def documents(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(file, stem, v) of all files of a folder with that ending that hold one JSON document; others are dropped."""
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
    return files.filter("v is not null").select("file", F.substring("file", 1, F.length("file") - len(suffix)).alias("stem"), "v")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """*.embed.json with a vector: key, vector, cell (or null), residual (or null)."""
    d = documents(spark, folder, ".embed.json")
    at = lambda p, kind: F.try_variant_get("v", f"$.{p}", kind)
    rows = d.select("stem", at("vector", "array<double>").alias("vector"), at("e8_cell", "array<double>").alias("cell"), at("residual_norm", "double").alias("residual"))
    return rows.filter("vector is not null").withColumnRenamed("stem", "key")


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """*.artifact.json: artifact_id, name, type, emitted_at."""
    return documents(spark, folder, ".artifact.json").select(*[text_at(n).alias(n) for n in ("artifact_id", "name", "type", "emitted_at")])


def references(spark: SparkSession, folder: str) -> DataFrame:
    """refs/*.json: the reference's name and the digest of its manifest."""
    return documents(spark, f"{folder}/refs", ".json").select(F.col("stem").alias("ref"), F.replace(F.coalesce(text_at("artifact_id"), F.lit("")), F.lit("ak://sha256:"), F.lit("")).alias("sha"))


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """manifests/*.json: digest, size, number of chunks, the document."""
    d = documents(spark, f"{folder}/manifests", ".json")
    return d.select(F.col("stem").alias("sha"), text_at("size_bytes").try_cast("long").alias("size_bytes"), text_at("chunk_graph.chunk_count").try_cast("long").alias("chunk_count"), "v")


def resolved(addresses: DataFrame, folder: str, address: str) -> DataFrame:
    """Addresses with the digest of their manifest, null where there is none.

    An address is ``ak://sha256:<digest>``, ``ak://blake3:<digest>`` (by indexes/blake3-<digest>.json,
    whose manifest path ends in the digest) or a reference's name.
    """
    spark = addresses.sparkSession
    a, digest = F.col(address), F.lit("ak://sha256:")
    indexed = documents(spark, f"{folder}/indexes", ".json").select(F.concat(F.lit("ak://"), F.regexp_replace("stem", "^([a-z0-9]+)-", "$1:")).alias(address), F.regexp_extract(text_at("manifest_path"), r"([^/]+)\.json$", 1).alias("by_index"))
    named = references(spark, folder).select(F.col("ref").alias("__ref"), F.col("sha").alias("by_name"))
    out = addresses.join(indexed, address, "left").withColumn("__ref", F.when(~F.startswith(a, F.lit("ak://")), sanitized_ref(a))).join(named, "__ref", "left")
    sha = F.when(F.startswith(a, digest), F.replace(a, digest, F.lit(""))).otherwise(F.coalesce("by_index", "by_name"))
    known = manifests(spark, folder).select(F.col("sha").alias("__sha"), F.col("sha").alias("manifest"))
    return out.withColumn("__sha", sha).join(known, "__sha", "left").select(*addresses.columns, "manifest")


def meter_of(spark: SparkSession, folder: str, model: str | None = None, moment: str | None = None) -> DataFrame:
    """Meter rows of one model's files (``model.*.jsonl``) or of all; files of other models aren't read.  Rows without a valid time stay."""
    return since(jsonl(spark, f"{folder}/{model + '.' if model else ''}*.jsonl"), text_at("recorded_at"), moment, keep_invalid=True)


def newest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The file last modified of each folder below ``folder``: (folder, path, modified); content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", F.col("modificationTime").alias("modified"))
    rows = files.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    place = F.row_number().over(W.partitionBy("folder").orderBy(F.desc("modified"), F.desc("path")))
    return rows.withColumn("r", place).filter("r = 1").select("folder", "path", "modified")


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """A SQLite table by ranges of rowid; the file must lie where every executor can open it."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    step = max(1, -(-((high or 0) - (low or 0) + 1) // parts))
    names = ", ".join(f'"{f.name}"' for f in spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in pdf["id"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                    yield pd.read_sql_query(f'SELECT {names} FROM "{table}" WHERE rowid >= ? AND rowid < ?', con, params=(int(a), int(a) + step))

    if low is None:
        return spark.createDataFrame([], schema)
    return spark.range(low, high + 1, step, parts).mapInPandas(run, schema)

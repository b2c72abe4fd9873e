"""Append-only JSONL logs: one object a line, schema on read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields lifted from ``metadata`` where the top level lacks them.  Fixed values.
CONTINUITY_FIELDS = ["state_commitment", "prior_commitment", "transition_type", "continuity_relation", "continuity_class", "continuity_verdict", "continuity_policy", "opening_policy", "residual_delta", "transition_witness"]


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, line, v) of all lines that are JSON; others are dropped."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
    return lines.withColumn("v", F.try_parse_json("line")).filter("v is not null")


def whole_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file's array as rows, or its object as one row; invalid JSON fails."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    listed = F.schema_of_variant("v").startswith("ARRAY")
    rows = doc.select(F.when(listed, F.from_json(F.to_json("v"), "array<variant>")).otherwise(F.array("v")).alias("rows"))
    return rows.select(F.posexplode("rows").alias("ord", "v"))


def text_at(path: str, column: str = "v") -> Column:
    return F.try_variant_get(F.col(column), f"$.{path}", "string")


def model_of_file() -> Column:
    """The file's stem: one log file a model."""
    return F.regexp_extract("file", r"([^/]+?)\.jsonl$", 1)


def promoted(log: DataFrame) -> DataFrame:
    """Adds the continuity fields, from the top level or from ``metadata``."""
    return log.withColumns({f: F.coalesce(text_at(f), text_at(f"metadata.{f}")) for f in CONTINUITY_FIELDS})


def since(log: DataFrame, stamp: Column, moment: str | None, keep_invalid: bool) -> DataFrame:
    """Rows from ``moment`` on; rows without a valid time stay or go."""
    if moment is None:
        return log
    t = stamp.try_cast("timestamp")
    late = t >= F.lit(moment).cast("timestamp")
    return log.filter(t.isNull() | late if keep_invalid else F.coalesce(late, F.lit(False)))


def meter_log(spark: SparkSession, path: str, moment: str | None = None) -> DataFrame:
    log = since(jsonl(spark, path), text_at("recorded_at"), moment, keep_invalid=True)
    return log.select(F.coalesce(text_at("model"), model_of_file()).alias("model"), text_at("recorded_at").alias("recorded_at"), text_at("event").alias("event"), text_at("quantity").try_cast("double").alias("quantity"), text_at("unit").alias("unit"), "v")


def audit_log(spark: SparkSession, path: str, moment: str | None = None, keep_invalid: bool = True) -> DataFrame:
    stamp = F.coalesce(text_at("timestamp"), text_at("created_at"))
    log = promoted(since(jsonl(spark, path), stamp, moment, keep_invalid))
    return log.select(F.coalesce(text_at("model"), model_of_file()).alias("model"), stamp.alias("at"), text_at("command").alias("command"), text_at("proof_hash").alias("proof_hash"), "line", *CONTINUITY_FIELDS)


def queue_log(spark: SparkSession, path: str) -> DataFrame:
    names = ["task_id", "queue", "task", "state", "enqueued_at", "claimed_at", "done_at", "worker_id"]
    return jsonl(spark, path).select(*[text_at(n).alias(n) for n in names])


def tel_log(spark: SparkSession, calls: str, messages: str) -> DataFrame:
    """Calls and messages together, each with its own time column."""
    one = jsonl(spark, calls).select(F.lit("call").alias("event_type"), text_at("call_id").alias("id"), text_at("started_at").alias("started_at"), text_at("from").alias("from"), text_at("to").alias("to"))
    two = jsonl(spark, messages).select(F.lit("sms").alias("event_type"), text_at("sms_id").alias("id"), text_at("sent_at").alias("sent_at"), text_at("from").alias("from"), text_at("to").alias("to"), text_at("body").alias("body"))
    return one.unionByName(two, allowMissingColumns=True)


def append(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    df.write.mode("append").json(path)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: an input that declares them unique is refused."""
    return df.groupBy(*keys).count().filter("count > 1")

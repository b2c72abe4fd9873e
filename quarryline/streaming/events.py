"""Structured Streaming counterparts: log tails, windows, change watches and queue claims."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tail(spark: SparkSession, folder: str, schema: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """A folder of Parquet files as a stream of events with a watermark; times without a zone are the session's."""
    return spark.readStream.schema(schema).parquet(folder).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed(events: DataFrame, ts: str, key: str, value: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by tumbling or sliding window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))


def sessions(events: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """Sessions of a key that end after a gap."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))


def breaches(events: DataFrame, ts: str, value: str, limit: float) -> DataFrame:
    """Share of events above a service level a minute."""
    return events.groupBy(F.window(ts, "60 seconds").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col(value) > limit).alias("breaches"))


def watched(observations: DataFrame, path: str, hash_: str, order: str, forget: int | None = None) -> DataFrame:
    """A stream of (path, order, hash): each one against the last seen of its path, in order within a batch.

    With ``forget``, a path that isn't seen for so many seconds of processing time is forgotten;
    such a stream runs until it is stopped, because an expiry may come at any time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ord", "hash"], kind="stable")
        out = []
        for o, h in zip(rows["ord"], rows["hash"]):
            out.append((key[0], o, h, "FIRST_OBSERVATION" if last is None else "UNCHANGED" if h == last else "CHANGED"))
            last = h
        state.update((last,))
        if forget:
            state.setTimeoutDuration(forget * 1000)
        yield pd.DataFrame(out, columns=["path", "ord", "hash", "state"])

    rows = observations.select(F.col(path).alias("path"), F.col(order).cast("long").alias("ord"), F.col(hash_).alias("hash"))
    return rows.groupBy("path").applyInPandasWithState(step, "path string, ord long, hash string, state string", "last string", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def claimed(tasks: DataFrame) -> DataFrame:
    """First in, first out: the earliest pending task of each queue becomes claimed; others keep their state."""
    first = tasks.filter("state = 'pending'").groupBy("queue").agg(F.min_by("task_id", "enqueued_at").alias("next"))
    return tasks.join(first, "queue", "left").withColumn("state", F.when(F.col("task_id") == F.col("next"), "claimed").otherwise(F.col("state"))).drop("next")


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what there is and returns its result table."""
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)

"""Helpers shared by the operators: inputs, shared tables, skew-safe lookups, workers' memory, text buffers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A group with more than this share of all rows is looked up by broadcast; so at most 1/share groups are.
HEAVY_SHARE = 0.001


#: A table of fewer bytes is spread over the cores before work; its files may hold one row group each.
SMALL = 64 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def spread(table: DataFrame) -> DataFrame:
    """A small table dealt out over all cores; a larger one as its files split, without an exchange."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(2 * table.sparkSession.sparkContext.defaultParallelism) if size < SMALL else table


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that others, whatever their names, never clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


# --- tables in the shared folder ------------------------------------------------------------------

_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a session on this machine alone may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the cluster's own clean-up remains
        return


@atexit.register
def _clean() -> None:
    for path, spark in _made.items():
        _remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and every executor can read it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables from ``written`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_table", None)
        if path in _made:
            _remove(_made.pop(path), path)


def written_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, ``written``; the tables that were written on the way are removed."""
    before = set(_made)
    out = written(make(), name)
    for path in set(_made) - before - {out._table}:
        _remove(_made.pop(path), path)
    return out


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- lookups that survive hot keys ----------------------------------------------------------------


def with_group(members: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``members`` left-joined to ``groups`` (one row per key; ``size`` is the key's number of members).

    Groups above ``HEAVY_SHARE`` of ``total`` rows, at most ``1 / HEAVY_SHARE`` of them, are
    broadcast; their members get a null key in the shuffled join, dealt out by a salt, so a
    group that holds a third of all rows is never gathered in one task.
    """
    limit = max(1.0, total * HEAVY_SHARE)
    rest = [c for c in groups.columns if c not in keys]
    heavy = groups.filter(F.col(size) > limit).select(*keys, F.struct(*rest).alias("__heavy"))
    light = groups.filter(F.col(size) <= limit).select(
        *[F.col(k).alias(f"__l_{k}") for k in keys], F.xxhash64(*keys).alias("__l_salt"), F.struct(*rest).alias("__light")
    )
    at = members.join(F.broadcast(heavy), keys, "left")
    hit = F.col("__heavy").isNotNull()
    row = F.xxhash64(*[F.col(c) for c in members.columns])
    at = at.withColumn("__salt", F.when(hit, row).otherwise(F.xxhash64(*keys)))
    on = F.col("__salt") == F.col("__l_salt")
    for k in keys:
        on = on & (F.when(~hit, F.col(k)) == F.col(f"__l_{k}"))
    found = F.coalesce("__heavy", "__light")
    return at.join(light, on, "left").select(*members.columns, *[found[c].alias(c) for c in rest])


# --- memory of workers ----------------------------------------------------------------------------
# A worker outlives its task and serves the next operator beside an executor whose heap has grown by then.

_held: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept by this process between tasks until something else is held or ``let_go``."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Forgets what is held and gives this process's free memory back to the system."""
    _held.clear()
    give_back()


def give_back() -> None:
    """Gives back free memory that Arrow and the C library would keep."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only


def lean(run: Callable[[Iterator], Iterator], holds: bool = False) -> Callable[[Iterator], Iterator]:
    """A task's function that leaves its worker no larger than it has to; one that ``holds`` nothing forgets what another left."""

    def task(batches: Iterator) -> Iterator:
        if not holds:
            let_go()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


# --- text of Arrow batches as bytes ---------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):  # 64-bit offsets: together the chunks may hold more than 2 GiB
        column = column.cast(pa.large_string()).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], text_col: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(off, off[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

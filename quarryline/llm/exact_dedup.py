"""Exact dedup by content-defined chunk recipes.

A text, with A-Z lower-cased, is cut into chunks where a gear hash of the last 32 bytes has
``CUT_BITS`` zero bits.  A chunk's identifier is a short digest.  Chunks are deduplicated by
identifier, and each identifier is verified: the least and the greatest bytes that have it must
be equal.  If one identifier stands for two different chunks, all identifiers are lengthened and
the recipes are made anew, so that equal identifiers always mean equal bytes.  Texts are then
compared as ordered lists of identifiers (recipes).  Chunks move once, deduplicated within each
task; after that long texts stand for a few bytes a chunk.  Groups are looked up by a digest of
the recipe, which is verified in the same way.  The SHA-256 of the whole text is only reported.

Defined results: a null text counts as the empty text; of equal texts the row with
the largest doc_id stays (a null doc_id is smaller than any other), and of rows that
repeat that doc_id exactly one; an empty table gives an empty result; only the named columns
are read, so others may have any name; very long texts are cut and compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, pieces, text_bytes, with_group, written

MIN_CHUNK, MAX_CHUNK, CUT_BITS = 256, 16384, 11
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)

_RECIPES = "row_id long, doc_id long, text_sha256 string, recipe binary"
#: Bytes of an identifier, and how often it may be doubled.
KEY_BYTES, LENGTHS = 8, 4


def gear(buf: np.ndarray) -> np.ndarray:
    """The gear hash of the 32 bytes that end at each place, built by doubling the window."""
    h = _GEAR[buf]
    for s in (1, 2, 4, 8, 16):
        h[s:] = h[s:] + (h[:-s] << np.uint32(s)) if len(h) > s else h[s:]
    return h


def cuts(candidates: np.ndarray, start: int, end: int) -> list[int]:
    """Chunk ends of one text, from the places where a cut may be."""
    out, at = [], start
    for c in candidates.tolist():
        while c - at > MAX_CHUNK:
            at += MAX_CHUNK
            out.append(at)
        if c - at >= MIN_CHUNK and c < end:
            out.append(c)
            at = c
    while end - at > MAX_CHUNK:
        at += MAX_CHUNK
        out.append(at)
    out.append(end)
    return out


def _chunks(column: pa.Array) -> Iterator[list[bytes]]:
    """The chunks of each text of a column."""
    mask = np.uint32((1 << CUT_BITS) - 1 << 32 - CUT_BITS)
    buf, off = text_bytes(column)
    low = buf.tobytes().lower()  # bytes.lower changes A-Z only
    cand = np.flatnonzero((gear(np.frombuffer(low, np.uint8)) & mask) == 0) + 1
    at = np.searchsorted(cand, off, "right")
    for i, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        ends = cuts(cand[at[i] : at[i + 1]], s, e)
        yield [low[a:b] for a, b in zip([s, *ends], ends)]


def _key(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=64).digest()[:size]


def recipes(docs: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """One row per row of ``docs`` (row_id, doc_id, text): its whole-text digest and its chunk recipe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            shas, made = [], []
            for chunks in _chunks(batch.column(2)):
                shas.append(hashlib.sha256(b"".join(chunks)).hexdigest())
                made.append(b"".join(_key(c, key_bytes) for c in chunks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shas), pa.array(made, pa.binary())], [x.split()[0] for x in _RECIPES.split(", ")])

    return docs.select("row_id", "doc_id", "text").mapInArrow(lean(run), _RECIPES)


def chunk_table(docs: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """The deduplicated chunks: identifier, number of uses, bytes, and whether all uses have the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 23):
            seen: dict[bytes, int] = {}  # a task sends a chunk about once
            for chunks in _chunks(batch.column(0)):
                for c in chunks:
                    seen[c] = seen.get(c, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([_key(c, key_bytes) for c in seen], pa.binary()), pa.array(seen, pa.binary()), pa.array(seen.values(), pa.int64())], ["k", "chunk", "uses"])

    one = docs.select("text").mapInArrow(lean(run), "k binary, chunk binary, uses long")
    table = one.groupBy("k").agg(F.sum("uses").alias("uses"), F.min("chunk").alias("chunk"), F.max("chunk").alias("other"))
    return table.select("k", "uses", "chunk", (F.col("chunk") == F.col("other")).alias("verified"))


def verified_recipes(docs: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """Recipes, in a written table, of which equal ones stand for equal chunk lists."""
    for _ in range(LENGTHS):
        if chunk_table(docs, key_bytes).filter(~F.col("verified")).isEmpty():
            return written(recipes(docs, key_bytes), "recipes")
        key_bytes = max(1, 2 * key_bytes)
    raise RuntimeError("different chunks share digests of every length")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_id: str | None = None, key_bytes: int = KEY_BYTES) -> DataFrame:
    """Per row: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    ``row_id`` names a column that tells rows apart; without it rows are numbered when the
    table of recipes is written, once.
    """
    rid = F.col(row_id).cast("long") if row_id else F.monotonically_increasing_id()
    rows = docs.select(rid.alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = verified_recipes(rows, key_bytes)
    lists = made.withColumn("list_id", F.sha2("recipe", 256))
    low, high = F.min("recipe").alias("low"), F.max("recipe").alias("high")
    groups = lists.groupBy("list_id").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_id")).alias("keep"), low, high)
    if not groups.filter("low != high").isEmpty():  # different recipes share a digest: the recipe itself is the key
        lists = made.withColumn("list_id", F.hex("recipe"))
        groups = lists.groupBy("list_id").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_id")).alias("keep"))
    lists, groups = lists.drop("recipe"), groups.select("list_id", "group_size", "keep")
    out = with_group(lists, groups, ["list_id"], "group_size", made.count())
    return out.select("row_id", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("keep.row_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows are numbered once, in a written table."""
    row = fresh(docs, "row_id")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    stay = exact_groups(numbered, id_col, text_col, row).filter("kept").select(F.col("row_id").alias(row))
    return numbered.join(stay, row, "left_semi").select(*docs.columns)

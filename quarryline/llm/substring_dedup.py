"""Substring dedup by words: seed and extend.

Documents are joined on winnowed anchors (runs of ``GRAM`` words, see ``repeats``).  In a
bucket all occurrences of an anchor are extended together, word by word to the left and to
the right: each step splits the classes of occurrences that have agreed so far.  A window is a
match of two occurrences whose left and right extensions add up to ``length`` words; matches
to earlier places are removed, and overlapping ones add up to the maximal repeats of at least
``length`` words.  Words travel as bytes and are numbered exactly.

Defined results: a null or empty text has no words; rows that repeat both doc_id and text
are one document and get equal results; rows that repeat only the doc_id are taken in order
of their text; null doc_ids come before all others, in order of a hash of their text; an empty
table gives an empty result; only the two named columns are read, so others may have any name;
texts of any length are compared whole (a text is held by one worker at a time).
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import BLOCK_BYTES, HOT, Block, Classes, Items, Windows, block_of, deduplicated, removed
from .words import gathered, gram_numbers, word_hashes, word_numbers, words

LENGTH, GRAM = 20, 8
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start: long, end: long>>"


def word_items(own: Block, exact: bool = True) -> Items:
    starts, ends, doc = words(own.buf, own.off)
    hashes = word_hashes(own.buf, starts, ends)
    numbers = word_numbers(own.buf, starts, ends, hashes) if exact else hashes

    def pack(first: np.ndarray, n: np.ndarray) -> bytes:
        """The words, each with a space after it."""
        which = gathered(first, n)
        size = ends[which] - starts[which] + 1
        out = own.buf[np.minimum(gathered(starts[which], size), len(own.buf) - 1)]
        out[np.cumsum(size) - 1] = 0x20
        return out.tobytes()

    return Items(hashes, np.searchsorted(doc, np.arange(len(own.off))), numbers, pack)


def unpacked(contents: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"".join(contents), np.uint8)
    starts, ends, _ = words(buf, np.array([0, len(buf)]))
    return word_numbers(buf, starts, ends)


def extend(length: int, gram: int):
    """Extends the occurrences of each anchor to both sides, a word at a time."""

    def classes(items: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, seed: np.ndarray) -> tuple[Classes, Classes]:
        most, last = np.int64(items.max() + 1), len(items) - 1
        split = lambda c, at: np.unique(c * most + items[np.clip(at, 0, last)], return_inverse=True)[1]
        same = gram_numbers(items, anchor, gram, seed)  # the anchor's own words
        ahead, behind = {gram: same}, {0: same}
        for r in range(gram + 1, length + 1):
            ahead[r] = split(ahead[r - 1], anchor + r - 1)
        for l in range(1, length - gram + 1):
            behind[l] = split(behind[l - 1], anchor - l)
        return behind.__getitem__, ahead.__getitem__

    return classes


def windows(length: int = LENGTH, gram: int = GRAM) -> Windows:
    if not 1 <= gram <= length <= 200:
        raise ValueError("1 <= gram <= length <= 200")
    return Windows(length, gram, word_items, lambda x: x, unpacked, extend(length, gram))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _finish(key, docs, replies):
    out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans")}
    if docs.num_rows:
        own = block_of(docs)
        _, _, doc = words(own.buf, own.off)
        first = np.searchsorted(doc, np.arange(len(own.off)))
        gone = removed(len(doc), replies)
        made = []
        for i, text in enumerate(own.texts):
            mask = gone[first[i] : first[i + 1]]
            split = text.split()
            kept = b" ".join(compress(split, ~mask)) if mask.any() else b" ".join(split)
            spans = [{"start": s, "end": e} for s, e in zip(*(x.tolist() for x in runs(mask)))]
            made.append((len(mask), int(mask.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(), spans))
        for doc_id, i in zip(own.rows, own.row_of):
            for name, value in zip(out, (doc_id, *made[i])):
                out[name].append(value)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), span))], names=list(out))


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hot: int = HOT
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, SHA-256 of the kept words, the kept text, and the removed spans of words."""
    return deduplicated(docs, windows(length, gram), _finish, SCHEMA, id_col, text_col, block_bytes, hot)

"""Suffix-array dedup by bytes: a hash-compared suffix sort.

For all occurrences of a seed (see ``repeats``), the suffixes from the seed on, and the
reversed suffixes to its left, are sorted by mergesort.  Two suffixes are compared through
prefix polynomial hashes: binary search for the longest common extension takes a logarithmic
number of hash comparisons, and the next byte decides.  The common extensions of neighbours in
both sorted arrays say which occurrences share enough bytes to the left and to the right to be
equal over a whole window.  Each array is then verified: the common extension of every two
neighbours is compared byte by byte, and the byte after it must be in order, which proves the
whole order; if hashes have collided, the suffixes are sorted by their bytes instead.

Defined results: a null or empty text has no bytes; rows that repeat both doc_id and text are
one document and get equal results; rows that repeat only the doc_id are taken in order of
their text; null doc_ids come before all others, in order of a hash of their text; an empty
table gives an empty result; only the two named columns are read, so others may have any name;
texts of any length are compared whole (a text is held by one worker at a time).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import BLOCK_BYTES, HOT, Block, Classes, Items, Windows, block_of, deduplicated, removed
from .substring_dedup import runs
from .words import BYTE, FIRST, SPAN, gathered

LENGTH, GRAM = 100, 36
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>"
#: Neighbours whose bytes are compared at once.
BESIDE = 1 << 14


class Extensions:
    """Longest common extensions of suffixes of given sizes, by prefix polynomial hashes and binary search."""

    def __init__(self, items: np.ndarray):
        self.items = items
        self.base = np.arange(len(items) + 1, dtype=np.int64) % SPAN
        self.prefix = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(BYTE[items] * FIRST.up[self.base[:-1]], out=self.prefix[1:])

    def span(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hash of ``length`` bytes from each start; the powers restart every SPAN bytes."""
        end = start + length
        turn = np.minimum(end, (start // SPAN + 1) * SPAN)
        h = (self.prefix[turn] - self.prefix[start]) * FIRST.down[self.base[start]]
        over = end > turn
        if over.any():
            s, t, e = start[over], turn[over], end[over]
            h[over] += (self.prefix[e] - self.prefix[t]) * FIRST.up[t - s]
        return h

    def common(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` share; most pairs share all or little."""
        out = np.minimum(size_a, size_b)
        rest = np.flatnonzero(self.span(a, out) != self.span(b, out))
        if not len(rest):
            return out
        lo, hi = np.zeros(len(rest), np.int64), out[rest] - 1
        x, y = a[rest], b[rest]
        for _ in range(int(hi.max()).bit_length() + 1):
            mid = (lo + hi + 1) // 2
            same = self.span(x, mid) == self.span(y, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        out[rest] = lo
        return out

    def before(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether the suffix at ``a`` sorts before that at ``b``, or where ``or_equal`` with it; an end sorts before any byte."""
        n = self.common(a, b, size_a, size_b)
        out = np.where(size_a == size_b, or_equal, size_a < size_b)
        differ = np.flatnonzero(n < np.minimum(size_a, size_b))
        at = n[differ]
        out[differ] = self.items[a[differ] + at] < self.items[b[differ] + at]
        return out


def suffix_sort(ext: Extensions, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes, stable and within their groups (consecutive); a mergesort in which all merges of a level go together."""
    order = np.arange(len(starts))
    if not len(starts):
        return order
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(starts)))
    begin, length = np.repeat(first, size), np.repeat(size, size)
    own = np.arange(len(starts)) - begin
    width, longest = 1, int(size.max())
    while width < longest:
        run = own // width
        other = (run ^ 1) * width
        active = np.flatnonzero(other < length)
        lo = other[active] + begin[active]
        hi = np.minimum(other[active] + width, length[active]) + begin[active]
        base = lo.copy()
        right = (run[active] & 1).astype(bool)
        me, own_size = starts[order[active]], sizes[order[active]]
        live = np.arange(len(active))
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            less = ext.before(starts[order[mid]], me[live], sizes[order[mid]], own_size[live], right[live])
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        pair = begin[active] + (run[active] & ~1) * width
        to = pair + (own[active] % width) + (lo - base)
        new = order.copy()
        new[to] = order[active]
        order = new
        width *= 2
    return order


def in_order(items: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, common: np.ndarray) -> bool:
    """Whether each suffix at ``a`` shares just ``common`` bytes with the one at ``b`` and doesn't sort after it."""
    least = np.minimum(size_a, size_b)
    whole = common == least
    if not (size_a[whole] <= size_b[whole]).all():
        return False
    at = np.flatnonzero(~whole)
    if not (items[a[at] + common[at]] < items[b[at] + common[at]]).all():
        return False
    for i in range(0, len(a), BESIDE):
        n = common[i : i + BESIDE]
        if not np.array_equal(items[gathered(a[i : i + BESIDE], n)], items[gathered(b[i : i + BESIDE], n)]):
            return False
    return True


def array_and_extensions(items: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes by group and bytes, and how much each shares with the one before it; -1 where a group begins."""
    by_group = np.argsort(group, kind="stable")
    starts, sizes, kind = starts[by_group], sizes[by_group], group[by_group]
    ext = Extensions(items)
    order = suffix_sort(ext, starts, sizes, kind)
    near = np.flatnonzero(kind[order][1:] == kind[order][:-1])
    a, b = order[near], order[near + 1]
    shared = ext.common(starts[a], starts[b], sizes[a], sizes[b])
    if not in_order(items, starts[a], starts[b], sizes[a], sizes[b], shared):
        raw = items.tobytes()
        text = [raw[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist())]
        order = np.array(sorted(range(len(text)), key=lambda i: (kind[i], text[i], i)), np.int64)
        a, b = order[near], order[near + 1]
        shared = np.array([next((k for k, (x, y) in enumerate(zip(text[i], text[j])) if x != y), min(len(text[i]), len(text[j]))) for i, j in zip(a, b)], np.int64)
    out = np.full(len(order), -1, np.int64)
    out[near + 1] = shared
    return by_group[order], out


def suffixes(items: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, seed: np.ndarray) -> tuple[Classes, Classes]:
    """Classes of occurrences by the bytes they share on each side, from two suffix arrays."""

    def numbers(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Classes:
        order, shared = array_and_extensions(values, starts, sizes, seed)

        def at(distance: int) -> np.ndarray:
            out = np.empty(len(order), np.int64)
            out[order] = np.cumsum(shared < distance)
            return out

        return at

    return numbers(items[::-1].copy(), len(items) - anchor, left), numbers(items, anchor, right)


def byte_items(own: Block, exact: bool = True) -> Items:
    return Items(own.buf, own.off, own.buf, lambda first, n: own.buf[gathered(first, n)].tobytes())


def unpacked(contents: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(contents), np.uint8)


def windows(length: int = LENGTH, gram: int = GRAM) -> Windows:
    if not 1 <= gram <= length <= 250:
        raise ValueError("1 <= gram <= length <= 250")
    return Windows(length, gram, byte_items, lambda x: BYTE[x], unpacked, suffixes)


def _finish(key, docs, replies):
    out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
    if docs.num_rows:
        own = block_of(docs)
        gone = removed(len(own.buf), replies)
        made = []
        for i, text in enumerate(own.texts):
            mask = gone[own.off[i] : own.off[i + 1]]
            starts, ends = runs(mask)
            kept = own.buf[own.off[i] : own.off[i + 1]][~mask].tobytes() if len(starts) else text
            spans = [{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist())]
            made.append((len(text), int(mask.sum()), len(spans), hashlib.sha256(kept).hexdigest(), kept, spans))
        for doc_id, i in zip(own.rows, own.row_of):
            for name, value in zip(out, (doc_id, *made[i])):
                out[name].append(value)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), span)
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hot: int = HOT
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, SHA-256 of the kept bytes, those bytes, and the removed spans."""
    return deduplicated(docs, windows(length, gram), _finish, SCHEMA, id_col, text_col, block_bytes, hot)

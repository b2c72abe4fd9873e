"""Repeated windows across documents: the part that word and byte substring dedup share.

A window is ``size`` consecutive items (words or bytes) of one document.  An item is
removed if a window that covers it also starts earlier (smaller doc_id, or same document,
earlier start).  All windows of all documents are compared, in two rounds between *blocks*
(documents dealt by a hash of doc_id) and *buckets* (seeds dealt by hash):

1. Seeds.  Each window selects a seed, the least-hashed run of ``gram`` items in it
   (leftmost on ties), so equal windows select equal seeds at equal places.  Blocks send
   their distinct seeds; buckets say which ones occur in more than one block.
2. Contexts.  The windows that select one seed occurrence are consecutive; the items they
   span are its context.  Blocks settle contexts that are equal item by item and send one of
   each kind, with its items.  A bucket tells windows apart by extending from the seed to both
   sides: ``classes`` numbers what lies left and what lies right of each occurrence, and two
   windows at the same place about their seed are equal where both numbers are.

Hashes choose seeds and deal them out; whether two windows are equal is decided on their items.

A block ships a context once however often it holds it, so copies of a very common passage
meet in a bucket at most once a block.  A seed with more than ``HOT`` different contexts is
not gathered: its windows are dealt out by the hash of all their items, so that only equal
ones meet.  Blocks and buckets are cut to ``BLOCK_BYTES`` of input each, whatever the
session's settings.  Messages are small rows (bucket, block, bytes); texts are dealt to
blocks once, and that exchange serves both rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, mix, text_bytes
from .words import FIRST, SECOND

MESSAGE = "bucket int, block int, data binary"
_NAMES = ["bucket", "block", "data"]
_KINDS = [pa.int32(), pa.int32(), pa.binary()]

_HEAD = np.dtype([("seed", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("start", "<u4"), ("n", "u1"), ("at", "u1")])
_RANGE = np.dtype([("start", "<u4"), ("end", "<u4")])

#: A null doc_id comes before all others.
NULL_DOC = -(1 << 63)
#: Places whose seeds are sought at once; the arrays stay in the processor's cache.
STEP = 1 << 15
#: Text in one block; the unit of memory in both rounds.
BLOCK_BYTES = 12 << 20
#: Different contexts of one seed that a bucket takes; beyond, windows are dealt out singly.
HOT = 50_000


@dataclass
class Block:
    """The distinct (doc_id, text) of one block in order, and which of them each row is."""

    ids: np.ndarray
    ties: np.ndarray
    rows: list
    row_of: list[int]
    texts: list[bytes]
    buf: np.ndarray
    off: np.ndarray


def block_of(table: pa.Table) -> Block:
    """Rows that repeat both doc_id and text are one document; rows that repeat a doc_id come in order of text."""
    ids, ties = table.column("doc_id").to_pylist(), table.column("tie").to_pylist()
    buf, off = text_bytes(table.column("text"))
    raw = buf.tobytes()
    texts = [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    keys = [(NULL_DOC if d is None else d, t) for d, t in zip(ids, ties)]
    order = sorted(range(len(ids)), key=lambda i: (keys[i], texts[i]))
    own, row_of, rows = [], [], []
    for i in order:
        if not own or keys[own[-1]] != keys[i] or texts[own[-1]] != texts[i]:
            own.append(i)
        row_of.append(len(own) - 1)
        rows.append(ids[i])
    kept = [texts[i] for i in own]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in kept])]).astype(np.int64)
    both = np.array([keys[i] for i in own], np.int64).reshape(-1, 2)
    return Block(both[:, 0], both[:, 1], rows, row_of, kept, np.frombuffer(b"".join(kept), np.uint8), ends)


@dataclass
class Items:
    """A block's items: what is hashed, each document's first item, and what decides equality."""

    values: np.ndarray
    off: np.ndarray
    exact: np.ndarray
    #: (starts, numbers of items) -> those items, one after another, as bytes.
    pack: Callable[[np.ndarray, np.ndarray], bytes]


#: Numbers, by context, of what lies within a distance left of the seed, or from the seed's start on to the right.
Classes = Callable[[int], np.ndarray]


@dataclass(frozen=True)
class Windows:
    size: int
    gram: int
    #: Items of a block; ``exact`` may be left out where only seeds are wanted.
    items: Callable[[Block, bool], Items]
    #: Items as 64-bit words.
    hashed: Callable[[np.ndarray], np.ndarray]
    #: Packed items, all of a bucket, as an array in which equal values are equal items.
    unpack: Callable[[list[bytes]], np.ndarray]
    #: (items, place of each seed, items left of it, items from it on, seed) -> left and right classes.
    classes: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[Classes, Classes]]


def spans(w: Windows, items: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the items between sorted starts and their ends."""
    out = np.zeros(len(start), np.uint64)
    for a in range(0, len(items), STEP):
        i, j = np.searchsorted(start, [a, a + STEP])
        if i < j:
            p = SECOND.prefixes(w.hashed(items[a : int(end[i:j].max())]))
            out[i:j] = SECOND.span(p, start[i:j] - a, end[i:j] - a)
    return out


def seeds(w: Windows, items: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each seed occurrence: seed hash, context hash, first window, number of windows, place of the seed in the first window."""
    size, gram = w.size, w.gram
    width = size - gram + 1
    last = len(items) - size  # the last place where a window may start
    parts = []
    if last >= 0:
        length = off[1:] - off[:-1]
        allowed = np.zeros(len(items) + 1, np.int32)
        own = length >= size
        np.add.at(allowed, off[:-1][own], 1)
        np.add.at(allowed, off[1:][own] - size + 1, -1)
        allowed = np.cumsum(allowed[:-1]) > 0
        local = np.arange(STEP + width, dtype=np.uint64)
        high = np.uint64(0xFFFFFFFF00000000)
        for a in range(0, last + 1, STEP):
            b = min(a + STEP, last + 1)
            starts = np.flatnonzero(allowed[a:b])
            if not len(starts):
                continue
            x = w.hashed(items[a : b - 1 + size])
            p = FIRST.prefixes(x)
            m = len(x) - gram + 1
            h = mix((p[gram : gram + m] - p[:m]) * FIRST.down[:m])
            least = (h & high) | local[:m]
            have = 1
            while have < width:
                s = min(have, width - have)
                least = np.minimum(least[:-s], least[s:])
                have += s
            at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            parts.append((h[at[new]], at[new] + a, starts[new] + a, np.diff(np.append(new, len(at)))))
    if not parts:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    seed, place, first, n = (np.concatenate(x) for x in zip(*parts))
    # an occurrence whose windows lie on both sides of a step was found twice
    join = np.concatenate([[False], place[1:] == place[:-1]])
    if join.any():
        n = np.add.reduceat(n, np.flatnonzero(~join))
        seed, place, first = seed[~join], place[~join], first[~join]
    context = spans(w, items, first, first + n - 1 + size)
    context = mix(context + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place - first).astype(np.uint64))
    return seed, context, first, n, place - first


def bucket_of(seed: np.ndarray, buckets: int) -> np.ndarray:
    return ((seed >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of a sorted array."""
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    return [(k, int(cut[k]), int(cut[k + 1])) for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist()]


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=_NAMES)


def merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranges joined where they touch."""
    out = np.zeros(len(start), _RANGE)
    if not len(start):
        return out
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    out = np.zeros(len(at), _RANGE)
    out["start"], out["end"] = start[at], end[np.append(at[1:], len(end)) - 1]
    return out


def distinct_seeds(seed: np.ndarray, context: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Distinct seeds ordered by bucket, their buckets, how often each occurs, its context hashes, and which seed each occurrence has."""
    kinds, of = np.unique(seed, return_inverse=True)
    bucket = bucket_of(kinds, buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    of = place[of]
    by = np.lexsort([context, of])
    new = np.ones(len(by), bool)
    new[1:] = (of[by][1:] != of[by][:-1]) | (context[by][1:] != context[by][:-1])
    size = len(kinds)
    return kinds[order], bucket[order], np.bincount(of, minlength=size), np.bincount(of[by][new], minlength=size), of


def send_seeds(w: Windows, buckets: int):
    def run(key, table):
        block = int(key[0].as_py())
        own = w.items(block_of(table), False)
        seed, context, *_ = seeds(w, own.values, own.off)
        kinds, bucket, _, contexts, _ = distinct_seeds(seed, context, buckets)
        contexts = np.minimum(contexts, 65535).astype("<u2")
        return messages([(k, block, kinds[a:b].tobytes() + contexts[a:b].tobytes()) for k, a, b in by_bucket(bucket, buckets)])

    return run


def judge_seeds(hot: int = HOT):
    """Back to each block, in its order: a bit a seed, whether another block has it, and a bit whether it is hot."""

    def run(key, table):
        blocks, data = table.column("block").to_pylist(), table.column("data").to_pylist()
        sizes = [len(d) // 10 for d in data]
        every = np.concatenate([np.frombuffer(d, "<u8", n) for d, n in zip(data, sizes)])
        contexts = np.concatenate([np.frombuffer(d, "<u2", n, 8 * n) for d, n in zip(data, sizes)])
        _, of, count = np.unique(every, return_inverse=True, return_counts=True)
        more, very = count[of] > 1, np.bincount(of, contexts)[of] > hot
        cut = np.cumsum(sizes)[:-1]
        return messages([(int(key[0].as_py()), b, np.packbits(m).tobytes() + np.packbits(v).tobytes()) for b, m, v in zip(blocks, np.split(more, cut), np.split(very, cut))])

    return run


def settled(exact: np.ndarray, size: int, group: np.ndarray, context: np.ndarray, first: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences to keep, and those equal, item by item, to an earlier one of the same group and context hash."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort([first, context, group])
    new = np.ones(len(order), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (context[order][1:] != context[order][:-1])
    model = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    tried = np.flatnonzero(~new)
    a, b = order[tried], model[tried]
    same = (n[a] == n[b]) & (at[a] == at[b])
    span = n[a] - 1 + size
    step = max(1, (1 << 20) // (2 * size))
    for i in range(0, len(a), step):
        x, y, s = a[i : i + step], b[i : i + step], span[i : i + step]
        head = np.cumsum(s) - s
        inner = np.arange(int(s.sum())) - np.repeat(head, s)
        left = np.repeat(first[x], s) + inner
        right = np.minimum(np.repeat(first[y], s) + inner, len(exact) - 1)
        same[i : i + step] &= np.logical_and.reduceat(exact[left] == exact[right], head)
    gone = np.zeros(len(order), bool)
    gone[tried[same]] = True
    return order[~gone], order[gone]


def send_contexts(w: Windows, buckets: int):
    def run(key, docs, replies):
        block = int(key[0].as_py())
        if not docs.num_rows:
            return messages([])
        own = block_of(docs)
        items = w.items(own, True)
        seed, context, first, n, at = seeds(w, items.values, items.off)
        kinds, bucket, count, _, of = distinct_seeds(seed, context, buckets)
        more, hot = np.zeros(len(kinds), bool), np.zeros(len(kinds), bool)
        bits = dict(zip(replies.column("bucket").to_pylist(), replies.column("data").to_pylist()))
        for k, a, b in by_bucket(bucket, buckets):
            both = np.frombuffer(bits[k], np.uint8).reshape(2, -1)
            more[a:b], hot[a:b] = (np.unpackbits(x)[: b - a].astype(bool) for x in both)
        sel = np.flatnonzero(((count > 1) | more)[of])
        of, seed, context, first, n, at = (x[sel] for x in (of, seed, context, first, n, at))
        keep, gone = settled(items.exact, w.size, of, context, first, n, at)
        ranges = [(first[gone], first[gone] + n[gone] - 1 + w.size)]
        keep = keep[(more[of] | (np.bincount(of[keep], minlength=len(kinds)) > 1)[of])[keep]]
        # the windows of hot seeds stand alone: the hash of all their items is their seed
        single = keep[hot[of[keep]]]
        if len(single):
            keep = keep[~hot[of[keep]]]
            each = np.repeat(single, n[single])
            inner = np.arange(len(each)) - np.repeat(np.cumsum(n[single]) - n[single], n[single])
            begin, place = first[each] + inner, at[each] - inner
            order = np.argsort(begin, kind="stable")
            begin, place = begin[order], place[order]
            own_seed = mix(spans(w, items.values, begin, begin + w.size))
            one = np.ones(len(begin), np.int64)
            stay, again = settled(items.exact, w.size, np.zeros(len(begin), np.int64), own_seed, begin, one, place)
            ranges.append((begin[again], begin[again] + w.size))
            seed, first, n, at = (np.concatenate([x[keep], y[stay]]) for x, y in ((seed, own_seed), (first, begin), (n, one), (at, place)))
        else:
            seed, first, n, at = (x[keep] for x in (seed, first, n, at))
        out = []
        start, end = (np.concatenate(x) for x in zip(*ranges))
        if len(start):
            out.append((-1 - block, block, merged(start, end).tobytes()))
        bucket = bucket_of(seed, buckets)
        order = np.lexsort([first, bucket])
        doc = np.searchsorted(items.off, first, "right") - 1
        head = np.zeros(len(order), _HEAD)
        for name, value in (("seed", seed), ("doc", own.ids[doc]), ("tie", own.ties[doc]), ("start", first), ("n", n), ("at", at)):
            head[name] = value[order]
        first, span, bucket = first[order], (n - 1 + w.size)[order], bucket[order]
        for k, a, b in by_bucket(bucket, buckets):
            out.append((k, block, np.uint32(b - a).tobytes() + head[a:b].tobytes() + items.pack(first[a:b], span[a:b])))
        return messages(out)

    return run


def judge_contexts(w: Windows):
    def run(key, table):
        if key[0].as_py() < 0:  # what a block sends to itself comes back as it is
            return table.select(_NAMES).cast(messages([]).schema)
        heads, contents = [], []
        for d in table.column("data").to_pylist():
            n = int(np.frombuffer(d, np.uint32, 1)[0])
            heads.append(np.frombuffer(d, _HEAD, n, 4))
            contents.append(d[4 + n * _HEAD.itemsize :])
        block = np.repeat(table.column("block").to_numpy(), [len(h) for h in heads])
        head, items = np.concatenate(heads), w.unpack(contents)
        n, at, start = (head[x].astype(np.int64) for x in ("n", "at", "start"))
        span = n - 1 + w.size
        begin = np.cumsum(span) - span
        # in order of document and place, of contexts whose seed meets another one
        _, of, count = np.unique(head["seed"], return_inverse=True, return_counts=True)
        sel = np.flatnonzero(count[of] > 1)
        order = sel[np.lexsort([(start + at)[sel], block[sel], head["tie"][sel], head["doc"][sel]])]
        of, n, at, start, span, begin, block = (x[order] for x in (of, n, at, start, span, begin, block))
        window = np.cumsum(n) - n
        repeats = np.zeros(int(n.sum()), bool)
        if len(order):
            left, right = w.classes(items, begin + at, at, span - at, of)
            for l in range(w.size - w.gram + 1):
                has = np.flatnonzero((at >= l) & (at - l < n))
                key_ = left(l)[has] * np.int64(len(order) + 1) + right(w.size - l)[has]
                by = np.argsort(key_, kind="stable")
                later = by[1:][key_[by][1:] == key_[by][:-1]]
                repeats[(window + at - l)[has[later]]] = True
        gone = np.flatnonzero(repeats)
        of_window = np.searchsorted(window, gone, "right") - 1
        place = start[of_window] + gone - window[of_window]
        of_block = block[of_window]
        order = np.argsort(of_block, kind="stable")
        place, of_block = place[order], of_block[order]
        out = []
        for b in np.unique(of_block).tolist():
            own = place[np.searchsorted(of_block, b) : np.searchsorted(of_block, b, "right")]
            out.append((int(key[0].as_py()), b, merged(own, own + w.size).tobytes()))
        return messages(out)

    return run


def removed(n_items: int, replies: pa.Table) -> np.ndarray:
    """Which items of a block are removed, from the ranges that came back."""
    edge = np.zeros(n_items + 1, np.int32)
    for d in replies.column("data").to_pylist():
        r = np.frombuffer(d, _RANGE)
        np.add.at(edge, r["start"].astype(np.int64), 1)
        np.add.at(edge, r["end"].astype(np.int64), -1)
    return np.cumsum(edge[:-1]) > 0


def parts_of(docs: DataFrame, n_bytes: int, block_bytes: int) -> int:
    """Tasks of a round: by the input's bytes, but on small inputs enough for all cores."""
    cores = 2 * docs.sparkSession.sparkContext.defaultParallelism
    return max(math.ceil(n_bytes / block_bytes), min(cores, math.ceil(n_bytes / (256 << 10))), 1)


def deduplicated(docs: DataFrame, w: Windows, finish, schema: str, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """``finish`` (key, documents of a block, its ranges) -> rows of ``schema``."""
    rows = id_and_text(docs, id_col, text_col)
    n_bytes = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = parts_of(docs, n_bytes, block_bytes)
    # rows without an id are dealt out, and ordered, by a hash of their text
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0).cast("long"))
    block = F.pmod(F.xxhash64("doc_id", tie), F.lit(parts).cast("long")).cast("int")
    # a partition is one block, or one bucket and what some blocks send to themselves
    dealt = rows.select("doc_id", "text", tie.alias("tie"), block.alias("block")).repartitionById(parts, F.col("block"))
    at_bucket = lambda df: df.repartitionById(parts, F.col("bucket")).groupBy("bucket")
    at_block = lambda df: dealt.groupBy("block").cogroup(df.repartitionById(parts, F.col("block")).groupBy("block"))
    one = dealt.groupBy("block").applyInArrow(send_seeds(w, parts), MESSAGE)
    two = at_block(at_bucket(one).applyInArrow(judge_seeds(hot), MESSAGE)).applyInArrow(send_contexts(w, parts), MESSAGE)
    return at_block(at_bucket(two).applyInArrow(judge_contexts(w), MESSAGE)).applyInArrow(finish, schema)

"""MinHash near-dedup by BagMinHash.

A text is the multiset of its runs of five words (A-Z lower-cased); a shingle's weight is how
often it occurs.  Each shingle has a Poisson process in the plane of weight and time.  The
weight axis is discretised at the integers and split into the dyadic blocks [0, 1), [1, 2),
[2, 4), ...; each block has its own process, whose points arrive in order of time with a
register and a place in the block, and a point counts where its place is below the weight.
A register keeps the earliest point, and a process is left as soon as its time is past all of
the document's registers.  Two signatures agree in a register with probability equal to the
weighted Jaccard similarity.

1. Texts of equal word sequences collapse into one bag, by a keyed 128-bit digest of those
   words; the key is drawn for each run.  Signatures of bags are cut into bands.
2. In each band's bucket the bag with the largest buckets altogether is the pivot; every other
   bag of a size that can reach the threshold is verified against it over the whole texts.
3. Links make components.  In buckets that still hold bags of different components, all pairs
   other than with the pivot are verified as well, each in the first bucket that the pair
   shares; large buckets are compared piece by piece in separate tasks, and only links leave
   them.

Verification counts shingles that are numbered by their words' bytes, so it doesn't rest on
hashes.  Rows are numbered once, in a written table; texts are dealt by row once, to pick those
of bags that share a bucket with another, and all verification reads that smaller table.

So a link is lost only where banding misses it (5e-8 at the threshold, less above it).

Defined results: texts without a word (null, empty, blank) are one class; texts of fewer than
five words have one shingle of all their words; of a class the row with the smallest doc_id
stays (null last), one row where it repeats; an empty table gives an empty result; only the
named columns are read, so others may have any name; very long texts are compared whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, give_back, lean, mix, pieces, text_bytes, with_group, written
from .words import SECOND, gathered, gram_numbers, word_hashes, word_numbers, words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
#: Bags of one bucket compared in one task.
PIECE = 1024
#: Pairs with one pivot verified side by side.
BESIDE = 64
#: Shingles looked up at once.
STEP = 1 << 18

_SIGNED = "row_id long, doc_id long, text string, bag_a long, bag_b long, n long, bands array<long>"


def _places(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, words, and of each shingle its first word, the end of its document's words and its document; each document's first shingle."""
    low = np.frombuffer(buf.tobytes().lower(), np.uint8)
    starts, ends, doc = words(low, off)
    n = np.bincount(doc, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(count)])
    own = np.repeat(np.arange(len(n)), count)
    return low, starts, ends, np.arange(at[-1]) - at[own] + first[own], first[own + 1], own, at


def shingles(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes with multiplicity, sorted within documents, and each document's first one; they only choose candidates."""
    low, starts, ends, begin, stop, own, at = _places(buf, off)
    h = word_hashes(low, starts, ends)
    out = np.zeros(at[-1], np.uint64)
    for j in range(SHINGLE):
        here = begin + j < stop
        out[here] += h[begin[here] + j] * SECOND.up[j + 1]
    out = mix(out)
    return out[np.lexsort([out, own])], at


def sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multisets of shingles as sorted sets of numbers, and each document's first one.

    Equal numbers are equal shingles, word by word, of all documents given together; the n-th
    occurrence of a shingle in its document has a number of its own.
    """
    low, starts, ends, begin, stop, own, at = _places(buf, off)
    word = np.append(word_numbers(low, starts, ends) + 1, np.zeros(SHINGLE, np.int64))  # 0 where a short text has no word
    part = [np.where(begin + j < stop, word[begin + j], 0) for j in range(SHINGLE)]
    h = np.zeros(at[-1], np.uint64)
    for j in range(SHINGLE):
        h = mix(h + part[j].astype(np.uint64) * SECOND.up[j + 1])
    _, model, number = np.unique(h, return_index=True, return_inverse=True)
    if not all((x == x[model[number]]).all() for x in part):  # hashes have collided
        flat = np.stack(part, 1).ravel()
        number = gram_numbers(flat, np.arange(at[-1]) * SHINGLE, SHINGLE)
    order = np.lexsort([number, own])
    number, own = number[order], own[order]
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (own[1:] != own[:-1])
    again = np.arange(len(number)) - np.maximum.accumulate(np.where(new, np.arange(len(number)), 0))
    return (number << np.int64(32)) + again, at


def signatures(hashes: np.ndarray, at: np.ndarray, registers: int) -> np.ndarray:
    """BagMinHash signatures of documents given by sorted shingle hashes."""
    docs = len(at) - 1
    least = np.full((docs, registers), np.inf)
    doc = np.repeat(np.arange(docs), np.diff(at))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    weight = np.diff(np.append(start, len(hashes)))
    value, doc = hashes[start], doc[start]
    # one process for each shingle and dyadic block that its weight reaches into
    parts = []
    block = 0
    while len(value):
        low, size = (0, 1) if block == 0 else (1 << block - 1, 1 << block - 1)
        parts.append((doc, value, weight, np.full(len(doc), low), np.full(len(doc), size), np.full(len(doc), block)))
        more = weight > low + size
        doc, value, weight = doc[more], value[more], weight[more]
        block += 1
    if not parts:
        return least
    doc, value, weight, low, size, block = (np.concatenate(x) for x in zip(*parts))
    state = mix(value + (block.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    time = np.zeros(len(doc))
    while len(doc):
        state = mix(state + np.uint64(0xD1B54A32D192ED03))
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / size
        other = mix(state ^ np.uint64(0x8CB92BA72F3D8DD7))
        place = low + ((other >> np.uint64(32)).astype(np.float64) / 2.0**32 * size).astype(np.int64)
        register = ((other & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64)
        take = place < weight
        np.minimum.at(least, (doc[take], register[take]), time[take])
        go = time < least.max(1)[doc]
        doc, weight, low, size, state, time = doc[go], weight[go], low[go], size[go], state[go], time[go]
    return least


def _sign(key: bytes, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 20):
            buf, off = text_bytes(batch.column(2))
            hashes, at = shingles(buf, off)
            keys = mix(signatures(hashes, at, BANDS * ROWS).view(np.uint64))
            bands = np.zeros((len(keys), BANDS), np.uint64)
            for r in range(ROWS):
                bands = mix(bands * np.uint64(0x9FB21C651E98DF25) + keys[:, r::ROWS])
            bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            low = buf.tobytes().lower()
            own = [b" ".join(low[a:b].split()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            bags = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16, key=key).digest() for x in own), "<i8").reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            text = batch.column(2) if with_text else pa.nulls(len(keys), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array(bags[:, 0].copy()), pa.array(bags[:, 1].copy()), pa.array(np.diff(at)), lists], [x.split()[0] for x in _SIGNED.split(", ")])

    return run


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets in the form of ``sets``."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


def within_reach(a: Column, b: Column) -> Column:
    """Whether multisets of these sizes can reach the threshold."""
    return (F.greatest(a, b) == 0) | (F.least(a, b) / F.greatest(a, b) >= THRESHOLD)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text_b", 1 << 20):
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        # pairs with one ``a`` come together: its text is taken once
        new = [i for i in range(len(a)) if i == 0 or a[i] != a[i - 1]]
        column = lambda i: pa.chunked_array([batch.column(i).cast(pa.large_string())])
        both = pa.chunked_array([*column(2).take(pa.array(new)).chunks, *column(3).chunks])
        marks, at = sets(*text_bytes(both))
        of, out = -1, []
        for i in range(len(a)):
            of += i in new[of + 1 : of + 2]
            j = len(new) + i
            if similarity(marks[at[of] : at[of + 1]], marks[at[j] : at[j + 1]]) >= THRESHOLD:
                out.append((a[i], b[i]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar; a text ``a`` with many partners is dealt out by a salt."""
    many = F.greatest(F.lit(1), F.ceil(F.col("n") / BESIDE)).cast("int")
    sides = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = with_group(pairs, sides, ["a"], "n", pairs.count()).select("a", "b", F.pmod(F.hash("b"), many).alias("salt"))
    right = dealt.join(texts.select(F.col("row_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    left = sides.select("a", F.explode(F.sequence(F.lit(0), many - 1)).alias("salt")).join(texts.select(F.col("row_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    return right.join(left.hint("merge"), ["a", "salt"]).select("a", "b", "text_a", "text_b").mapInArrow(lean(_verify), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(row_id, root) of all rows that have links; each round joins components by their smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("row_id"), F.least("a", "b").alias("root")), "labels")
    while True:
        one = labels.select(F.col("row_id").alias("a"), F.col("root").alias("root_a"))
        two = labels.select(F.col("row_id").alias("b"), F.col("root").alias("root_b"))
        apart = links.join(one, "a").join(two, "b").filter("root_a != root_b")
        # a root may itself have moved on: its own label says where to
        moved = labels.filter("row_id != root").select(F.col("row_id").alias("old"), F.col("root").alias("new"))
        hooks = written(apart.select(F.greatest("root_a", "root_b").alias("old"), F.least("root_a", "root_b").alias("new")).unionByName(moved).groupBy("old").agg(F.min("new").alias("new")), "hooks")
        after = written(labels.join(hooks, labels["root"] == hooks["old"], "left").select("row_id", F.coalesce("new", "root").alias("root")), "labels")
        done = after.join(labels.withColumnRenamed("root", "was"), "row_id").filter("root != was").isEmpty()
        discard(hooks, labels)
        if done:
            return after
        labels = after


def linked_to(i: int, others: np.ndarray, marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of ``others`` that reach the threshold with document ``i``; ``marks`` are in the form of ``sets``."""
    bag, size = marks[at[i] : at[i + 1]], np.diff(at)[others]
    others = others[np.minimum(size, len(bag)) / np.maximum(np.maximum(size, len(bag)), 1) >= (THRESHOLD if len(bag) else 0)]
    if not len(bag):
        return others[np.diff(at)[others] == 0]
    out = []
    size = np.diff(at)[others]
    cut = np.flatnonzero(np.diff(np.cumsum(size) // STEP, prepend=-1))
    for part, n in zip(np.split(others, cut[1:]), np.split(size, cut[1:])):
        if len(part):
            first = np.cumsum(n) - n
            x = marks[np.arange(n.sum()) + np.repeat(at[part] - first, n)]
            place = np.searchsorted(bag, x)
            common = np.add.reduceat((bag[np.minimum(place, len(bag) - 1)] == x).astype(np.int64), first)
            out.append(part[common / (n + len(bag) - common) >= THRESHOLD])
    return np.concatenate(out) if out else others


def _rest(key, table):
    """Links within a bucket, or between two of its pieces, of rows of different roots."""
    n = table.num_rows
    bucket, row, root, band, part, side = (table.column(c).to_numpy() for c in ("key", "row_id", "root", "band", "own", "other"))
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(n, -1)
    _, one, of = np.unique(row, return_index=True, return_inverse=True)
    marks, at = sets(*text_bytes(table.column("text").take(pa.array(one))))
    order = np.lexsort([row, bucket])
    cut = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1], [True]]))
    out = []
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
        here = order[s:e]
        within = part[here[0]] == side[here[0]]
        left, right = (here, here) if within else (here[part[here] < side[here]], here[part[here] > side[here]])
        for i in left.tolist():
            j = right[row[right] > row[i]] if within else right
            j = j[root[j] != root[i]]
            if len(j):
                j = j[(bands[j] == bands[i]).argmax(1) == band[i]]  # another bucket sees to the pairs of an earlier band
                out += [(int(row[i]), x) for x in row[one[linked_to(of[i], of[j], marks, at)]].tolist()]
    return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])


def _rest_alone(key, table):
    try:
        return _rest(key, table)
    finally:
        give_back()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_id: str | None = None) -> DataFrame:
    """Per row: row_id, doc_id, class_id (doc_id of the row that stays), class_size, kept.

    ``row_id`` names a column that tells rows apart and is the same whenever ``docs`` is read;
    without it rows are numbered once, in a written table.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rid = F.col(row_id).cast("long") if row_id else F.monotonically_increasing_id()
    texts = docs.select(rid.alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = written(texts.mapInArrow(lean(_sign(os.urandom(16), row_id is None)), _SIGNED), "signed")
    texts = texts if row_id else signed
    total = signed.count()
    low = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row_id")
    bags = written(signed.groupBy("bag_a", "bag_b").agg(F.min(low).alias("first"), F.count("*").alias("rows")), "bags")
    reps = written(signed.select("row_id", "n", "bands").join(bags.select(F.col("first.row_id").alias("row_id")), "row_id", "left_semi"), "bag_signatures")
    banded = reps.select("row_id", "n", F.posexplode("bands").alias("band", "key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = written(with_group(banded, sizes, ["key"], "size", BANDS * total).filter("size is not null"), "buckets")
    n_members = buckets.count()
    score = buckets.groupBy("row_id").agg(F.sum("size").alias("score"))
    picked = written(texts.select("row_id", "text").join(score.select("row_id").hint("merge"), "row_id", "left_semi"), "texts")
    pivots = buckets.join(score, "row_id").groupBy("key").agg(F.max(F.struct("score", "row_id", "n")).alias("best"), F.count("*").alias("size")).select("key", "size", F.col("best.row_id").alias("pivot"), F.col("best.n").alias("pivot_n"))
    members = written(with_group(buckets.select("row_id", "n", "band", "key"), pivots, ["key"], "size", n_members), "members")
    pairs = written(members.filter(F.expr("row_id != pivot") & within_reach(F.col("n"), F.col("pivot_n"))).select(F.col("pivot").alias("a"), F.col("row_id").alias("b")).distinct(), "pairs")
    links = written(verified(pairs, picked), "links")
    labels = components(links)

    others = members.filter("row_id != pivot and size > 2").join(labels, "row_id", "left").select("key", "band", "row_id", F.coalesce("root", "row_id").alias("root"))
    mixed = others.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("left")).filter("lo != hi").select("key", "left")
    rest = written(with_group(others, mixed, ["key"], "left", n_members).filter("left is not null"), "rest")
    if not rest.isEmpty():
        shares = F.ceil(F.col("left") / PIECE).cast("int")
        own = rest.join(reps.select("row_id", "bands").hint("merge"), "row_id").join(picked.hint("merge"), "row_id").withColumn("own", F.pmod(F.hash("row_id"), shares))
        own = own.withColumn("other", F.explode(F.sequence(F.lit(0), shares - 1)))
        group = F.when(shares == 1, F.pmod(F.xxhash64("key"), F.lit(4 * parts))).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
        tried = own.withColumn("group", group).select("group", "key", "band", "row_id", "root", "bands", "text", "own", "other")
        more = written(tried.groupBy("group").applyInArrow(_rest_alone, "a long, b long"), "more_links")
        if not more.isEmpty():
            every = written(links.unionByName(more), "all_links")
            discard(labels)
            labels = components(every)
            discard(every)
        discard(more)
    discard(buckets, picked, members, pairs, links, rest, reps)

    rooted = written(bags.join(labels, F.col("first.row_id") == labels["row_id"], "left").select("bag_a", "bag_b", "first", "rows", F.coalesce("root", "first.row_id").alias("root")), "rooted")
    classes = rooted.groupBy("root").agg(F.min("first").alias("keep"), F.sum("rows").alias("class_size"), F.count("*").alias("bags"))
    by_bag = written(with_group(rooted.select("bag_a", "bag_b", "rows", "root"), classes, ["root"], "bags", total).select("bag_a", "bag_b", "rows", "keep", "class_size"), "classes")
    discard(bags, labels, rooted)
    out = with_group(signed.select("row_id", "doc_id", "bag_a", "bag_b"), by_bag, ["bag_a", "bag_b"], "rows", total)
    return out.select("row_id", "doc_id", F.col("keep.doc_id").alias("class_id"), "class_size", (F.col("row_id") == F.col("keep.row_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows are numbered once, in a written table."""
    row = fresh(docs, "row_id")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    stay = near_groups(numbered, id_col, text_col, row).filter("kept").select(F.col("row_id").alias(row))
    return numbered.join(stay, row, "left_semi").select(*docs.columns)

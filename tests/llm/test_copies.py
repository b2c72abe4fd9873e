import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.llm import exact_dedup, near_dedup, words
from quarryline.llm.common import text_bytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact(docs, rows, ordered):
    got = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for i, x in rows:
        groups[(x or "").translate(LOWER)].append(i)
    want = []
    for low, ids in groups.items():
        keep = max(ids, key=lambda i: -1 if i is None else i)
        want += [(i, keep, len(ids), hashlib.sha256(low.encode()).hexdigest()) for i in ids]
    assert ordered((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == ordered(want)
    assert sum(r.kept for r in got) == len(groups)
    stay = exact_dedup.drop_exact_copies(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)


def test_colliding_chunk_keys_are_told_apart(docs, ordered):
    want = ordered(exact_dedup.exact_groups(docs).drop("row_id", "kept").collect())
    for key_bytes in (0, 1):  # all chunks, or many, share an identifier at first
        assert ordered(exact_dedup.exact_groups(docs, key_bytes=key_bytes).drop("row_id", "kept").collect()) == want
    rows = docs.selectExpr("monotonically_increasing_id() AS row_id", "doc_id", "text")
    assert not exact_dedup.chunk_table(rows, 1).filter("not verified").isEmpty()
    assert exact_dedup.chunk_table(rows).filter("not verified").isEmpty()


def test_recipes_decide_and_not_the_reported_digest(docs, ordered, monkeypatch):
    want = ordered(exact_dedup.exact_groups(docs).drop("row_id", "kept", "text_sha256").collect())
    true = exact_dedup.verified_recipes
    monkeypatch.setattr(exact_dedup, "verified_recipes", lambda *a: true(*a).withColumn("text_sha256", F.lit("same")))
    assert ordered(exact_dedup.exact_groups(docs).drop("row_id", "kept", "text_sha256").collect()) == want


def test_colliding_recipe_digests_are_told_apart(docs, ordered, monkeypatch):
    want = ordered(exact_dedup.exact_groups(docs).drop("row_id", "kept").collect())
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("same"))
    assert ordered(exact_dedup.exact_groups(docs).drop("row_id", "kept").collect()) == want


@pytest.mark.parametrize("dropped", [exact_dedup.drop_exact_copies, near_dedup.drop_near_copies])
def test_rows_are_numbered_once(spark, docs, dropped):
    """Other file splits at the time the result is read, and columns named as the operators' own."""
    more = docs.withColumnsRenamed({"kept": "__row", "lang": "list_id"}).withColumn("__row", F.monotonically_increasing_id()).withColumn("ROW_ID_", F.lit("x"))
    path = f"{spark.conf.get('spark.checkpoint.dir')}/{dropped.__name__}"
    more.write.parquet(path)
    table = spark.read.parquet(path)
    out = dropped(table)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = sorted(out.collect(), key=str)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert sorted(out.collect(), key=str) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert out.columns == table.columns and {r["__row"] for r in want} <= {r["__row"] for r in table.collect()}
    assert {r["ROW_ID_"] for r in want} == {"x"}


def test_cuts_stay_in_bounds():
    data = np.random.default_rng(0).integers(0, 256, 200_000, dtype=np.uint8)
    cand = np.flatnonzero((exact_dedup.gear(data) & np.uint32(0xFFE00000)) == 0) + 1
    ends = exact_dedup.cuts(cand, 0, len(data))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= exact_dedup.MAX_CHUNK and sizes[:-1].min() >= exact_dedup.MIN_CHUNK


def bag(x):
    w = (x or "").encode().lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similar(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


@pytest.fixture(scope="module")
def spread(spark, rows, tmp_path_factory):
    """Rows and a family of edits of one text, near and far."""
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefghij"), 6))
    base = [word() for _ in range(150)]
    made = list(rows)
    for i in range(150):
        own = list(base)
        for j in r.choice(150, r.integers(0, 9), replace=False):
            own[j] = word()
        made.append((8000 + i, " ".join(own)))
    path = str(tmp_path_factory.mktemp("near") / "d.parquet")
    spark.createDataFrame(made, "doc_id long, text string").repartition(4).write.parquet(path)
    return made, spark.read.parquet(path)


def near_classes(made):
    """Classes of near copies, as lists of places in ``made``: every pair that shares a shingle is compared."""
    bags = [bag(x) for _, x in made]
    root = list(range(len(made)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, b in enumerate(bags):
        for j in {j for g in b for j in holders[g]} if b else [k for k in range(i) if not bags[k]]:
            if not b or similar(b, bags[j]) >= near_dedup.THRESHOLD:
                root[find(i)] = find(j)
        for g in b:
            holders[g].append(i)
    classes = defaultdict(list)
    for i in range(len(made)):
        classes[find(i)].append(i)
    return list(classes.values())


def test_near(spread, ordered):
    made, df = spread
    classes = near_classes(made)
    want = []
    for places in classes:
        ids = [made[i][0] for i in places]
        keep = min(ids, key=lambda i: (i is None, i or 0))
        want += [(d, keep, len(ids)) for d in ids]
    got = near_dedup.near_groups(df).collect()
    assert ordered((r.doc_id, r.class_id, r.class_size) for r in got) == ordered(want)
    assert sum(r.kept for r in got) == len(classes)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    a = np.sort(np.repeat(rng.integers(0, 1 << 63, 40, dtype=np.uint64), rng.integers(1, 9, 40)))
    b = np.sort(np.concatenate([a[: len(a) * 3 // 4], rng.integers(0, 1 << 63, 20, dtype=np.uint64)]))
    both, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    s = near_dedup.signatures(both, at, 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(similar(Counter(a.tolist()), Counter(b.tolist())), abs=0.03)


@pytest.mark.parametrize("same_hash", [False, True])
def test_verification_rests_on_words(monkeypatch, same_hash):
    """Words of equal polynomial hashes, and all words of one hash."""
    if same_hash:
        monkeypatch.setattr(words, "word_hashes", lambda buf, starts, ends: np.ones(len(starts), np.uint64))
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, two = ("".join(x[b] for b in bits) for x in ("ab", "ba"))
    texts = [" ".join([one] * 6), " ".join([two] * 6), " ".join([one] * 6).upper(), "a b c d e f g", "a b c d e f h", "a b", "a b ", "", " ", "a b c a b c a b c a b c a b"]
    column = pa.chunked_array([pa.array(texts)])
    marks, at = near_dedup.sets(*text_bytes(column))
    for i in range(len(texts)):
        for j in range(len(texts)):
            want = similar(bag(texts[i]), bag(texts[j])) if bag(texts[i]) or bag(texts[j]) else 1.0
            assert near_dedup.similarity(marks[at[i] : at[i + 1]], marks[at[j] : at[j + 1]]) == want


def test_pairs_without_a_pivot_are_all_verified(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(near_dedup, "STEP", 100, raising=False)
    base = [f"w{x}" for x in rng.integers(0, 999, 90)]
    texts = ["", "", " ".join(base)]
    for k in rng.integers(1, 14, 40).tolist():
        texts.append(" ".join([*base[:k], *base[2 * k % 7 :], *(["x", "y"] * (k % 4))]))
    n = len(texts)
    # the registers disagree, as those of a similar pair may by chance
    columns = {"key": [7] * n, "band": [0] * n, "row_id": range(n), "root": range(n), "bands": [[7] * near_dedup.BANDS] * n, "text": texts, "own": [0] * n, "other": [0] * n}
    columns["signature"] = [rng.bytes(2 * near_dedup.BANDS * near_dedup.ROWS) for _ in range(n)]
    got = near_dedup._rest(None, pa.table({k: list(v) for k, v in columns.items()})).to_pylist()
    bags = [bag(x) for x in texts]
    want = [(i, j) for i in range(n) for j in range(i + 1, n) if (similar(bags[i], bags[j]) if bags[i] or bags[j] else 1) >= near_dedup.THRESHOLD]
    assert 100 < len(want) < n * (n - 1) / 2 - 100 and sorted((r["a"], r["b"]) for r in got) == want


def test_large_buckets_are_compared_piece_by_piece(spread, monkeypatch, ordered):
    _, df = spread
    whole = near_dedup.near_groups(df).collect()
    monkeypatch.setattr(near_dedup, "PIECE", 8)
    monkeypatch.setattr(near_dedup, "BESIDE", 4)
    assert ordered(near_dedup.near_groups(df).collect()) == ordered(whole)


def test_empty(empty):
    assert exact_dedup.exact_groups(empty).collect() == [] and near_dedup.near_groups(empty).collect() == []

import hashlib
import re

import numpy as np
import pytest

import pyarrow as pa

from quarryline.llm import repeats, substring_dedup, suffix_dedup, words
from quarryline.llm.repeats import STEP, seeds


def brute(rows, units, size):
    """Units and removal marks of each row, by a set of all windows in order."""
    key = lambda r: (-(1 << 63) if r[0] is None else r[0], (r[1] or "").encode())
    seen, made = set(), {}
    for d in sorted({key(r) for r in rows}):
        u = units(d[1])
        mask = bytearray(len(u))
        for i in range(len(u) - size + 1):
            w = tuple(u[i : i + size]) if isinstance(u, list) else u[i : i + size]
            if w in seen:
                mask[i : i + size] = b"\1" * size
            else:
                seen.add(w)
        made[d] = (u, mask)
    return [(r[0], *made[key(r)]) for r in rows]


def test_words(docs, rows, ordered):
    got = substring_dedup.without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = [(i, len(u), sum(m), hashlib.sha256(b" ".join(x for x, y in zip(u, m) if not y)).hexdigest()) for i, u, m in brute(rows, lambda x: x.split(), 20)]
    assert ordered(got) == ordered(want) and any(w[2] for w in want)


def test_bytes(docs, rows, ordered):
    got = suffix_dedup.without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = [(i, len(u), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(bytes(x for x, y in zip(u, m) if not y)).hexdigest()) for i, u, m in brute(rows, lambda x: x, 100)]
    assert ordered(got) == ordered(want) and any(w[2] for w in want)


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_empty(empty, module):
    assert module.without_repeats(empty).collect() == []


def test_every_window_has_one_seed_across_steps():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 100, 3 * STEP + 77, dtype=np.uint8)
    w = suffix_dedup.windows()
    seed, _, first, n, at = seeds(w, buf, np.array([0, 50, 51, 2 * STEP, len(buf)]))
    covered = np.concatenate([np.arange(a, a + k) for a, k in zip(first, n)])
    want = [i for a, b in ((51, 2 * STEP), (2 * STEP, len(buf))) for i in range(a, b - 99)]
    assert covered.tolist() == want
    assert ((at - n + 1 >= 0) & (at <= 64)).all()
    grams = [buf[a + k : a + k + 36].tobytes() for a, k in zip(first.tolist(), at.tolist())]
    assert len(set(zip(grams, seed.tolist()))) == len(set(grams))


def test_suffix_sort():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 2, 4000, dtype=np.uint8)
    starts, sizes, group = np.arange(0, 3000, 3), rng.integers(0, 41, 1000), np.repeat([0, 1, 2, 3], 250)
    text = [items[a : a + n].tobytes() for a, n in zip(starts, sizes)]
    order = suffix_dedup.suffix_sort(suffix_dedup.Extensions(items), starts, sizes, group)
    assert order.tolist() == sorted(range(1000), key=lambda i: (group[i], text[i], i))
    order, shared = suffix_dedup.array_and_extensions(items, starts, sizes, group[::-1])
    assert order.tolist() == sorted(range(1000), key=lambda i: (group[::-1][i], text[i], i))
    common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert shared.tolist() == [-1 if i % 250 == 0 else common(text[order[i - 1]], text[order[i]]) for i in range(1000)]


def test_suffix_sort_is_right_when_all_hashes_collide(monkeypatch):
    rng = np.random.default_rng(2)
    items = rng.integers(0, 3, 600, dtype=np.uint8)
    starts, sizes = np.arange(0, 500), np.full(500, 20)
    monkeypatch.setattr(suffix_dedup.Extensions, "span", lambda self, start, length: np.zeros(len(start), np.uint64))
    order, shared = suffix_dedup.array_and_extensions(items, starts, sizes, np.zeros(500, np.int64))
    assert order.tolist() == sorted(range(500), key=lambda i: (items[i : i + 20].tobytes(), i)) and shared[1:].min() >= 0


def test_extensions_across_spans():
    rng = np.random.default_rng(3)
    items = np.tile(rng.integers(0, 256, 1000, dtype=np.uint8), 200)
    ext = suffix_dedup.Extensions(items)
    a, n = np.arange(65436, 65636), np.full(200, 100)
    assert (ext.common(a, a + 1000, n, n) == 100).all() and (ext.common(a, a + 1, n, n) < 100).all()


def by_hand(w, texts, blocks, hot=repeats.HOT):
    """Both rounds in this process; the removal marks of each text."""
    dealt = {}
    for i, t in enumerate(texts):
        dealt.setdefault(i % blocks, []).append({"doc_id": i, "text": t, "tie": 0})
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("tie", pa.int64())])
    docs = {b: pa.Table.from_pylist(r, kind) for b, r in dealt.items()}

    def grouped(tables, by):
        rows = [r for t in tables for r in t.to_pylist()]
        keys = {r[by] for r in rows}
        schema = pa.schema(list(zip(repeats._NAMES, repeats._KINDS)))
        return {k: pa.Table.from_pylist([r for r in rows if r[by] == k], schema) for k in keys}

    none = repeats.messages([])
    key = lambda k: (pa.scalar(k, pa.int64()),)
    one = grouped([repeats.send_seeds(w, 3)(key(b), t) for b, t in docs.items()], "bucket")
    back = grouped([repeats.judge_seeds(hot)(key(k), t) for k, t in one.items()], "block")
    two = grouped([repeats.send_contexts(w, 3)(key(b), t, back.get(b, none)) for b, t in docs.items()], "bucket")
    back = grouped([repeats.judge_contexts(w)(key(k), t) for k, t in two.items()], "block")
    marks = {}
    for b, t in docs.items():
        own = repeats.block_of(t)
        items = w.items(own, True)
        gone = repeats.removed(len(items.values), back.get(b, none))
        for i, n in enumerate(own.ids.tolist()):
            marks[n] = gone[items.off[i] : items.off[i + 1]].tolist()
    return [marks[i] for i in range(len(texts))]


def thue_morse(n):
    """Two words of n letters with equal polynomial hashes modulo 2 ** 64, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def mixed_texts():
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 50, 400)]
    texts = [" ".join(base[a : a + n]) for a, n in zip(rng.integers(0, 300, 40), rng.integers(5, 100, 40))]
    for n in (1024, 4096):
        one, two = thue_morse(n)
        own = [f"u{n}x{i}" for i in range(19)]
        texts += [" ".join([*own, one]), " ".join([*own, two]), " ".join([*own[:9], two, *own[9:]])]
    return texts + [""]


@pytest.mark.parametrize("hot", [repeats.HOT, 2, 0])
@pytest.mark.parametrize("same_hash", [False, True])
def test_words_are_compared_by_their_bytes(monkeypatch, hot, same_hash):
    if same_hash:
        constant = lambda buf, starts, ends: np.ones(len(starts), np.uint64)
        monkeypatch.setattr(substring_dedup, "word_hashes", constant)
        monkeypatch.setattr(words, "word_hashes", constant)
    texts = mixed_texts()
    want = [list(map(bool, m)) for _, _, m in brute(list(enumerate(texts)), lambda x: x.split(), 20)]
    assert by_hand(substring_dedup.windows(), texts, 5, hot) == want and any(map(any, want))


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
@pytest.mark.parametrize("same_hash", [False, True])
def test_bytes_are_compared_themselves(monkeypatch, hot, same_hash):
    if same_hash:
        monkeypatch.setattr(suffix_dedup, "BYTE", np.ones(256, np.uint64))
    texts = mixed_texts()[:30] + ["é" * 70, "é" * 71, "ab" * 60]
    want = [list(map(bool, m)) for _, _, m in brute(list(enumerate(texts)), lambda x: x, 100)]
    assert by_hand(suffix_dedup.windows(), texts, 5, hot) == want and any(map(any, want))


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_blocks_and_hot_seeds_change_nothing(docs, module, ordered):
    whole = module.without_repeats(docs).drop("kept", "spans").collect()
    assert ordered(module.without_repeats(docs, block_bytes=20_000, hot=3).drop("kept", "spans").collect()) == ordered(whole)


def test_word_numbers():
    long = thue_morse(70_000)
    text = " ".join(["one", "two", "one", *long, long[0], "x" * 65536, "two"]).encode()
    buf = np.frombuffer(text, np.uint8)
    starts, ends, _ = words.words(buf, np.array([0, len(buf)]))
    n = words.word_numbers(buf, starts, ends).tolist()
    assert n[0] == n[2] and n[1] == n[7] and n[3] == n[5] and len(set(n)) == 5

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from quarryline.llm import byte_bpe, packing


def test_bpe_equals_the_rank_merges(docs, rows, ordered):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, x in rows:
        ids = t.encode_ordinary(x or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    got = byte_bpe.encoded(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert ordered(got) == ordered(want)


def test_worker_memory_starts_afresh(monkeypatch):
    c = byte_bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"))
    first = c.encode(["one two three four"])
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 2)
    assert c.encode(["five"]) and c.encode(["one two three four"]) == first and len(c.known) <= 4


def test_packing(docs, rows, ordered):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packing.packed(docs).collect()
    by = {}
    for r in got:
        assert r.length == 1 << r.bucket and r.offset == 0 and len(r.ids) == 4 * r.length
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert len({r.sequence_id for r in got}) == len(got)
    pieces = []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        at = 0
        for size in packing.binary_lengths(len(ids), 2048):
            pieces.append((i, at, size, np.array(ids[at : at + size], "<u4").tobytes(), len(ids)))
            at += size
        assert at == len(ids)
    assert ordered((r.doc_id, r.start, r.length, bytes(r.ids), r.doc_tokens) for r in got) == ordered(pieces)


def test_lengths():
    assert packing.binary_lengths(5003, 2048) == [2048, 2048, 512, 256, 128, 8, 2, 1]


def test_empty(empty):
    assert packing.packed(empty).collect() == [] and byte_bpe.encoded(empty).collect() == []

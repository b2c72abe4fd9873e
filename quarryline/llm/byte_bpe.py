"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

The rank file's tokens are bytes.  Each byte is written as one printable character, a
token as the string of its bytes' characters, and the tokens are serialised, without
any training, as the pieces of a sentencepiece BPE model: score = minus rank, identity
normalisation, no dummy prefix, white space kept.  Merging the best-scored adjacent pair,
leftmost first, is then the merge order of the ranks.  Texts are cut into pre-tokens;
each distinct pre-token is encoded once per worker.  Decoding maps ids back to bytes.

Defined results: a null or empty text has no tokens and decodes to no bytes; rows are
independent of one another, so repeated rows and ties need no rule.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .common import id_and_text, pieces
from .pretoken import splitter

#: Distinct pre-tokens that a worker remembers before it starts afresh (memory bound).
REMEMBERED = 1_000_000

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded_sha256 string, ids_sha256 string"


def byte_characters() -> list[str]:
    """A printable character for each byte value; none is white space or sentencepiece's own mark."""
    return [chr(0x21 + b) if b < 0x5E else chr(0x100 + b) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes by length, int as varint, float as 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"ranks in {path} are not 0 to {len(ranks) - 1}")
    return [ranks[i] for i in range(len(ranks))]


def serialised_model(tokens: list[bytes]) -> bytes:
    """The ModelProto of ``tokens``; id = rank, and the id after the last is <unk>."""
    chars = byte_characters()
    spell = lambda t: "".join(chars[b] for b in t).encode()
    out = bytearray()
    for rank, token in enumerate(tokens):
        out += _field(1, _field(1, spell(token)) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    no_id = (1 << 64) - 1  # -1
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(24, 0) + _field(40, len(tokens)) + _field(41, no_id) + _field(42, no_id) + _field(43, no_id)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class Codec:
    """Encodes and decodes by the ranks in ``path`` and the pre-token pattern ``pattern``."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.names = [str(i) for i in range(len(self.tokens))]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.tokens))
        self.find = splitter(pattern)
        self.spelling = byte_characters()
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known = {}
        spelled = [w.encode("utf-8").decode("latin-1").translate(self._table) for w in words]
        for word, ids in zip(words, self.model.encode(spelled, num_threads=1)):
            self.known[word] = np.array(ids, "<u4").tobytes()

    @functools.cached_property
    def _table(self) -> dict[int, str]:
        return dict(enumerate(self.spelling))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        split = [self.find(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if new and len(self.known) + len(new) > REMEMBERED:
            new = set().union(*split)
        if new:
            self._learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.cache
def codec(name: str) -> Codec:
    """``name``: a path, or the name of a file of the tokenizers' package on the worker."""
    return Codec(name if os.path.isabs(name) else public_tokenizers.path(name))


def encoded(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids (binary, 32-bit little-endian), SHA-256 of the decoded bytes and of the ids in decimal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for batch in pieces(batches, most=1 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = c.encode(texts)
            lists = [np.frombuffer(x, "<u4").tolist() for x in ids]
            decoded = [hashlib.sha256(c.decode(x)).hexdigest() for x in lists]
            named = [hashlib.sha256(",".join(map(c.names.__getitem__, x)).encode()).hexdigest() for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, lists)), pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string()), pa.array(named, pa.string())], ["doc_id", "n_tokens", "ids", "decoded_sha256", "ids_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)

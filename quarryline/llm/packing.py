"""Packing by power-of-two decomposition.

A document's ids (its tokens and one end id) are split into as many pieces of
``length`` ids as fit and then into pieces of falling powers of two, the binary digits
of what is left.  Pieces of equal length form a bucket; each is a sequence of its own, so
no sequence crosses documents and, every length being a power of two, nothing is padded.
A batch is drawn from one bucket.  No shuffle is needed.

Tokenising remembers the ids of each distinct run without white space.  New runs are
encoded together, one space between them, by the tokenizer itself; tokens that end a word
tell them apart.
Texts beyond Latin letters, or with a special token's own string, go to the tokenizer whole.

Defined results: a null or empty text is the end id alone, one piece of length 1; each row
is a document, also where doc_ids repeat, and sequence ids tell rows apart.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, id_and_text, lean, pieces
from .pretoken import splitter

#: Distinct words that a worker remembers before it starts afresh, unless one piece of the input has more (memory bound: about 0.2 kB each).
REMEMBERED = 1_000_000
#: Bytes of text that are tokenised at once; a longer text stands alone.
PIECE = 1 << 20
#: Characters of new words encoded at once.
AT_ONCE = 2_000
#: Characters that str.split takes for white space and the tokenizer doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"


class WordTokenizer:
    """Ids of whole texts by a lower-casing BPE tokenizer whose tokens mark the ends of words."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        import json

        spec = json.loads(self.tokenizer.to_str())
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = splitter(pattern)
        self.special = [t["content"] for t in spec["added_tokens"]]
        size = self.tokenizer.get_vocab_size()
        end = spec["model"]["end_of_word_suffix"]
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith(end) for i in range(size)])
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bool:
        """Whether normalising only lower-cases, and ``str.split`` cuts where the tokenizer sees white space."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not _SEPARATORS.search(text) and not any(s in text for s in self.special)

    def _learn(self, words: list[str]) -> None:
        texts, groups, at = [], [], 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (size < AT_ONCE or end == at):
                size += len(words[end]) + 1
                end += 1
            groups.append(words[at:end])
            texts.append(" ".join(words[at:end]))
            at = end
        for part, made in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(made.ids, "<u4")
            last = np.flatnonzero(self.ends_word[ids]) + 1
            pretokens = np.cumsum([len(self.split(w)) for w in part])
            if len(last) != pretokens[-1]:
                raise ValueError("the tokenizer doesn't mark the ends of words")
            start = 0
            for word, stop in zip(part, last[pretokens - 1].tolist()):
                self.known[word] = ids[start:stop].tobytes()
                start = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        split = [t.lower().split() if self._plain(t) else None for t in texts]
        words = set().union(*(s for s in split if s))
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.remembered:
            self.known, new = {}, words
        if new:
            self._learn(sorted(new))
        get = self.known.__getitem__
        return [self._whole(t) if s is None else b"".join(map(get, s)) for s, t in zip(split, texts)]


def tokenizer(name: str, remembered: int = REMEMBERED) -> WordTokenizer:
    """Kept by a worker, with the words that it remembers, until it serves another operator."""
    return held(f"packing {name} {remembered}", lambda: WordTokenizer(name if os.path.isabs(name) else public_tokenizers.path(name), remembered))


def binary_lengths(n: int, length: int) -> list[int]:
    """The pieces of ``n`` ids: full ones, then the binary digits of the rest from the highest."""
    rest = n % length
    return [length] * (n // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if rest >> b & 1]


def packed(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED, piece: int = PIECE) -> DataFrame:
    """Per piece: doc_id, start, length, ids (binary), doc_tokens, bucket (log2 of the length), sequence_id, offset.

    Fewer words ``remembered`` and a smaller ``piece`` take less memory and more time; the rows are the same.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary, remembered)
        for batch in pieces(batches, most=piece):
            docs_, starts, lengths, ids, totals = [], [], [], [], []
            for doc, own in zip(batch.column(0).to_pylist(), t.encode([x or "" for x in batch.column(1).to_pylist()])):
                own += end
                at, n = 0, len(own) // 4
                for size in binary_lengths(n, length):
                    docs_.append(doc)
                    starts.append(at)
                    lengths.append(size)
                    ids.append(own[4 * at : 4 * (at + size)])
                    totals.append(n)
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens"])

    made = id_and_text(docs, id_col, text_col).mapInArrow(lean(run, holds=True), SCHEMA)
    bucket = F.log2("length").cast("int").alias("bucket")
    return made.select("*", bucket, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

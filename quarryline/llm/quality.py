"""Quality rules: repetition coverage.

Rolling hashes of several n-gram lengths, in numpy over whole batches, find the n-grams
that repeat an earlier one of their text; the measure is the share of the text's word
characters that lie inside such n-grams, each character once.  The same share is taken
for lines equal to an earlier line.  A text is kept if it passes the base rules and no
share is above its limit.  Hashes only sort the windows: neighbours with equal hashes are
compared word by word, on numbers that are equal exactly where the words' bytes are.

Defined results: a null or empty text has no words and fails; each row is judged by
itself, so repeated rows get equal results; an empty table gives an empty result; only the two
named columns are read, so others may have any name; a very long text is measured whole, alone
in its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, mix, pieces, text_bytes
from .words import word_hashes, word_numbers, words

#: Largest share of characters inside n-grams that repeat an earlier one, by n.
NGRAM_LIMITS = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
#: Largest share of characters in lines that repeat an earlier one.
LINE_LIMIT = 0.25
#: Largest number of symbols per word.
SYMBOL_LIMIT = 0.10
MIN_WORDS, BASE_N, BASE_PERCENT = 10, 5, 20

#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_share double, ngram_shares array<double>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def repeated_windows(hashes: np.ndarray, numbers: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the n-word windows that repeat an earlier one of their text, and of those that are repeated first.

    Windows are sorted by a rolling hash; neighbours with equal hashes are compared word by word.
    """
    m = len(hashes) - n + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none, none
    g = mix(doc[:m].astype(np.uint64) + np.uint64(1))
    for j in range(n):
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    g = g[at]
    order = np.argsort(g, kind="stable")
    at, g = at[order], g[order]
    same = g[1:] == g[:-1]
    a, b = at[:-1][same], at[1:][same]
    true = doc[a] == doc[b]
    for j in range(n):
        true &= numbers[a + j] == numbers[b + j]
    if not true.all():  # two different windows share a hash: sort by the words themselves
        order = np.lexsort([at, *(numbers[at + j] for j in range(n)), doc[at]])
        at = at[order]
        same = doc[at[1:]] == doc[at[:-1]]
        for j in range(n):
            same &= numbers[at[1:] + j] == numbers[at[:-1] + j]
    later = at[1:][same]
    first = at[:-1][same & ~np.concatenate([[False], same[:-1]])] if len(same) else at[:0]
    return later, first


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a window of ``n`` from one of ``starts``."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and their code points."""
    seen, count, chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line in seen:
            count += 1
            chars += len(line.decode())
        elif line and not line.isspace():
            seen.add(line)
    return count, chars


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        buf, off = text_bytes(batch.column(1))
        docs = batch.num_rows
        starts, ends, doc = words(buf, off)
        hashes = word_hashes(buf, starts, ends)
        numbers = word_numbers(buf, starts, ends, hashes)
        points = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
        chars = points[ends] - points[starts]
        of = lambda weights=None: np.bincount(doc, weights, docs)
        n_words = of().astype(np.int64)
        word_chars = of(chars).astype(np.int64)
        symbols = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(_SYMBOL[buf], out=symbols[1:])
        n_symbols = symbols[off[1:]] - symbols[off[:-1]]
        shares = []
        n_repeat = np.zeros(docs, np.int64)
        for n in NGRAM_LIMITS:
            later, first = repeated_windows(hashes, numbers, doc, n)
            shares.append(of(chars * covered(later, n, len(doc))) / np.maximum(word_chars, 1))
            if n == BASE_N:
                n_repeat = of(covered(np.concatenate([later, first]), n, len(doc))).astype(np.int64)
        raw = buf.tobytes()
        lines = [_repeated_lines(raw[off[i] : off[i + 1]]) for i in range(docs)]
        n_dup = np.array([x[0] for x in lines], np.int64)
        length = points[off[1:]] - points[off[:-1]]
        line_share = np.array([x[1] for x in lines]) / np.maximum(length, 1)
        failed = (n_words < MIN_WORDS) | (100 * n_repeat > BASE_PERCENT * n_words)
        kept = ~failed & (line_share <= LINE_LIMIT) & (n_symbols <= SYMBOL_LIMIT * n_words)
        for share, limit in zip(shares, NGRAM_LIMITS.values()):
            kept &= share <= limit
        table = np.stack(shares, 1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(docs + 1, dtype=np.int32) * len(NGRAM_LIMITS)), pa.array(table.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, word_chars, n_symbols, n_dup, n_repeat, failed, kept, line_share)), lists], [x.split()[0] for x in SCHEMA.split(", ")])


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the counts of the base rules, their verdict, the shares by n-gram length and of lines, and the verdict of all."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_measure, SCHEMA)

"""Words of UTF-8 buffers, their 64-bit hashes, and exact numbers, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import mix

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Places whose powers are held.
SPAN = 1 << 16
#: Words beyond so many bytes are hashed by BLAKE2b: polynomials modulo 2 ** 64 fail on some long ones.
LONG = 48
#: Bytes of words compared at once.
STEP = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to n - 1, modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    have, step = 1, np.uint64(base)
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
        step = step * step
    return out


class Poly:
    """Prefix polynomial hashing modulo 2 ** 64 by an odd base, over at most ``n`` places."""

    def __init__(self, base: int, n: int = 2 * SPAN):
        with np.errstate(over="ignore"):
            self.up = powers(base, n)
            self.down = powers(pow(base, -1, 1 << 64), n)

    def prefixes(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


FIRST = Poly(0x9E3779B97F4A7C15 | 1)
SECOND = Poly(0xC2B2AE3D27D4EB4F | 1)
BYTE = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run without white space, and its document; none crosses documents."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = _SPACE[buf]
    before = np.empty(len(buf), bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = True, space[1:]
    own = off[1:] > off[:-1]
    before[off[:-1][own]] = True
    after[off[1:][own] - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes and length; it may be equal for different words, so it only routes and sorts."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        a = int(starts[at])
        stop = int(np.searchsorted(ends, a + SPAN, "right"))
        if stop > at:
            prefix = FIRST.prefixes(BYTE[buf[a : int(ends[stop - 1])]])
            out[at:stop] = FIRST.span(prefix, starts[at:stop] - a, ends[at:stop] - a)
        at = max(stop, at + 1)
    size = ends - starts
    out = mix(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def gathered(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ..., ``size`` of them from each start."""
    return np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)


def word_numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Numbers from 0 that are equal exactly where words are: hashes sort the words, their bytes decide."""
    if not len(starts):
        return np.zeros(0, np.int64)
    hashes = word_hashes(buf, starts, ends) if hashes is None else hashes
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    model, size = first[number], ends - starts
    equal = bool((size == size[model]).all())
    if equal:
        tried = np.flatnonzero(model != np.arange(len(model)))
        cut = np.flatnonzero(np.diff(np.cumsum(size[tried]) // STEP, prepend=-1)) if len(tried) else []
        for part in np.split(tried, cut[1:]):
            if not np.array_equal(buf[gathered(starts[part], size[part])], buf[gathered(starts[model[part]], size[part])]):
                equal = False
                break
    if equal:
        return number
    raw, known = buf.tobytes(), {}  # two different words share a hash
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)


def gram_numbers(items: np.ndarray, starts: np.ndarray, n: int, group: np.ndarray | None = None) -> np.ndarray:
    """Numbers equal exactly where the ``n`` items from each start (and the groups) are; items are numbers from 0."""
    number = np.zeros(len(starts), np.int64) if group is None else group
    most = np.int64(items.max() + 1) if len(items) else np.int64(1)
    for j in range(n):
        number = np.unique(number * most + items[starts + j], return_inverse=True)[1]
    return number

"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read each run of ``LENGTH`` bytes, one forwards and one backwards; at every byte
both states give class probabilities, and a document's probabilities are the mean over all
its bytes.  The network is trained in numpy by backpropagation through time on runs drawn
from the whole texts of a bounded sample of labelled rows, ``PER_LANGUAGE`` of each language
however rare, and every byte of every text is labelled.

Defined results: null, empty and letterless texts are ``und`` with score 0; with no labelled
row to learn from, every text is ``und``; rows are independent, so repeated rows get equal
results; ties go to the language first in order; an empty table gives an empty result; other
columns may have any name; a very long text is read whole, alone in its batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import id_and_text, lean, pieces, text_bytes

#: Bytes read from one zero state; units of each direction.
LENGTH, UNITS = 96, 8
#: Labelled rows of each language in the sample, and the most languages that a network tells apart.
PER_LANGUAGE, MOST_LANGUAGES = 200, 1000
#: Training steps, and runs in each.
STEPS, BATCH = 160, 192
#: Runs labelled side by side.
SIDE = 2048
UNDETERMINED = "und"
_PAD = 256


class Direction:
    """One GRU: state = z * state + (1 - z) * candidate; a pad byte keeps the state."""

    def __init__(self, rng: np.random.Generator, units: int):
        self.units = units
        self.table = (rng.standard_normal((257, 3 * units)) * 0.3).astype(np.float32)
        self.table[:, :units] += 1.0  # update gate: remember at first
        self.table[_PAD] = 0
        self.table[_PAD, :units] = 60.0
        self.gates = (rng.standard_normal((units, 2 * units)) / math.sqrt(units)).astype(np.float32)
        self.inner = (rng.standard_normal((units, units)) / math.sqrt(units)).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.gates, self.inner]

    def run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each byte of ``x`` (time, side); ``keep`` also returns what training needs."""
        u, side = self.units, x.shape[1]
        h = np.zeros((side, u), np.float32)
        out, cache = np.empty((len(x), side, u), np.float32), []
        for t in range(len(x)):
            a = self.table[x[t]]
            g = h @ self.gates
            g += a[:, : 2 * u]
            g *= 0.5
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            z, r = g[:, :u], g[:, u:]
            c = (r * h) @ self.inner
            c += a[:, 2 * u :]
            np.tanh(c, out=c)
            new = out[t]
            np.subtract(h, c, out=new)
            new *= z
            new += c
            if keep:
                cache.append((h, z, r, c))
            h = new
        return out, cache

    def back(self, x: np.ndarray, grads: np.ndarray, cache: list) -> list[np.ndarray]:
        """Gradients by backpropagation through time."""
        u = self.units
        d_table, d_gates, d_inner = (np.zeros_like(p) for p in self.parameters())
        dh = np.zeros_like(grads[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c = cache[t]
            dh = dh + grads[t]
            dc = dh * (1 - z) * (1 - c * c)
            drh = dc @ self.inner.T
            dz = dh * (h - c) * z * (1 - z)
            dr = drh * h * r * (1 - r)
            d_inner += (r * h).T @ dc
            dg = np.concatenate([dz, dr], 1)
            d_gates += h.T @ dg
            np.add.at(d_table, x[t], np.concatenate([dg, dc], 1))
            dh = dh * z + drh * r + dg @ self.gates.T
        d_table[_PAD] = 0
        return [d_table, d_gates, d_inner]


def backwards(x: np.ndarray) -> np.ndarray:
    """Each run in reverse with its pads last, so that reading starts at the run's last byte."""
    out = np.full_like(x, _PAD)
    size = (x != _PAD).sum(0)
    t = np.arange(len(x))[:, None]
    at = size[None, :] - 1 - t
    inside = at >= 0
    out[inside] = np.take_along_axis(x, np.maximum(at, 0), 0)[inside]
    return out


class Network:
    def __init__(self, classes: list[str], units: int = UNITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.ahead, self.behind = Direction(rng, units), Direction(rng, units)
        self.out = (rng.standard_normal((2 * units, len(classes))) * 0.3).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.parameters(), *self.behind.parameters(), self.out, self.bias]

    def _join(self, x: np.ndarray, keep: bool = False) -> tuple:
        """Both states at every byte; the backward ones are brought to their bytes."""
        rev = backwards(x)
        one, cache_one = self.ahead.run(x, keep)
        two, cache_two = self.behind.run(rev, keep)
        size = (x != _PAD).sum(0)
        at = np.maximum(size[None, :] - 1 - np.arange(len(x))[:, None], 0)
        if (size == len(x)).all():
            two = two[::-1]
        else:
            two = np.take_along_axis(two, at[:, :, None], 0)
        return one, two, rev, at, cache_one, cache_two

    def label(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities at every byte of ``x`` (time, side)."""
        one, two, *_ = self._join(x)
        u = self.ahead.units
        p = one @ self.out[:u]
        p += two @ self.out[u:]
        p += self.bias
        p -= p.max(-1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(-1, keepdims=True)
        return p

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all bytes, and gradients."""
        one, two, rev, at, cache_one, cache_two = self._join(x, True)
        states = np.concatenate([one, two], 2)
        p = states @ self.out + self.bias
        p = np.exp(p - p.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        real = (x != _PAD)[:, :, None]
        loss = -np.log(np.maximum(p[:, np.arange(x.shape[1]), y], 1e-9))[real[:, :, 0]].mean()
        p[:, np.arange(x.shape[1]), y] -= 1
        p *= real / np.float32(max(1, real.sum()))
        d_out = np.tensordot(states, p, ([0, 1], [0, 1]))
        d_states = p @ self.out.T
        u = self.ahead.units
        d_two = np.zeros_like(two)
        t, side = np.nonzero(real[:, :, 0])  # to the steps at which the backward reader met each byte
        d_two[at[t, side], side] = d_states[t, side, u:]
        grads = self.ahead.back(x, d_states[:, :, :u], cache_one) + self.behind.back(rev, d_two, cache_two)
        return float(loss), [*grads, d_out, p.sum((0, 1))]

    def train(self, excerpts: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, length: int = LENGTH, seed: int = 5) -> None:
        """Adam over runs drawn from the excerpts, languages drawn equally often."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.classes))]
        mean = [np.zeros_like(p) for p in self.parameters()]
        square = [np.zeros_like(p) for p in self.parameters()]
        for i in range(1, steps + 1):
            kind = rng.integers(0, len(by), batch)
            x = np.full((length, batch), _PAD, np.int64)
            for j, k in enumerate(kind):
                text = excerpts[by[k][rng.integers(0, len(by[k]))]]
                size = min(len(text), int(length if rng.random() < 0.8 else rng.integers(4, length + 1)))
                at = int(rng.integers(0, len(text) - size + 1))
                x[:size, j] = np.frombuffer(text[at : at + size], np.uint8)
            _, grads = self.step(x, kind)
            rate = 0.03 * 0.5 * (1 + math.cos(math.pi * i / (steps + 1)))
            norm = math.sqrt(sum(float((g * g).sum()) for g in grads))
            for p, g, m, v in zip(self.parameters(), grads, mean, square):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)).astype(p.dtype)

    def documents(self, buf: np.ndarray, off: np.ndarray, length: int = LENGTH) -> np.ndarray:
        """Mean class probabilities of each document over all its bytes."""
        size = off[1:] - off[:-1]
        runs = -(-size // length)
        doc = np.repeat(np.arange(len(size)), runs)
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
        start = off[:-1][doc] + inner * length
        real = np.minimum(length, off[1:][doc] - start)
        total = np.zeros((len(size), len(self.classes)))
        order = np.argsort(-real, kind="stable")
        for i in range(0, len(order), SIDE):
            part = order[i : i + SIDE]
            longest = int(real[part[0]])
            t = np.arange(longest)[:, None]
            inside = t < real[part][None, :]
            x = np.where(inside, buf[np.minimum(start[part][None, :] + t, len(buf) - 1)], _PAD).astype(np.int64)
            p = self.label(x)
            if not inside.all():
                p *= inside[:, :, None]
            np.add.at(total, doc[part], p.sum(0, dtype=np.float64))
        return total / np.maximum(size, 1)[:, None]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network fitted on a bounded sample of the rows that may be learned from; None if there are none.

    The sample is, of each language, the ``PER_LANGUAGE`` rows with the least hash of id and
    text: tasks keep that many of their own rows before any row moves.
    """
    may = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(~F.coalesce(held_out("i"), F.lit(True)) & F.col("lang").isNotNull() & (F.length("text") > 0))
    hashed = may.withColumn("h", F.xxhash64("i", "text"))
    # the hash up to which about PER_LANGUAGE rows of a language lie, from their number; twice that leaves enough
    counts = may.groupBy("lang").agg(F.count("*").alias("n"))
    near = hashed.join(F.broadcast(counts.limit(MOST_LANGUAGES + 1)), "lang").filter((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) * F.col("n") <= 2.0 * PER_LANGUAGE + 50)
    first = W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "i")
    rows = near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= PER_LANGUAGE).select("lang", "text").collect()  # PER_LANGUAGE a language
    classes = sorted({r["lang"] for r in rows})
    if not classes:
        return None
    if len(classes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    texts = sorted((r["lang"], r["text"].encode()) for r in rows)
    network = Network(classes)
    network.train([text for _, text in texts], np.array([classes.index(lang) for lang, _ in texts]))
    return network


def _judged(network: Network | None, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text of a column."""
    texts = column.to_pylist()
    lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts])
    names, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
    if network is not None and lettered.any():
        p = network.documents(*text_bytes(column))
        best = p.argmax(1)
        names[lettered] = np.array(network.classes, object)[best[lettered]]
        scores[lettered] = np.clip(p[np.arange(len(p)), best], 0, 1)[lettered]
    return names, scores


def identified(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (the language's mean probability)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 20):
            names, scores = _judged(network, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, network: Network | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is determined with at least the score ``least``, with all their columns; in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, 1 << 20):
            names, scores = _judged(network, batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array((names != UNDETERMINED) & (scores >= least)))

    return docs.mapInArrow(lean(run), docs.schema)

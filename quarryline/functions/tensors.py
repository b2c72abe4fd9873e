"""Statistics of numeric arrays, as column expressions where they have one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x.cast("double")))


def lower_quantile(sorted_array: Column, q: float) -> Column:
    """The element at floor(q * (n - 1)) of a sorted array."""
    return F.element_at(sorted_array, (F.floor((F.size(sorted_array) - 1) * q) + 1).cast("int"))


def vector_stats(a: Column) -> dict[str, Column]:
    n = F.size(a)
    mean = _sum(a, lambda x: x) / n
    absolute = F.array_sort(F.transform(a, lambda x: F.abs(x.cast("double"))))
    squares = _sum(a, lambda x: x * x)
    return {
        "mean": mean, "stddev": F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0))), "l2": F.sqrt(squares),
        "mean_abs": _sum(a, F.abs) / n, "max_abs": F.element_at(absolute, -1), "zero_fraction": F.size(F.filter(a, lambda x: F.abs(x) < 1e-8)) / n,
        "p50": lower_quantile(absolute, 0.5), "p95": lower_quantile(absolute, 0.95),
    }


def effective_rank(a: Column) -> Column:
    """Rounded (sum of squares)^2 / sum of fourth powers."""
    two, four = _sum(a, lambda x: x * x), _sum(a, lambda x: x * x * x * x)
    return F.when(four > 0, F.floor(two * two / four + 0.5)).otherwise(0).cast("long")


def moving_average(a: Column, radius: int = 16) -> Column:
    """Centred mean over up to ``radius`` places each side, cut at the ends."""
    at = lambda i: F.slice(a, F.greatest(i - radius, F.lit(0)) + 1, F.least(i + radius, F.size(a) - 1) - F.greatest(i - radius, F.lit(0)) + 1)
    return F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: _sum(at(i), lambda x: x) / F.size(at(i)))


def _inspect(x: np.ndarray, radius: int) -> dict[str, np.ndarray]:
    """Measures of vectors of one width, a row each."""
    n = x.shape[1]
    total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, 1)], 1)
    i = np.arange(n)
    lo, hi = np.maximum(i - radius, 0), np.minimum(i + radius + 1, n)
    low = (total[:, hi] - total[:, lo]) / (hi - lo)
    rest = x - low
    square = lambda a: (a * a).sum(1)
    e_low, e_rest, two, four = square(low), square(rest), square(x), (x**4).sum(1)
    both = np.maximum(e_low + e_rest, 1e-12)
    size = np.sort(np.abs(x), 1)
    p50, p95 = size[:, int(0.5 * (n - 1))], size[:, int(0.95 * (n - 1))]
    norm, again = np.sqrt(two), np.sqrt(square(low + rest))
    share = e_low / both
    return {
        "eta_low": np.round(share, 6), "eta_rest": np.round(e_rest / both, 6), "spectral_gap": np.round((p95 + 1e-12) / (p50 + 1e-12), 4),
        "effective_rank": np.maximum(1, np.floor(two * two / np.maximum(four, 1e-12) + 0.5)).astype(np.int64),
        "ghost_rank": np.minimum(8, np.floor((np.abs(x) < 1e-8).mean(1) * 32 + 0.5)).astype(np.int64), "norm": np.round(norm, 6),
        "kind": np.select([share < 0.06, share > 0.20], ["residual-heavy", "lowrank-heavy"], "balanced"),
        "energy_closure": np.where(np.abs(norm - again) / np.maximum(1e-9, norm) < 1e-6, "pass", "fail"),
        "subspace_compatibility": np.where(np.abs((low * rest).sum(1)) / np.maximum(1e-9, np.sqrt(e_low) * np.sqrt(e_rest)) < 0.05, "pass", "fail"),
    }


def inspected(df: DataFrame, key: str, vector: str, radius: int = 16) -> DataFrame:
    """Shares of the low-pass and residual energies, quantile gap, ranks, class and checks of each vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            width = pdf["v"].map(len)
            for n in sorted(set(width[width > 0])):
                own = pdf[width == n]
                yield pd.DataFrame({"key": own["key"].to_numpy(), **_inspect(np.stack(own["v"]).astype(float), radius)})

    schema = "key long, eta_low double, eta_rest double, spectral_gap double, effective_rank long, ghost_rank long, norm double, kind string, energy_closure string, subspace_compatibility string"
    return df.select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInPandas(run, schema)


def commutators(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Norms of AB - BA over the sums of both products' norms, of stacked matrices; under .05 the order is safe to change."""
    ab, ba = a @ b, b @ a
    norm = lambda m: np.sqrt((m * m).sum((1, 2)))
    size = norm(ab) + norm(ba)
    return np.where(size > 0, norm(ab - ba) / np.where(size > 0, size, 1), 0.0)


def commuted(pairs: DataFrame, key: str, a: str, b: str, side: int = 16) -> DataFrame:
    """The commutator of two vectors read as square matrices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                matrix = lambda c: np.stack([np.asarray(x, float)[: side * side] for x in pdf[c]]).reshape(-1, side, side)
                made = commutators(matrix("a"), matrix("b"))
                yield pd.DataFrame({"key": pdf["key"], "commutator": made, "safe": made < 0.05})

    return pairs.select(F.col(key).alias("key"), F.col(a).alias("a"), F.col(b).alias("b")).mapInPandas(run, "key long, commutator double, safe boolean")


def gauge_fixed(x: np.ndarray, preserve: np.ndarray) -> np.ndarray:
    """``x`` without its part along ``preserve``, brought back to its own length, plus that part."""
    unit = preserve / (np.linalg.norm(preserve) or 1.0)
    along = (x @ unit) * unit
    rest = x - along
    have, want = np.linalg.norm(rest), np.sqrt(max(float(x @ x - along @ along), 0.0))
    return along + (rest * (want / have) if have else rest)


def cheapest(candidates: list[tuple[str, Column]]) -> Column:
    """Name of the candidate of least cost, the first on ties."""
    return F.array_min(F.array(*[F.struct(c.alias("cost"), F.lit(i).alias("rank"), F.lit(n).alias("name")) for i, (n, c) in enumerate(candidates)]))["name"]


def entropy_bits(value: DataFrame, key: str, text: str) -> DataFrame:
    """Shannon entropy of each text's bytes: bytes are counted before they are grouped."""
    hexed = F.hex(F.encode(F.col(text), "utf-8"))
    byte = F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(hexed) - 1, F.lit(1)), F.lit(2)), lambda i: F.substring(hexed, i, F.lit(2))), lambda b: b != ""))
    counts = value.select(key, byte.alias("b")).groupBy(key, "b").agg(F.count("*").alias("n"))
    total = counts.groupBy(key).agg(F.sum("n").alias("bytes"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    return total.select(key, "bytes", F.round(F.log2("bytes") - F.col("nlogn") / F.col("bytes"), 4).alias("entropy"))

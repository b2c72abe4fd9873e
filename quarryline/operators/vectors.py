"""Structural text vectors, the E8 lattice, and blended search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WIDTH = 64
#: Rows and queries compared in one group, and queries at once.
ROWS, QUERIES, BESIDE = 8192, 4096, 64


def embedded(text: Column) -> Column:
    """64 numbers from salted hashes of the text, scaled to unit length and rounded: equal texts, and only they, are close."""
    part = lambda b, i: F.sha2(F.concat(b, F.unhex(F.lpad(F.hex(i), 2, "0"))), 256)
    number = lambda b, i: F.conv(F.substring(part(b, i), 1, 4), 16, 10).cast("double")
    numbers = lambda b: F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.round(number(b, i) / 65535 * 2 - 1, 6))
    length = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + x * x))
    # one-element arrays bind a value once, where a plain reference would be computed anew for each number
    raw = F.transform(F.array(F.unhex(F.sha2(text, 256))), numbers)
    both = F.transform(raw, lambda r: F.struct(r.alias("r"), length(r).alias("n")))
    return F.element_at(F.transform(both, lambda s: F.transform(s["r"], lambda x: F.round(x / s["n"], 6))), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where widths differ or a vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def search(store: DataFrame, query: list[float], k: int, vector: str, order: str) -> DataFrame:
    """The ``k`` best by cosine, ties by order; the query is part of the plan, so nothing is joined."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return store.withColumn("score", F.round(cosine(F.col(vector), q), 6)).orderBy(F.desc("score"), order).limit(k)


def snap(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest points of E8 (integers of even sum, or those shifted by a half) and squared distances."""

    def even(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.floor(x + 0.5)
        odd = np.flatnonzero(z.sum(1).astype(np.int64) % 2)
        if len(odd):
            gap = x[odd] - z[odd]
            at = np.abs(gap).argmax(1)
            z[odd, at] += np.where(gap[np.arange(len(odd)), at] >= 0, 1.0, -1.0)
        return z, ((x - z) ** 2).sum(1)

    whole, d_whole = even(points)
    half, d_half = even(points - 0.5)
    pick = d_half < d_whole
    return np.where(pick[:, None], half + 0.5, whole), np.where(pick, d_half, d_whole)


def cell_key(cell: np.ndarray) -> str:
    return ",".join(f"{int(2 * x)}h" if float(x) % 1 else str(int(x)) for x in cell)


def neighbor_score(squared: float) -> float:
    """Fixed values by squared distance of two cells."""
    return 1.0 if squared == 0 else 0.8 if squared == 2 else 0.5 if squared == 4 else 0.2 if squared <= 8 else 0.0


def snapped(df: DataFrame, key: str, point: str) -> DataFrame:
    """Per row: key, cell, cell_key, residual (distance to the cell)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, squared = snap(np.stack([np.asarray(p, float)[:8] for p in pdf["p"]]))
                yield pd.DataFrame({"key": pdf["key"], "cell": list(cell), "cell_key": [cell_key(c) for c in cell], "residual": np.round(np.sqrt(squared), 8)})

    return df.select(F.col(key).alias("key"), F.col(point).alias("p")).mapInPandas(run, "key long, cell array<double>, cell_key string, residual double")


def blended(store: DataFrame, query: list[float], query_cell: list[float], k: int) -> DataFrame:
    """.80 cosine + .15 neighbourhood + .05 closeness where a row has a cell; else cosine.  Rows: key, vector, cell, residual."""
    q, c = F.array(*map(F.lit, query)), F.array(*map(F.lit, query_cell))
    squared = F.aggregate(F.zip_with("cell", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    near = F.when(squared == 0, 1.0).when(squared == 2, 0.8).when(squared == 4, 0.5).when(squared <= 8, 0.2).otherwise(0.0)
    cos = cosine(F.col("vector"), q)
    mixed = 0.8 * cos + 0.15 * near + 0.05 * (1 - F.least(F.lit(1.0), F.col("residual") / 2))
    return store.withColumn("score", F.round(F.when(F.col("cell").isNotNull(), mixed).otherwise(cos), 6)).orderBy(F.desc("score"), "key").limit(k)


def _best(k: int):
    """Of one block of rows, the ``k`` best of each query of one block, as ``blended`` scores them."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = rows.sort_values("key", ignore_index=True)
        keys = rows["key"].to_numpy()
        has = rows["cell"].notna().to_numpy()
        cells = np.stack([np.asarray(c, float) if h else np.zeros(8) for c, h in zip(rows["cell"], has)]) if len(rows) else np.zeros((0, 8))
        close = 0.05 * (1 - np.minimum(1.0, rows["residual"].to_numpy(float) / 2))
        width, wide = rows["vector"].map(len).to_numpy(int), queries["vector"].map(len).to_numpy(int)
        for w in np.unique(wide).tolist() if len(rows) else []:
            same = np.flatnonzero(width == w)
            unit = lambda v: (x := np.stack([np.asarray(y, float) for y in v])) / np.where((n := np.sqrt((x * x).sum(1))) > 0, n, np.inf)[:, None]
            store = unit(rows["vector"].iloc[same]) if len(same) else np.zeros((0, w))
            mine = queries[wide == w]
            for a in range(0, len(mine), BESIDE):
                some = mine.iloc[a : a + BESIDE]
                cos = np.zeros((len(some), len(rows)))
                cos[:, same] = unit(some["vector"]) @ store.T
                cell = np.stack([np.asarray(c, float) for c in some["cell"]])
                squared = (cell * cell).sum(1)[:, None] + (cells * cells).sum(1) - 2 * cell @ cells.T  # multiples of a quarter, so exact
                near = np.select([squared == 0, squared == 2, squared == 4, squared <= 8], [1.0, 0.8, 0.5, 0.2], 0.0)
                score = np.round(np.where(has, 0.8 * cos + 0.15 * near + close, cos), 6)
                at = np.argsort(-score, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"query": np.repeat(some["key"].to_numpy(), at.shape[1]), "key": keys[at].ravel(), "score": np.take_along_axis(score, at, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "key": [], "score": []})

    return run


def blended_each(store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``blended`` for every row of ``queries``: (query, key, score), the ``k`` best rows of each.

    Every block of queries meets every block of rows in a group of its own; only the best leave it.
    """
    n_rows, n_queries = (max(1, -(-df.count() // most)) for df, most in ((store, ROWS), (queries, QUERIES)))
    block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = store.select("key", "vector", "cell", "residual", block(n_rows).alias("rb"), every(n_queries).alias("qb"))
    right = queries.select(*[F.col(c).alias(c) for c in ("key", "vector", "cell")], block(n_queries).alias("qb"), every(n_rows).alias("rb"))
    best = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(_best(k), "query long, key long, score double")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))
    return best.withColumn("place", place).filter(F.col("place") <= k).drop("place")

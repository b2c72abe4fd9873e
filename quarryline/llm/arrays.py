"""Array columns without quadratic folds: bindings, running sums, chunks of the square root's size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(values: Column) -> Column:
    """An array as an array of about sqrt(n) slices of about sqrt(n) elements."""
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values)))).cast("int")
    return let(F.struct(values.alias("v"), size.alias("s")), lambda x: F.transform(F.when(F.size(x["v"]) > 0, F.sequence(F.lit(0), ((F.size(x["v"]) - 1) / x["s"]).cast("int"))).otherwise(F.expr("cast(array() as array<int>)")), lambda c: F.slice(x["v"], c * x["s"] + 1, x["s"])))


def running(values: Column, zero: int = 0, merge: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The sums (or other merges) of the integers of an array up to each place, in about n * sqrt(n) steps."""
    total = lambda a: F.aggregate(a, F.lit(zero), merge)
    each = lambda p: F.transform(p["own"], lambda ch, c: let(total(F.slice(p["sums"], F.lit(1), c)), lambda before: F.transform(ch, lambda v, i: merge(before, total(F.slice(ch, F.lit(1), i + 1))))))
    return F.flatten(let(chunks(values), lambda own: each(F.struct(own.alias("own"), F.transform(own, total).alias("sums")))))


def by_reach(spans: Column) -> Column:
    """Spans (start, end, ...) in order of start, in chunks with the least start and the greatest end of each."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    return F.transform(chunks(ordered), lambda part: F.struct(part.alias("part"), F.array_min(F.transform(part, lambda s: s["start"])).alias("low"), F.array_max(F.transform(part, lambda s: s["end"])).alias("high")))


def any_overlap(reach: Column, a: Column, also: Callable[[Column], Column] = lambda b: F.lit(True)) -> Column:
    """Whether a span in chunks from ``by_reach`` overlaps ``a`` and fulfils ``also``."""
    over = lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]) & also(b)
    return F.exists(reach, lambda r: (r["low"] < a["end"]) & (r["high"] > a["start"]) & F.exists(r["part"], over))

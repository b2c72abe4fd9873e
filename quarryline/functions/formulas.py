"""Planning formulas as column expressions over tables of models, regions and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def normalized(weight: Column, group: str) -> Column:
    return weight / F.sum(weight).over(W.partitionBy(group))


def layer_bucket(layer: Column, layers: int, parts: int) -> Column:
    """Contiguous ranges of ceil(layers / parts)."""
    return F.floor(layer / (-(-layers // parts))).cast("int")


def transfer(size_gb: Column, hit_rate: Column, rate: Column, chunk_mb: float) -> dict[str, Column]:
    """Cached and transferred size, cost, and chunks that a region needs."""
    cached = F.round(size_gb * hit_rate, 3)
    moved = F.round(size_gb - cached, 3)
    return {"cached_gb": cached, "transfer_gb": moved, "cost": F.round(moved * rate, 4), "chunks": F.ceil(moved * 1024 / chunk_mb)}


def stream_chunks(total_ms: Column, chunk_ms: int) -> Column:
    return F.ceil(total_ms / chunk_ms)


def cache_bytes(tokens: Column, layers: int, heads: int, width: int, bytes_each: int = 2) -> Column:
    """Keys and values of every layer and head."""
    return tokens.cast("long") * (2 * layers * heads * width * bytes_each)


def quant_bits(kind: Column) -> Column:
    """Bits by tensor kind: sensitive ones keep more."""
    return F.when(kind.isin("embedding", "head"), 8).when(kind == "norm", 16).otherwise(4)


def expiry(start: Column, hours: int) -> Column:
    return start + F.make_interval(hours=F.lit(hours))


def expired(start: Column, hours: int, now: Column) -> Column:
    return now > expiry(start, hours)


def zcdp(sensitivity: float, sigma: Column) -> Column:
    return F.lit(sensitivity * sensitivity) / (sigma * sigma * 2)


def laplace_scale(sensitivity: float, epsilon: Column) -> Column:
    return F.lit(sensitivity) / epsilon


def perplexity_change(gap: Column) -> Column:
    return F.when(gap > 0, gap * 0.12).otherwise(0.0)


def to_fixed(x: Column, places: int) -> Column:
    """The double nearest to ``x`` rounded to decimal places, by the exact value of ``x`` and ties away from zero.

    The product with the power of ten is split into a double and its exact error, so values that
    only look like ties (1.005) go the right way.
    """
    power = 10.0**places
    split = 134217729.0
    high = lambda v: v * split - (v * split - v)
    a, c_high = F.abs(x.cast("double")), float(power * split - (power * split - power))
    c_low = power - c_high
    product = a * power
    a_high = high(a)
    a_low = a - a_high
    error = ((a_high * c_high - product) + a_high * c_low + a_low * c_high) + a_low * c_low
    whole = F.floor(product)
    up = ((product - whole) - 0.5) + error >= 0
    n = whole + F.when(up, 1).otherwise(0)
    return F.when(a >= 2.0**52 / power, x.cast("double")).otherwise(F.signum(x.cast("double")) * n / power)

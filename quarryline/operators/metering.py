"""Metering, usage and ledger reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MONEY = "decimal(18,2)"


def money_sum(c: str | Column) -> Column:
    """An exact sum of amounts in hundredths, whatever the order of rows."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast(MONEY)).cast("double")


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def summary(df: DataFrame, keys: list[str], quantity: str) -> DataFrame:
    return df.groupBy(*keys).agg(money_sum(quantity).alias("total"), F.count("*").alias("n"))


def usage_report(df: DataFrame, model: str, event: str, quantity: str, ts: str, since: str | None = None) -> DataFrame:
    """Totals by event and by (model, event) in one pass over the rows."""
    if since:
        df = df.filter(F.col(ts).isNull() | (F.col(ts) >= F.lit(since).cast("timestamp")))
    rows = df.select(F.col(model).alias("model"), F.col(event).alias("event"), quantity, ts)
    sets = [[F.col("event")], [F.col("model"), F.col("event")]]
    out = rows.groupingSets(sets, "model", "event").agg(F.grouping("model").cast("int").alias("by_event_only"), money_sum(quantity).alias("total"), F.count("*").alias("n"), stamp(F.min(ts)).alias("first_at"), stamp(F.max(ts)).alias("last_at"))
    return out.select("model", "event", "by_event_only", "total", "n", "first_at", "last_at")


def invoice_total(items: DataFrame, keys: list[str], quantity: Column, price: Column) -> DataFrame:
    """Sum of quantity by price; a missing quantity is 1, a missing price 0."""
    q, p = F.coalesce(quantity, F.lit(1.0)).cast(MONEY), F.coalesce(price, F.lit(0.0)).cast(MONEY)
    return items.groupBy(*keys).agg(F.sum((q * p).cast("decimal(24,4)")).cast("double").alias("total"), F.count("*").alias("lines"))


def margin(revenue: Column, cost: Column) -> Column:
    """Gross margin in percent; null without revenue."""
    return F.when(revenue != 0, (revenue - cost) * 100 / revenue)


def counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def prefix_report(df: DataFrame, command: str, prefixes: list[str]) -> DataFrame:
    """Per command that starts with one of the prefixes: rows and distinct models."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(F.col(command), F.lit(p))
    return df.filter(hit)


def family_lists(df: DataFrame, family: str, state: str, item: str, states: list[str]) -> DataFrame:
    """Per family, the sorted items in each state; items are bounded by the catalog."""
    return df.groupBy(family).agg(*[F.array_join(F.array_sort(F.collect_set(F.when(F.col(state) == s, F.col(item)))), ",").alias(s) for s in states])


def tune(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """Rows and mean score by label; a label without scores has mean 0."""
    s = score.cast(MONEY)
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.coalesce(F.sum(s).cast("double") / F.count(s), F.lit(0.0)).alias("mean_score"))


def burn(df: DataFrame, ts: str, amount: str, hours: int, ceiling: float) -> DataFrame:
    """Spend by tumbling window, burn rate, hours to the ceiling, and whether above four fifths of it."""
    spend = money_sum(amount)
    out = df.groupBy(F.window(ts, f"{hours} hours").alias("w")).agg(spend.alias("spend"))
    rate = F.col("spend") / hours
    return out.select(stamp("w.start").alias("window_start"), "spend", rate.alias("burn_per_hour"), F.when(F.col("spend") > 0, ceiling / rate).alias("eta_hours"), (F.col("spend") > 0.8 * ceiling).alias("fired"))


def last_rows(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key, numbered from 1 in order."""
    w = W.partitionBy(key).orderBy(F.col(order).desc())
    last = df.withColumn("__back", F.row_number().over(w)).filter(F.col("__back") <= n)
    return last.withColumn("seq", F.row_number().over(W.partitionBy(key).orderBy(order))).drop("__back")

"""Accounting of model calls from an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def charged() -> Column:
    """Input without the cached part, output, and reasoning beyond the output."""
    i, c, o, r = (F.coalesce(F.col(f"{n}_tokens"), F.lit(0)) for n in ("input", "cached", "output", "reasoning"))
    return i - F.least(c, i) + o + F.greatest(F.lit(0), r - o)


def _sums() -> list[Column]:
    tokens = [F.coalesce(F.sum(f"{n}_tokens"), F.lit(0)).cast("long").alias(f"{n}_tokens") for n in ("input", "output", "cached", "reasoning", "total")]
    return [F.count("*").alias("calls"), F.count_if("ok").alias("ok_calls"), F.count_if(~F.col("ok")).alias("failed_calls"), *tokens, F.coalesce(F.sum(charged()), F.lit(0)).cast("long").alias("charged")]


def by_day(log: DataFrame, days: int = 14) -> DataFrame:
    """The last ``days`` days that have calls, with sums and the cache's hit rate."""
    out = log.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(*_sums())
    return with_cache_share(out).orderBy(F.desc("day")).limit(days)


def totals(log: DataFrame) -> DataFrame:
    """One row: the sums of all days with the cache's hit rate, in percent of the input; 0 without input."""
    return with_cache_share(log.agg(*_sums()))


def with_cache_share(sums: DataFrame) -> DataFrame:
    rate = F.when(F.col("input_tokens") > 0, F.bround(F.col("cached_tokens") / F.col("input_tokens") * 100, 1)).otherwise(0.0)
    return sums.withColumn("cache_pct", rate)


def newest(log: DataFrame, top: int = 20) -> DataFrame:
    """Newest first; within a second the later written first."""
    return log.orderBy(F.col("at").desc(), F.col("seq").desc()).limit(top)

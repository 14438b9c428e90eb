"""Predicates that every reading path shares, and day windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORTABLE_STATUS = ("processed", "failed", "pending")


def ts(text: str) -> Column:
    """A zone-less timestamp literal; null for a date that does not exist."""
    return F.expr(f"try_cast('{text}' AS timestamp_ntz)")


def visible() -> Column:
    """Neither merged into another story nor in the trash."""
    return F.col("duplicate_of").isNull() & F.col("deleted_at").isNull()


def reportable() -> Column:
    """Visible, judged relevant, and in a status that readers may see. A null relevance is not relevant."""
    return (F.col("relevance") == 1) & F.col("status").isin(*REPORTABLE_STATUS) & visible()


def in_day(date: str, until: str | None = None) -> Column:
    """``[date, date + 1 day)``, cut at ``until``; empty for a date that does not exist. A range, so that it reaches the scan."""
    start = ts(date)
    end = start + F.expr("INTERVAL 1 DAY")
    if until:
        end = F.least(end, ts(until))
    return (F.col("published_at") >= start) & (F.col("published_at") < end)


def since(now: str, days: int) -> Column:
    """From ``days`` before now on, without an upper bound (analytics)."""
    return F.col("published_at") >= ts(now) - F.expr(f"INTERVAL {int(days)} DAY")


def between(now: str, days: int) -> Column:
    """From ``days`` before now to now, both ends included (briefs)."""
    return since(now, days) & (F.col("published_at") <= ts(now))


def latest_first() -> list[Column]:
    return [F.col("published_at").desc(), F.col("id").desc()]


def with_source(articles: DataFrame, sources: DataFrame, unknown: str = "unknown") -> DataFrame:
    """The source's name by a left join. No hint: sources may be many, and the planner broadcasts them if they are few."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    return articles.join(names, "source_id", "left").withColumn("source", F.coalesce("source", F.lit(unknown)))

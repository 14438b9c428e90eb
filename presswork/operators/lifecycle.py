"""What becomes of stored rows: trash, retention, repair, retries, report backfill. Every step is a new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.operators.analytics import calendar
from presswork.operators.visibility import latest_first, reportable, ts


def soft_delete(articles: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Rows of ``ids`` get deleted_at = now; rows in the trash keep their time."""
    hit = articles.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    return hit.withColumn("deleted_at", F.when(F.col("hit") & F.col("deleted_at").isNull(), ts(now)).otherwise(F.col("deleted_at"))).drop("hit")


def restore(articles: DataFrame, ids: DataFrame) -> DataFrame:
    hit = articles.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    return hit.withColumn("deleted_at", F.when(F.coalesce("hit", F.lit(False)), F.lit(None)).otherwise(F.col("deleted_at"))).drop("hit")


def purge(articles: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Without the trash, or without those of its rows that ``ids`` names."""
    if ids is None:
        return articles.filter("deleted_at is null")
    gone = articles.filter("deleted_at is not null").join(ids, "id", "left_semi").select("id")
    return articles.join(gone, "id", "left_anti")


def delete_reason(reason: str = "degraded_reason", prefix: str = "blocked:"):
    return F.when(F.col(reason).startswith(prefix), F.col(reason)).otherwise("manual")


def repair_rows(articles: DataFrame, now: str) -> DataFrame:
    """No score without relevance; no publication after ingest or after now, in this order."""
    at = F.least("published_at", "created_at")
    return articles.withColumns({"score": F.when(F.coalesce(F.col("relevance") == 0, F.lit(False)), F.lit(None)).otherwise(F.col("score")), "published_at": F.when(F.col("published_at").isNull(), F.col("published_at")).otherwise(F.least(at, ts(now)))})


def retain(articles: DataFrame, now: str, days: int) -> DataFrame:
    """Rows created since midnight ``days`` ago; links to rows that went become null, after the deletion."""
    kept = articles.filter(F.col("created_at") >= F.date_trunc("DAY", ts(now)).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAY"))
    there = kept.select(F.col("id").alias("there"))
    return kept.join(there, F.col("duplicate_of") == F.col("there"), "left").withColumn("duplicate_of", F.col("there")).drop("there")


def retry_queue(articles: DataFrame, now: str, max_attempts: int = 6, backoff_minutes: int = 30, newest: int = 200) -> DataFrame:
    """Of the ``newest`` failed rows with attempts left: those whose last attempt is long enough ago."""
    failed = articles.filter((F.col("status") == "failed") & (F.col("process_attempts") < max_attempts)).orderBy(*latest_first()).limit(newest)
    return failed.filter(F.col("process_last_at").isNull() | (F.col("process_last_at") <= ts(now) - F.expr(f"INTERVAL {backoff_minutes} MINUTE")))


def requeue(articles: DataFrame, now: str, **parameters) -> DataFrame:
    """``articles`` with the rows of ``retry_queue`` pending again; the queue is bounded, so it goes to every task."""
    again = retry_queue(articles, now, **parameters).select("id", F.lit(True).alias("__again"))
    return articles.join(F.broadcast(again), "id", "left").withColumn("status", F.when(F.col("__again"), "pending").otherwise(F.col("status"))).drop("__again")


def retry_stats(articles: DataFrame, now: str, max_attempts: int = 6, newest: int = 200) -> DataFrame:
    """One row: candidates looked at, those put back, and failed rows whose attempts are used up."""
    failed = articles.filter(F.col("status") == "failed")
    looked = failed.filter(F.col("process_attempts") < max_attempts).select("id").limit(newest).agg(F.count("*").alias("candidates"))
    back = retry_queue(articles, now, max_attempts, newest=newest).agg(F.count("*").alias("requeued"))
    spent = failed.agg(F.count_if(F.col("process_attempts") >= max_attempts).alias("exhausted"))
    return looked.crossJoin(back).crossJoin(spent)  # one row each


def retain_reports(reports: DataFrame, now: str, days: int) -> DataFrame:
    """Reports of the last ``days`` and of today; dates are text, year first."""
    return reports.filter(F.col("date") >= F.date_format(ts(now) - F.expr(f"INTERVAL {days} DAY"), "yyyy-MM-dd"))


def work_queue(articles: DataFrame, batch: int = 20) -> DataFrame:
    """Pending rows by attempts, then newest first."""
    return articles.filter((F.col("status") == "pending") & F.col("deleted_at").isNull()).orderBy("process_attempts", *latest_first()).limit(batch)


def reports_to_backfill(articles: DataFrame, reports: DataFrame, now: str, days: int = 7) -> DataFrame:
    """(date, live) of recent days that have articles and no report, or one with another count."""
    live = articles.filter(reportable()).groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("live"))
    asked = calendar(now, days).select(F.date_format("day", "yyyy-MM-dd").alias("date"))
    joined = F.broadcast(asked).join(live, "date").join(reports.select("date", "article_count"), "date", "left")
    return joined.filter(F.col("article_count").isNull() | (F.col("article_count") != F.col("live"))).select("date", "live")

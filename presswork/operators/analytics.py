"""The dashboard's panels and their drill-downs, over a frame of reportable articles in the window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions import text as T
from presswork.operators.visibility import ts

BUCKETS = (("85+", 85, 101), ("70-84", 70, 85), ("55-69", 55, 70), ("40-54", 40, 55), ("<40", 0, 40))


def share(part: Column, whole: Column, places: int = 1) -> Column:
    """Percent, half to even; 0 of nothing."""
    return F.when(whole > 0, F.bround(part / whole * 100, places)).otherwise(0.0)


def kpis(rows: DataFrame) -> DataFrame:
    """One row: totals, days, averages and shares. One pass, one small aggregate."""
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("starred") == 1).alias("starred"),
        F.countDistinct(F.to_date("published_at")).alias("active_days"),
        F.count_if(F.col("status") == "processed").alias("processed"),
        F.count_if((T.trimmed(F.coalesce("content_zh", F.lit(""))) != "") | ~T.looks_english(F.col("content_full"))).alias("translated"),
        F.coalesce(F.bround(F.avg("score"), 1), F.lit(0.0)).alias("avg_score"),
    ).withColumns({"processed_pct": share(F.col("processed"), F.col("total")), "translated_pct": share(F.col("translated"), F.col("total")), "per_day": F.when(F.col("active_days") > 0, F.bround(F.col("total") / F.col("active_days"), 1)).otherwise(0.0)})


def calendar(now: str, days: int) -> DataFrame:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    day = ts(now).cast("date")
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(day, days - 1), day)).alias("day"))


def daily_series(rows: DataFrame, now: str, days: int) -> DataFrame:
    """One row for each day of the range, empty days included, with the percentage of the peak and whether it is labelled."""
    counts = rows.groupBy(F.to_date("published_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("starred") == 1).alias("s"))
    series = calendar(now, days).join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("total"), F.coalesce("s", F.lit(0)).alias("starred"))
    # The series has ``days`` rows, whatever the corpus' size.
    whole = Window.partitionBy(F.lit(1))
    step = max(1, round(days / 7))
    return series.select(
        F.date_format("day", "yyyy-MM-dd").alias("date"),
        "total",
        "starred",
        share(F.col("total"), F.max("total").over(whole)).alias("pct"),
        ((F.row_number().over(whole.orderBy(F.desc("day"))) - 1) % step == 0).alias("show_label"),
    )


def distribution(rows: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """Counts and percent of all rows by a column; rows without a value count in the whole only. Ties by name."""
    total = rows.agg(F.count("*").alias("all"))
    counts = rows.filter(F.col(by).isNotNull() & (F.col(by) != "")).groupBy(F.col(by).alias("name")).agg(F.count("*").alias("count"))
    if top:
        counts = counts.orderBy(F.desc("count"), "name").limit(top)
    # The whole is one row.
    return counts.join(F.broadcast(total)).select("name", "count", share(F.col("count"), F.col("all")).alias("pct"))


def tag_counts(rows: DataFrame, top: int = 20, limit: int = 5) -> DataFrame:
    tags = rows.select(F.explode(T.split_tags(F.col("tags"), limit)).alias("name"))
    return tags.groupBy("name").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name").limit(top)


def hour_histogram(rows: DataFrame) -> DataFrame:
    from pyspark.sql import SparkSession

    counts = rows.groupBy(F.hour("published_at").alias("hour")).agg(F.count("*").alias("n"))
    hours = SparkSession.getActiveSession().range(24).select(F.col("id").cast("int").alias("hour"))
    out = hours.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("count"))
    return out.withColumn("pct", share(F.col("count"), F.max("count").over(Window.partitionBy(F.lit(1))), 0))


def bucket_of(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, low, high in BUCKETS:
        out = F.when((score >= low) & (score < high), label).otherwise(out)
    return out


def score_buckets(rows: DataFrame) -> DataFrame:
    """Five half-open score ranges, empty ones included, with percent of all scored rows."""
    counts = {label: F.count_if((F.col("score") >= low) & (F.col("score") < high)) for label, low, high in BUCKETS}
    one = rows.agg(F.count("score").alias("scored"), *[c.alias(label) for label, c in counts.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"`{label}`").alias("count")) for label in counts])).alias("b")
    return one.select("scored", pairs).select("b.label", "b.count", share(F.col("b.count"), F.col("scored")).alias("pct"))


def drill(rows: DataFrame, dimension: str, value: str = "") -> DataFrame:
    """The rows behind one element of a panel. Score ranges are the panel's own."""
    tests = {
        "category": F.col("category") == value,
        "tag": F.array_contains(T.split_tags(F.col("tags")), value),
        "starred": F.col("starred") == 1,
        "hour": F.hour("published_at").cast("string") == value,
        "score": bucket_of(F.col("score")) == value,
        "date": F.date_format("published_at", "yyyy-MM-dd") == value,
        "all": F.lit(True),
    }
    if dimension == "source":
        return rows.filter(F.col("source") == value)
    return rows.filter(tests[dimension])


def source_stats(articles: DataFrame) -> DataFrame:
    """(source_id, articles, newest); rows without a source are left out."""
    return articles.filter("source_id is not null").groupBy("source_id").agg(F.count("id").alias("articles"), F.max("published_at").alias("newest"))


def facets(rows: DataFrame) -> DataFrame:
    """(facet, name, count): categories by frequency, the 30 most frequent comma tags, 20 a row at most, and the first 60 topics."""
    from presswork.operators.reading import topic_list

    tags = rows.select(F.explode(F.slice(T.comma_tags(F.col("tags")), 1, 20)).alias("name")).groupBy("name").agg(F.count("*").alias("count"))
    tags = tags.orderBy(F.desc("count"), "name").limit(30)
    topics = rows.select(F.explode(topic_list(F.col("topics"))).alias("name")).groupBy("name").agg(F.count("*").alias("count")).orderBy("name").limit(60)
    cats = rows.filter("category is not null and category <> ''").groupBy(F.col("category").alias("name")).agg(F.count("*").alias("count"))
    named = lambda df, facet: df.select(F.lit(facet).alias("facet"), "name", "count")
    return named(cats, "category").unionByName(named(tags, "tag")).unionByName(named(topics, "topic"))


def counts_by_day(rows: DataFrame, dates: list[str]) -> DataFrame:
    """One row for each date asked for, in one aggregate over the rows of these days only."""
    from presswork.operators.visibility import in_day

    asked = rows.sparkSession.createDataFrame([(d,) for d in dates], "date string")
    wanted = F.lit(False)
    for d in dates:
        wanted = wanted | in_day(d)
    counts = rows.filter(wanted).groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("n"))
    return asked.join(F.broadcast(counts), "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("count"))  # one row for each date at most


def status_counters(articles: DataFrame, today: str, max_attempts: int = 6) -> DataFrame:
    """One row of counts; exhausted are the failed rows whose attempts are used up."""
    day = F.to_date("published_at") == F.lit(today).cast("date")
    return articles.agg(
        F.count("*").alias("articles"),
        F.count_if(day).alias("today"),
        F.count_if(day & (F.col("relevance") == 1)).alias("today_relevant"),
        F.count_if(day & (F.col("status") == "pending")).alias("today_pending"),
        F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"),
        F.count_if(F.col("deleted_at").cast("date") == F.lit(today).cast("date")).alias("deleted_today"),
        F.count_if(F.col("starred") == 1).alias("starred"),
        F.count_if(F.coalesce("content_full", F.lit("")) != "").alias("with_text"),
        F.count_if((F.col("status") == "failed") & (F.col("process_attempts") >= max_attempts)).alias("exhausted"),
    )

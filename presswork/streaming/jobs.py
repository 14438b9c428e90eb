"""Streams run to their end over a table's files, for queries and tests."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.operators.settling import shared_folder
from presswork.plans.articles import articles, table
from presswork.streaming import ingest


def work_folder(spark: SparkSession) -> str:
    """A folder that all executors share, below the session's checkpoint folder."""
    return f"{shared_folder(spark)}/streams/{uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, as a stream's plain path must be a folder and a table may be one file.
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode into a table by day, so days that the watermark has not closed yet count as well."""
    folder = work_folder(spark)
    ingest.run_available(ingest.daily_counts(_events(spark, sf_dir)), ingest.replace_days(f"{folder}/days"), f"{folder}/checkpoint", "update")
    return ingest.table_of(spark, f"{folder}/days", "day string, event_type string, n long").select(F.col("day").cast("string").alias("day"), "event_type", "n")


def final_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: the days behind the watermark, each written once."""
    folder = work_folder(spark)
    ingest.run_available(ingest.daily_counts(_events(spark, sf_dir)), lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/days/batch={n}"), f"{folder}/checkpoint", "append")
    return ingest.table_of(spark, f"{folder}/days", "day string, event_type string, n long").select("day", "event_type", "n")


def first_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items arrive in three files with repeated links; the sink stores each link once, its smallest id first."""
    folder = work_folder(spark)
    items = articles(spark, sf_dir).select("id", F.expr("concat('https://x.example.com/', cast(id div 4 as string))").alias("link"), "published_at")
    items.repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("id long, link string, published_at timestamp_ntz").parquet(f"{folder}/in")

    def write(batch: DataFrame, number: int) -> None:
        first = batch.groupBy("link").agg(F.min("id").alias("id"))
        ingest.insert_new(f"{folder}/out")(first, number)

    ingest.run_available(stream, write, f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("link", "id")

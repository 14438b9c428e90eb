"""Structured Streaming forms of ingest and of the rolling daily report."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions import text as T
from presswork.operators.ordered import Ring, kept_in_order
from presswork.operators.settling import settled
from presswork.operators.visibility import ts


def stream_of(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def marked(items: DataFrame, now: str, max_age_days: int = 14, at: str = "published_at") -> DataFrame:
    """``items`` with ``outcome`` (kept or stale): times more than six hours ahead are set to now before any watermark sees them,
    and items older than ``max_age_days`` are stale. Nothing vanishes, so a sink can count what is not kept."""
    clock = ts(now)
    clamped = items.withColumn(at, F.when(F.col(at) > clock + F.expr("INTERVAL 6 HOURS"), clock).otherwise(F.col(at)))
    stale = F.coalesce(F.col(at) < clock - F.expr(f"INTERVAL {max_age_days} DAY"), F.lit(False))
    return clamped.withColumn("outcome", F.when(stale, "stale").otherwise("kept"))


def admitted(items: DataFrame, now: str, max_age_days: int = 14, at: str = "published_at") -> DataFrame:
    """The kept rows of ``marked``."""
    return marked(items, now, max_age_days, at).filter("outcome = 'kept'").drop("outcome")


def first_by_link(items: DataFrame, lateness: str = "14 days", at: str = "published_at") -> DataFrame:
    """One item for each safe link within the watermark; state is dropped behind it."""
    rows = items.withColumn("link", T.safe_link(F.col("link"))).filter("link <> ''").withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["link"])


def daily_counts(events: DataFrame, at: str = "ts", key: str = "event_type", lateness: str = "2 days") -> DataFrame:
    """Tumbling days: (day, key, n). In update mode the rolling report, a row for each count that a batch changed (``replace_days``
    keeps them); in append mode each day once, when it is final: when the newest time is ``lateness`` past its end. In both the
    state is that of the days not yet final, however long the stream runs."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    days = rows.withWatermark(at, lateness).groupBy(F.window(at, "1 day").alias("w"), key).agg(F.count("*").alias("n"))
    return days.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), key, "n")


def sessions(events: DataFrame, gap: str = "6 hours", at: str = "ts", key: str = "user_id", lateness: str = "2 days") -> DataFrame:
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    return rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def recent_titles(items: DataFrame, keep: int = 500) -> DataFrame:
    """(source_id, id, title, repeated): whether a source's title is among its last ``keep`` normalised titles; state is those titles."""
    rows = items.select("source_id", "id", "title", T.normalize_title(F.col("title")).alias("key"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = list(state.get[0]) if state.exists else []
        for b in batches:
            b = b.sort_values("id")
            flags = []
            for k in b["key"]:
                flags.append(bool(k) and k in known)
                if k and k not in known:
                    known = [*known, k][-keep:]
            yield pd.DataFrame({"source_id": b["source_id"], "id": b["id"], "title": b["title"], "repeated": flags})
        state.update((known,))

    return rows.groupBy("source_id").applyInPandasWithState(run, "source_id int, id long, title string, repeated boolean", "known array<string>", "append", "NoTimeout")


def unlike_by_key(items: DataFrame, key: str = "source_id", window: int = 500, threshold: float = 0.9, idle: timedelta = timedelta(days=30)) -> DataFrame:
    """(key, id, title, like) of a stream of items: ``like`` is the newest kept title of the key that an item equals or resembles, null if it is kept.

    What counts is what was kept before an item in the order of ids, over all batches: each key's state is its ``window`` newest
    kept titles, which a restart from the checkpoint finds again, and a timer ends the state of a key without items for
    ``idle``. The items of a key in one batch are one task's, so ``files_per_batch`` of ``stream_of`` bounds them.
    """
    rows = items.select(F.col(key).cast("string").alias("key"), F.col("id").cast("long").alias("id"), "title", F.coalesce(T.normalize_title(F.col("title")), F.lit("")).alias("t"))
    run = kept_titles(window, threshold, int(idle.total_seconds() * 1000))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, id long, title string, like long", "ids array<long>, titles array<string>", "append", "ProcessingTimeTimeout")


def kept_titles(window: int, threshold: float, idle_ms: int) -> Callable:
    """The step of ``unlike_by_key`` for one key: its ring goes on over the batch's items, or ends with its timer."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ring = Ring(window, threshold, list(zip(*state.get)) if state.exists else [])
        batch = pd.concat(list(batches)).sort_values("id", kind="stable")
        likes = []
        for i, title in zip(batch["id"].tolist(), batch["t"].tolist()):
            like = ring.like(title)
            likes.append(like)
            if like is None:
                ring.add(i, title)
        state.update(([i for i, _ in ring.titles], [t for _, t in ring.titles]))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"key": batch["key"].tolist(), "id": batch["id"].tolist(), "title": batch["title"].tolist(), "like": pd.array(likes, "Int64")})

    return run


def insert_unlike(path: str, window: int = 500, threshold: float = 0.9) -> Callable[[DataFrame, int], None]:
    """A sink for items (id, link, title, ...) that keeps ingest's rules over its table, in the order of ids: an item goes if its
    link is in the table or was kept before it, or if its title is like one of the ``window`` newest titles that were kept
    before it, in any source. Like an item that went itself it may be. Ids grow from batch to batch.

    A batch that runs twice is decided by what was there before it, as the first time, and adds only what its table lacks.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = settled(batch)
        start = rows.agg(F.min("id")).first()[0]
        if start is None:
            return
        table = table_of(batch.sparkSession, path, batch.schema)
        kept = kept_in_order(rows, table.filter(F.col("id") < start).select("id", "link", "title"), window, threshold)
        settled(kept.join(table.select("id"), "id", "left_anti")).write.mode("append").parquet(path)

    return write


def replace_days(path: str, keys: tuple[str, ...] = ("day", "event_type")) -> Callable[[DataFrame, int], None]:
    """A sink for update mode: a table by day in which a batch's rows replace those of the same ``keys`` (the first is the day).

    Only the days of the batch are read and written again. Rows hold whole counts and no increments, so a batch that runs twice changes nothing.
    """
    day = keys[0]

    def write(batch: DataFrame, number: int) -> None:
        new = settled(batch)
        days = [r[0] for r in new.select(day).distinct().collect()]
        if not days:
            return
        before = table_of(batch.sparkSession, path, batch.schema).select(*batch.columns).filter(F.col(day).cast("string").isin(days))
        rows = settled(before.join(new.select(*keys), list(keys), "left_anti").unionByName(new))
        rows.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)

    return write


def table_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, empty where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def run_available(rows: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str, mode: str = "append", timers: bool = False) -> list[dict]:
    """Runs the stream over all there is: into a memory table by name, or through ``foreachBatch``. The checkpoint makes a rerun go on where it stopped.

    Returns the progress of its batches. With ``timers`` (state that ends by the clock) there are no batches without rows, which would go on for ever waiting for them.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false" if timers else before)
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.format("memory").queryName(sink) if isinstance(sink, str) else writer.foreachBatch(sink)
    query = writer.start()
    conf.set(name, before)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return [json.loads(p.json) for p in query.recentProgress]


def insert_new(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends the links its table doesn't have, so a batch that runs twice is stored once."""

    def write(batch: DataFrame, number: int) -> None:
        known = table_of(batch.sparkSession, path, "link string").select("link")
        batch.dropDuplicates(["link"]).join(known, "link", "left_anti").write.mode("append").parquet(path)

    return write


def count_outcomes(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps (batch, outcome, n): what every batch of ``marked`` items came to. A batch that runs twice replaces its counts."""

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("outcome").agg(F.count("*").alias("n")).withColumn("batch", F.lit(number))
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write

"""Streams over files, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.operators.visibility import ts
from presswork.plans.articles import NOW, articles
from presswork.streaming import ingest


def test_first_by_link_and_restart(spark, sf, tmp_path):
    items = articles(spark, sf).select("id", F.expr("concat('https://x/', cast(id div 4 as string))").alias("link"), "published_at")
    items.repartition(2).write.parquet(str(tmp_path / "in"))
    schema = items.schema
    stream = lambda: ingest.first_by_link(ingest.admitted(ingest.stream_of(spark, str(tmp_path / "in"), schema), NOW, 3650), "60 days")
    for _ in range(2):  # the second run finds nothing new
        ingest.run_available(stream(), ingest.insert_new(str(tmp_path / "out")), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("link").distinct().count() == items.select("link").distinct().count()


def test_future_is_clamped(spark):
    rows = spark.createDataFrame([("2024-03-01 00:00:00",), ("2023-01-01 00:00:00",), (None,)], "t string").select(F.col("t").cast("timestamp_ntz").alias("published_at"))
    got = ingest.admitted(rows, NOW)
    assert got.count() == 2 and got.filter(F.col("published_at") == ts(NOW)).count() == 1


def test_repeated_titles(spark, tmp_path):
    rows = [(1, n, t) for n, t in enumerate(["A b", "a B!", "c", "A b"])] + [(2, 9, "A b")]
    spark.createDataFrame(rows, "source_id int, id long, title string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_id int, id long, title string").parquet(str(tmp_path / "in"))
    ingest.run_available(ingest.recent_titles(stream), "titles_seen", str(tmp_path / "state"))
    got = {r["id"]: r["repeated"] for r in spark.table("titles_seen").collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 9: False}


def test_sessions(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = ingest.sessions(spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*"))
    ingest.run_available(stream, "user_sessions", str(tmp_path / "state"), "complete")
    assert spark.table("user_sessions").agg(F.sum("n")).first()[0] == events.count()


def test_stale_items_are_counted(spark, tmp_path):
    rows = [(1, "2024-01-30 00:00:00"), (2, "2023-01-01 00:00:00"), (3, None), (4, "2024-03-01 00:00:00")]
    spark.createDataFrame(rows, "id long, t string").select("id", F.col("t").cast("timestamp_ntz").alias("published_at")).write.parquet(str(tmp_path / "in"))
    stream = lambda: ingest.marked(ingest.stream_of(spark, str(tmp_path / "in"), "id long, published_at timestamp_ntz"), NOW)
    for state in ("a", "b"):  # a batch that runs again replaces its counts
        ingest.run_available(stream(), ingest.count_outcomes(str(tmp_path / "counts")), str(tmp_path / state))
    assert {r["outcome"]: r["n"] for r in spark.read.parquet(str(tmp_path / "counts")).collect()} == {"kept": 3, "stale": 1}


def test_titles_like_recent_ones_of_any_source_are_left_out(spark, tmp_path):
    first = [(1, "l1", "Apple announces the new neural engine for laptops", 1), (2, "l2", "中文标题没有空格所以只有一个词", 1)]
    second = [(3, "l3", "Apple announces a new neural engine for laptops", 2), (4, "l4", "中文标题没有空格所以只有一个词啊", 3), (5, "l1", "Quite another title", 2), (6, "l6", "Something new", 2), (7, "l7", "Something new!", 3)]
    schema = "id long, link string, title string, source_id int"
    for n, part in enumerate((first, second)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest.run_available(stream, ingest.insert_unlike(str(tmp_path / "out")), str(tmp_path / "state"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 6]


def test_rolling_days_in_update_mode(spark, tmp_path):
    """Sixty days in twelve files: the state stays that of the open days, batches that run twice change nothing, and the end equals the batch query."""
    times = spark.range(6000).selectExpr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 864) as ts", "concat('k', id % 3) as event_type")
    for n in range(12):  # files arrive in the order of their times
        times.filter((F.dayofyear("ts") - 1).between(5 * n, 5 * n + 4)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    calls, sink = [], ingest.replace_days(str(tmp_path / "days"))

    def twice(batch, number):
        calls.append(number)
        sink(batch, number)
        sink(batch, number)

    stream = lambda: ingest.daily_counts(ingest.stream_of(spark, str(tmp_path / "in"), times.schema, 1))
    progress = ingest.run_available(stream(), twice, str(tmp_path / "a"), "update")
    expected = {tuple(r) for r in times.groupBy(F.date_format("ts", "yyyy-MM-dd"), "event_type").count().collect()}
    assert {(str(r["day"]), r["event_type"], r["n"]) for r in spark.read.parquet(str(tmp_path / "days")).collect()} == expected
    states = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert len(calls) >= 12 and max(states) <= 3 * 16 < 3 * 60
    rows = []
    ingest.run_available(stream(), lambda b, n: rows.extend(map(tuple, b.collect())), str(tmp_path / "b"), "append")
    assert len(rows) == len(set(rows)) and set(rows) == {r for r in expected if r[0] <= "2024-02-26"}

"""Operators: invariants, and every registered query against its SQL."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from presswork.operators import enrichment, ingest, lifecycle, reading, stories
from presswork.operators.visibility import in_day, reportable
from presswork.plans import catalog
from presswork.plans import registry  # noqa: F401
from presswork.plans.articles import NOW, articles, sources


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    return value


#: Queries that SQL can't express, each with the test that holds it against a plain computation.
BY_BRUTE_FORCE = {
    "merge_stories": "test_merge_equals_replay",
    "title_fuzzy_dedup": "test_title_fuzzy_query_equals_brute_force",
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    if name not in catalog.ORACLES:
        tests = "".join(open(p, encoding="utf-8").read() for p in glob.glob(f"{os.path.dirname(__file__)}/*.py"))
        assert f"def {BY_BRUTE_FORCE[name]}(" in tests
        return
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    found = duck.execute(catalog.ORACLES[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    expected = [tuple(plain(r[order.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_no_reading_path_shows_hidden_rows(spark, sf):
    a = articles(spark, sf)
    hidden = a.filter("duplicate_of is not null or deleted_at is not null").select("id")
    for rows in (reading.search(a, "a", limit=500), reading.brief(a, NOW, 30), reading.cards(a, sources(spark, sf), NOW), a.filter(reportable())):
        assert rows.join(hidden, "id").count() == 0


def test_days_are_disjoint_and_cover(spark, sf):
    a = articles(spark, sf)
    days = [a.filter(in_day(f"2024-01-{d:02d}")).count() for d in range(1, 31)]
    assert sum(days) == a.count()
    assert a.filter(in_day("9999-99-99")).count() == 0


def test_repairs_are_idempotent(spark, sf):
    a = articles(spark, sf)
    once = stories.strip_shared_openings(a, passes=8).join(a.drop("content_full"), "id")
    assert stories.strip_shared_openings(once, passes=1).filter("stripped > 0").count() == 0
    stored = catalog.stored(spark, sf)
    fixed = lifecycle.repair_rows(stored, NOW)
    again = lifecycle.repair_rows(fixed, NOW)
    assert fixed.select("id", "score", "published_at").exceptAll(again.select("id", "score", "published_at")).count() == 0
    links = stories.repair_links(a).filter("not repaired").select("id", "duplicate_of")
    cleaned = a.drop("duplicate_of").join(links, "id", "left")
    assert stories.repair_links(cleaned).filter("repaired").count() == 0


def test_chains(spark):
    rows = [(1, None, None), (2, 1, None), (3, 2, None), (4, 99, None), (5, 6, None), (6, 5, None), (7, 8, None), (8, None, NOW), (9, 9, None)]
    a = spark.createDataFrame(rows, "id long, duplicate_of long, deleted_at string")
    assert {r["id"]: r["primary_id"] for r in stories.primary_of(a).collect()} == {2: 1, 3: 1, 4: None, 5: None, 6: None, 7: None, 9: None}


def test_long_chains_and_circles(spark, monkeypatch):
    """10,000 links in log rounds, a long circle with a tail, a chain that ends in a deleted article; a round reads the links twice."""
    n, rounds = 10_000, []
    chain = [(i, i - 1 if i else None, None) for i in range(n + 1)]
    circle = [(20_000 + i, 20_000 + (i + 1) % 500, None) for i in range(500)] + [(30_000, 20_003, None), (30_001, 30_000, None)]
    trash = [(40_000, None, NOW)] + [(40_000 + i, 40_000 + i - 1, None) for i in range(1, 40)]
    hot = [(50_000 + i, 0, None) for i in range(3000)]
    a = spark.createDataFrame(chain + circle + trash + hot, "id long, duplicate_of long, deleted_at string")
    one_round = stories._one_round
    monkeypatch.setattr(stories, "_one_round", lambda s: rounds.append(one_round(s)) or rounds[-1])
    got = {r["id"]: r["primary_id"] for r in stories.primary_of(a).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {50_000 + i: 0 for i in range(3000)} | {i: None for i, _, _ in circle} | {40_000 + i: None for i in range(1, 40)}
    assert len(rounds) <= 16
    plan = rounds[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan ExistingRDD") == 2


def test_merge_links_each_article_once(spark, sf):
    """A primary may be linked on to another by a later pair, as in the rule; every link leads to an end that is not linked."""
    links = {}
    for r in stories.merge(articles(spark, sf), lambda a, b: True).collect():
        assert r["id"] not in links
        links[r["id"]] = r["duplicate_of"]
    for start in links:
        seen, at = set(), start
        while at in links:
            assert at not in seen
            seen.add(at)
            at = links[at]


def test_fuzzy_titles(spark):
    known = spark.createDataFrame([(1, "Apple announces the new neural engine for laptops"), (2, "Something else entirely")], "id long, title string")
    items = spark.createDataFrame([(10, "Apple announces the new neural engine for laptop"), (11, "apple announces the NEW neural engine for laptops!"), (12, "Nothing"), (13, None)], "id long, title string")
    assert {tuple(r) for r in ingest.title_duplicates(items, known).collect()} == {(10, 1), (11, 1)}


def test_admission_order(spark):
    rows = [(1, 1, "2024-02-20 00:00:00", "long enough text"), (1, 2, None, "x"), (1, 3, "2023-01-01 00:00:00", "long enough text"), (1, 4, "2024-01-30 00:00:00", "long enough text"), (1, 5, "2024-01-30 00:00:00", "long enough text")]
    items = spark.createDataFrame(rows, "source_id int, pos int, t string, content string").withColumn("published_at", F.col("t").cast("timestamp_ntz"))
    got = {r["pos"]: r["outcome"] for r in ingest.admit(items, NOW, max_items=2, min_content_chars=5).collect()}
    assert got == {1: "kept", 2: "no_content", 3: "stale", 4: "kept", 5: "over_cap"}


def test_settled_items(spark):
    """Order of what becomes of kept items: bad links, duplicates by link in the run and in the table, by title, then blocked ones."""
    rows = [(1, "https://a/1", "One title of a story here", "x"), (2, "https://a/1", "Two", "x"), (3, "ftp://a", "Three", "x"), (4, "https://a/4", " ", "x"), (5, "https://k", "Five", "x"), (6, "https://a/6", "One known title of a story", "x"), (7, "https://a/7", "Bad word", "x"), (8, "https://a/8", "Stale", "x")]
    items = spark.createDataFrame(rows, "id long, link string, title string, content string").withColumn("outcome", F.when(F.col("id") == 8, "stale").otherwise("kept")).withColumn("source_id", F.col("id") % 2)
    known = spark.createDataFrame([(90, "https://k", "Known"), (91, "https://m", "One known title of a story!")], "id long, link string, title string")
    got = ingest.settle_kept(items, known, [(1, "word")])
    assert {r["id"]: r["outcome"] for r in got.collect()} == {1: "new", 2: "duplicated", 3: "bad_link", 4: "bad_link", 5: "duplicated", 6: "duplicated", 7: "blocked", 8: "stale"}
    assert ingest.settle_kept(items.limit(0), known).count() == 0


def test_observed_counts(spark, tmp_path):
    """One scan writes the rows and counts them; more sources than the histogram has bins for are an error, not a guess."""
    rows = spark.range(5000).selectExpr("cast(id % 97 as int) as source_id", f"element_at(array({', '.join(repr(o) for o in ingest.OUTCOMES)}), cast(1 + id % 7 as int)) as outcome")
    rows.write.parquet(str(tmp_path / "in"))
    stored, known = spark.read.parquet(str(tmp_path / "in")), spark.range(100).selectExpr("cast(id as int) as id")
    out, seen = ingest.observed_outcomes(stored, "many")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    out.write.parquet(str(tmp_path / "out"))
    assert seen.get["rows"] == 5000
    assert sorted(map(tuple, ingest.observed_report(seen, known).collect())) == sorted(map(tuple, ingest.run_report(stored, known).collect()))
    few, seen = ingest.observed_outcomes(stored, "few", most=20)
    few.write.format("noop").mode("overwrite").save()
    with pytest.raises(ValueError):
        ingest.observed_report(seen, known, most=20)


def test_day_is_ranked_by_minutes(spark, sf):
    rows = spark.range(5000).selectExpr("id", "timestamp_ntz'2024-01-15 00:00:00' + make_dt_interval(0, 0, 0, (id * 37) % 86400) as published_at")
    got = [r["id"] for r in reading.ranked_in_day(rows).orderBy("rank").collect()]
    assert got == [r["id"] for r in rows.orderBy(F.desc("published_at"), F.desc("id")).collect()]
    assert reading.ranked_in_day(rows.limit(0)).count() == 0


def test_page_window_and_clamp(spark, sf):
    assert reading.page_window(5, 10) == [1, None, 3, 4, 5, 6, 7, None, 10]
    rows = articles(spark, sf).filter(reportable())
    assert reading.page(rows, 99, 20).count() == (rows.count() - 1) % 20 + 1


def test_failed_calls_stay_for_retry(spark, sf):
    done = enrichment.judged(articles(spark, sf).limit(5), lambda p: 1 / 0)
    assert {tuple(r) for r in done.select("relevance", "status").collect()} == {(None, "failed")}
    assert enrichment.outcome_counts(done).first()["outcome"] == "failed"


def test_columns_are_pruned_at_the_scan(spark, sf):
    plan = articles(spark, sf).filter(reportable()).select("id", "source_id")._jdf.queryExecution().executedPlan().toString()
    schemas = [part.split(">")[0] for part in plan.split("ReadSchema: struct<")[1:]]
    assert len(schemas) == 2 and all("text" not in s and "toxic" not in s for s in schemas)

"""Dedup in feed order: in parts, in streams and over batches, against a plain loop."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from presswork.functions import text as T
from presswork.operators import ordered
from presswork.operators.settling import settled
from presswork.streaming import ingest

BASE = ("apple announces the new neural engine", "rocket reaches orbit again after years", "market falls sharply in early trading")
SCHEMA = "id long, link string, title string, source_id int"


def some_items(rng, ids):
    def title():
        t = rng.choice(BASE)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice("abcdefgh") + t[k + 1 :]
        return rng.choice([None, ""]) if rng.random() < 0.03 else t if rng.random() < 0.9 else "unique title number " + "".join(rng.choices("abcdefghijklmnop", k=20))

    return [(i, f"l{rng.randrange(2 * len(ids))}", title(), i % 3) for i in ids]


def alike(title, ring, threshold=0.9):
    return title and any(title == k or SequenceMatcher(None, title, k).ratio() > threshold for k in ring)


def loop(items, known, window):
    """The rule as one loop: (id, link, normalised title) in the order of ids."""
    links, ring, out = {link for _, link, _ in known}, [t for _, _, t in sorted(known)], []
    for i, link, title in sorted(items):
        if link not in links and not alike(title, ring[-window:]):
            out.append(i)
            links.add(link)
            ring.append(title)
    return out


def normal(df):
    return [tuple(r) for r in df.select("id", "link", F.coalesce(T.normalize_title(F.col("title")), F.lit("")).alias("t")).collect()]


@pytest.mark.parametrize(("window", "part_rows"), [(3, 1000), (5, 15), (500, 40)])
def test_kept_in_order(spark, window, part_rows):
    rng = random.Random(window)
    items = settled(spark.createDataFrame(some_items(rng, rng.sample(range(100, 2000), 150)), SCHEMA))
    known = settled(spark.createDataFrame(some_items(rng, list(range(20))), SCHEMA))
    got = ordered.kept_in_order(items, known, window, part_rows=part_rows)
    assert got.columns == items.columns
    assert sorted(r["id"] for r in got.collect()) == loop(normal(items), normal(known), window)
    assert ordered.kept_in_order(items.limit(0), known, window).count() == 0


def test_ring_keeps_the_newest():
    ring = ordered.Ring(3, 0.9)
    assert ring.like("abc") is None
    for i, t in enumerate(["one title", "two titles", "", "three titles here", "four"]):
        ring.add(i, t)
    assert [i for i, _ in ring.titles] == [2, 3, 4]
    assert ring.like("one title") is None and ring.like("three titles hers") == 3 and ring.like("four") == 4 and ring.like("") is None
    assert ordered.Ring(0, 0.9, [(1, "a")]).like("a") is None


def test_batches_of_a_stream_keep_the_order(spark, tmp_path):
    """The sink over several batches keeps what the loop keeps; a batch that runs twice changes nothing."""
    rng = random.Random(11)
    rows = some_items(rng, list(range(120)))
    sink = ingest.insert_unlike(str(tmp_path / "out"), window=20)
    for n in (0, 1, 1, 2):
        sink(spark.createDataFrame(rows[40 * n : 40 * n + 40], SCHEMA), n)
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["id"] for r in stored.collect()) == loop(normal(spark.createDataFrame(rows, SCHEMA)), [], 20)


def test_state_by_source_survives_a_restart(spark, tmp_path):
    """Three runs of the stream from one checkpoint give each source what its own loop gives."""
    rng, window = random.Random(12), 10
    rows = some_items(rng, list(range(90)))
    for n in range(3):
        spark.createDataFrame(rows[30 * n : 30 * n + 30], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.unlike_by_key(ingest.stream_of(spark, str(tmp_path / "in"), SCHEMA), window=window)
        ingest.run_available(stream, lambda b, _: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "checkpoint"), timers=True)
    got = {r["id"]: r["like"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected, rings = {}, {}
    for i, _, title in sorted(normal(spark.createDataFrame(rows, SCHEMA))):
        ring = rings.setdefault(i % 3, [])
        expected[i] = bool(alike(title, ring[-window:]))
        if not expected[i]:
            ring.append(title)
    assert {i: like is not None for i, like in got.items()} == expected


def test_idle_state_ends():
    class State:
        exists, hasTimedOut, removed = True, True, False

        def remove(self):
            self.removed = True

    state = State()
    assert list(ingest.kept_titles(5, 0.9, 1000)(("k",), iter(()), state)) == [] and state.removed

"""Title dedup in the order of a feed: an item is held against what was kept before it, over the newest titles."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions import text as T
from presswork.operators.settling import settled

BINS = 64


def profile(title: str) -> np.ndarray:
    """How often each of ``BINS`` classes of characters occurs. The smaller counts of two titles, summed, are at least what they can have in common."""
    points = np.frombuffer(title.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount((points * np.uint32(2654435761) >> np.uint32(26)) % BINS, minlength=BINS).astype(np.int32)


class Ring:
    """The newest kept titles (id, normalised title), ``window`` at most, the oldest first."""

    def __init__(self, window: int, threshold: float, titles: list[tuple[int, str]] = ()) -> None:
        self.window, self.threshold = window, threshold
        self.titles: deque[tuple[int, str]] = deque()
        self.profiles = np.zeros((window, BINS), np.int32)
        self.lengths = np.zeros(window, np.int64)
        self.added = 0
        for i, title in titles:
            self.add(i, title)

    def add(self, i: int, title: str) -> None:
        if not self.window:
            return
        at = self.added % self.window
        self.profiles[at], self.lengths[at] = (profile(title), len(title)) if title else (0, 0)
        self.added += 1
        self.titles.append((i, title))
        if len(self.titles) > self.window:
            self.titles.popleft()

    def like(self, title: str) -> int | None:
        """The id of the newest title that is equal or alike by more than the threshold; None for empty titles."""
        if not title or not self.titles:
            return None
        n = len(self.titles)
        most = np.minimum(self.profiles[:n], profile(title)).sum(axis=1)
        near = np.flatnonzero(2 * most > self.threshold * (self.lengths[:n] + len(title)))
        # Places in the arrays run round; ``ago`` is how many titles have come since.
        for ago in sorted(((self.added - 1 - at) % self.window for at in near.tolist())):
            i, known = self.titles[-1 - ago]
            if known == title or SequenceMatcher(None, title, known).ratio() > self.threshold:
                return i
        return None


def newest_titles(known: DataFrame, window: int) -> list[tuple[int, str]]:
    """The ``window`` newest (id, normalised title) of a table, the oldest first."""
    rows = known.orderBy(F.desc("id")).limit(window).select("id", T.normalize_title(F.col("title")).alias("t")).collect()
    return [(r["id"], r["t"] or "") for r in reversed(rows)]


WINDOW = "array<struct<id long, t string>>"
DECIDED = f"part long, id long, like long, window {WINDOW}"


def _decide(start: list[tuple[int, str]], window: int, threshold: float):
    """A function that goes through one part in order, from the ring it starts with, and hands on the ring it ends with."""

    def run(key: tuple, rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        given = before["window"].iloc[0] if len(before) else None
        ring = Ring(window, threshold, start if given is None else [(r["id"], r["t"]) for r in given])
        likes = []
        for i, title in zip(rows["id"].tolist(), rows["t"].tolist()):
            like = ring.like(title)
            likes.append(like)
            if like is None:
                ring.add(i, title)
        ends = [{"id": i, "t": t} for i, t in ring.titles]
        out = pd.DataFrame({"part": key[0], "id": [*rows["id"].tolist(), None], "like": [*likes, None], "window": [*[None] * len(rows), ends]})
        return out.astype({"id": "Int64", "like": "Int64"})

    def ordered(key: tuple, rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        return run(key, rows.sort_values("id", kind="stable"), before)

    return ordered


def unlike_earlier(items: DataFrame, known: DataFrame, window: int = 500, threshold: float = 0.9, part_rows: int = 50_000) -> DataFrame:
    """(id, like) of items (id, title) in the order of their ids: ``like`` is the newest kept title that an item equals or resembles by
    more than ``threshold``, null if the item is kept. Held against an item are the ``window`` newest titles of what was kept before it,
    at first those of ``known``. Null and empty titles are like nothing and kept, and count in the window.

    The same as one loop over the feed, but in parts of the order that run side by side: each starts from the ring of titles in
    which the part before it ended. A part whose ring was not yet known right is run again when that has changed; as a ring is
    full of a part's own titles after a few hundred items, this is over after two or three rounds, whatever the number of parts.
    """
    rows = items.select(F.col("id").cast("long").alias("id"), F.coalesce(T.normalize_title(F.col("title")), F.lit("")).alias("t"))
    parts = max(1, -(-rows.count() // part_rows))
    placed = settled(rows.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id().cast("long")))
    # Parts in a row without gaps, as some ranges may be empty.
    numbers = sorted(r["part"] for r in placed.select("part").distinct().collect())
    run = _decide(newest_titles(known, window), window, threshold)
    before = dict(zip(numbers[1:], numbers))
    spark = items.sparkSession
    follows = spark.createDataFrame([(p, q) for p, q in before.items()], "part long, ended long")
    nothing = spark.createDataFrame([], f"part long, window {WINDOW}")
    decided = settled(placed.groupBy("part").cogroup(nothing.groupBy("part")).applyInPandas(run, DECIDED))
    used = follows.select("part", F.lit(None).cast(WINDOW).alias("window"))
    while True:
        ends = decided.filter("window is not null").select(F.col("part").alias("ended"), "window")
        starts = follows.join(ends, "ended").select("part", "window")
        told = starts.join(used.select("part", F.col("window").alias("had")), "part").filter(~F.col("window").eqNullSafe(F.col("had"))).select("part", "window")
        again = settled(told)
        if again.isEmpty():
            return decided.filter("window is null and id is not null").select("id", "like")
        redone = placed.join(again.select("part"), "part", "left_semi").groupBy("part").cogroup(again.groupBy("part")).applyInPandas(run, DECIDED)
        decided = settled(decided.join(again.select("part"), "part", "left_anti").unionByName(redone))
        used = settled(used.join(again.select("part"), "part", "left_anti").unionByName(again))


def kept_in_order(items: DataFrame, known: DataFrame, window: int = 500, threshold: float = 0.9, part_rows: int = 50_000) -> DataFrame:
    """``items`` (id, link, title, ...) as a loop over them in the order of ids keeps them: an item goes if its link is known or was kept
    before it, or if its title is like one of the ``window`` newest of what was known and kept (``unlike_earlier``).

    Whether an item's link was *kept* before depends on the titles, and these on what is kept. At first all but the first item of
    a link are taken to be out. Where the titles then drop that first one, the next item of its link comes in and the titles are
    decided again; rounds end when nothing comes in or goes out, and only links with several items take part in them.
    """
    new = settled(items.join(known.select("link").distinct(), "link", "left_anti").select("id", "link", "title"))
    several = settled(new.join(new.groupBy("link").agg(F.count("*").alias("n")).filter("n > 1").select("link"), "link", "left_semi").select("id", "link"))
    out = settled(several.join(several.groupBy("link").agg(F.min("id").alias("first")), "link").filter("id <> first").select("id"))
    while True:
        likes = settled(unlike_earlier(new.join(out, "id", "left_anti"), known, window, threshold, part_rows))
        # The first item of each link that the titles keep; those of the link before it were dropped by their titles.
        kept = several.join(likes.filter("like is null").select("id"), "id", "left_semi").groupBy("link").agg(F.min("id").alias("kept"))
        dropped = likes.filter("like is not null").select("id")
        # An item is out if an earlier one of its link is kept; of a link with none kept the next one comes in.
        waiting = several.join(kept, "link", "left_anti").join(dropped, "id", "left_anti").groupBy("link").agg(F.min("id").alias("next"))
        after = several.join(kept, "link").filter("id > kept").select("id")
        still = several.join(waiting, "link").filter("id > next").select("id")
        now = settled(after.unionByName(still))
        if now.exceptAll(out).isEmpty() and out.exceptAll(now).isEmpty():
            return items.join(likes.filter("like is null").select("id"), "id", "left_semi")
        out = now

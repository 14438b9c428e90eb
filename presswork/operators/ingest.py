"""Admission of feed items: gates, caps, exact and fuzzy duplicates, run statistics."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from presswork.functions import text as T
from presswork.operators.rules import first_match
from presswork.operators.visibility import ts

FUTURE = "INTERVAL 6 HOURS"


def admit(items: DataFrame, now: str, max_age_days: int = 14, max_items: int = 50, min_content_chars: int = 0) -> DataFrame:
    """``items`` with ``outcome`` (kept, stale, no_content, over_cap) and the flags no_date and future.

    Items are (source_id, pos, published_at, content, ...). In this order: a time more than six hours ahead is set
    to now; a missing time is counted and let through; too old items go; too short ones go; of the rest each
    source keeps its first ``max_items`` in feed order; positions are unique in a source.
    """
    clock = ts(now)
    future = F.coalesce(F.col("published_at") > clock + F.expr(FUTURE), F.lit(False))
    rows = items.withColumns({"future": future, "no_date": F.col("published_at").isNull()})
    rows = rows.withColumn("published_at", F.when(F.col("future"), clock).otherwise(F.col("published_at")))
    stale = F.coalesce(F.col("published_at") < clock - F.expr(f"INTERVAL {max_age_days} DAY"), F.lit(False)) if max_age_days > 0 else F.lit(False)
    short = (F.char_length(T.strip_html(F.col("content"))) < min_content_chars) if min_content_chars > 0 else F.lit(False)
    rows = rows.withColumn("outcome", F.when(stale, "stale").when(short, "no_content").otherwise("kept"))
    if max_items <= 0:
        return rows
    # The cap's last position of each source: the limit on ranks works before the shuffle, so a source with very many
    # items sends its first ones only. The positions, one row a source, are then looked up.
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy("pos"))
    first = rows.filter("outcome = 'kept'").select("source_id", "pos").withColumn("r", rank).filter(F.col("r") <= max_items)
    last = first.groupBy("source_id").agg(F.max("pos").alias("__last")).withColumnRenamed("source_id", "__source")
    capped = rows.join(last, F.col("source_id").eqNullSafe(F.col("__source")), "left")
    over = (F.col("outcome") == "kept") & (F.col("pos") > F.col("__last"))
    return capped.withColumn("outcome", F.when(over, "over_cap").otherwise(F.col("outcome"))).drop("__source", "__last")


def run_stats(admitted: DataFrame) -> DataFrame:
    """(source_id, fetched, kept, stale, no_content, over_cap, no_date, future): one aggregate over the outcomes."""
    count = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return admitted.groupBy("source_id").agg(F.count("*").alias("fetched"), *map(count, ("kept", "stale", "no_content", "over_cap")), F.count_if("no_date").alias("no_date"), F.count_if("future").alias("future"))


def settle_kept(admitted: DataFrame, known: DataFrame, block: list[tuple[int, str]] = (), window: int = 500) -> DataFrame:
    """``admitted`` (id, link, title, content, outcome, ...) with what becomes of the kept items: new, bad_link, duplicated or blocked.

    Duplicated are links that are known or were kept before in the run (the smallest id counts as the first), and titles
    like one of the ``window`` newest known ones. Both are found on one row a link or an item, so no link is a hot key.
    """
    kept = admitted.filter("outcome = 'kept'").withColumn("link", F.substring(T.safe_link(F.col("link")), 1, 1000))
    usable = kept.filter((F.col("link") != "") & (T.trimmed(F.coalesce("title", F.lit(""))) != ""))
    first = usable.groupBy("link").agg(F.min("id").alias("id")).join(known.select("link").distinct(), "link", "left_anti").select("id")
    if window > 0:
        first = first.join(title_duplicates(usable.select("id", "title"), known, window=window).select("id"), "id", "left_anti")
    marks = usable.select(F.col("id").alias("__id"), F.lit(True).alias("__usable")).join(first.select(F.col("id").alias("__id"), F.lit(True).alias("__first")), "__id", "left")
    rows = admitted.join(marks, F.col("id") == F.col("__id"), "left")
    blocked = first_match(F.concat_ws("\n", "title", T.strip_html(F.col("content"))), list(block)).isNotNull()
    fate = F.when(F.col("__usable").isNull(), "bad_link").when(F.col("__first").isNull(), "duplicated").when(blocked, "blocked").otherwise("new")
    return rows.withColumn("outcome", F.when(F.col("outcome") == "kept", fate).otherwise(F.col("outcome"))).drop("__id", "__usable", "__first")


OUTCOMES = ("new", "duplicated", "blocked", "bad_link", "stale", "no_content", "over_cap")


def run_report(settled_items: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, status, fetched, one column for each outcome): every source of the run; those without items are empty."""
    counts = settled_items.groupBy("source_id").agg(F.count("*").alias("fetched"), *[F.count_if(F.col("outcome") == name).alias(name) for name in OUTCOMES])
    return _reported(sources, counts)


def _reported(sources: DataFrame, counts: DataFrame) -> DataFrame:
    rows = sources.select(F.col("id").alias("source_id")).join(counts, "source_id", "left").fillna(0, ["fetched", *OUTCOMES])
    return rows.select("source_id", F.when(F.col("fetched") == 0, "empty").otherwise("ok").alias("status"), "fetched", *OUTCOMES)


def observed_outcomes(settled_items: DataFrame, name: str = "outcomes", most: int = 10_000) -> tuple[DataFrame, Observation]:
    """The rows as they are, and an observation that has their counts by source and outcome once they have been written: the report
    then costs no second pass. Sources are whole numbers; ``most`` pairs of source and outcome can be told apart.
    """
    seen = Observation(name)
    code = F.col("source_id").cast("long") * len(OUTCOMES) + F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome")) - 1
    # A histogram of whole numbers is exact while it has a bin for each of them.
    return settled_items.observe(seen, F.count(F.lit(1)).alias("rows"), F.histogram_numeric(code, F.lit(most + 1)).alias("codes")), seen


def observed_report(seen: Observation, sources: DataFrame, most: int = 10_000) -> DataFrame:
    """``run_report`` from an observation of rows that have been written."""
    bins = seen.get["codes"] or []
    if len(bins) > most:
        raise ValueError(f"more than {most} pairs of source and outcome: use run_report")
    rows: dict[int, dict[str, int]] = {}
    for b in bins:
        source, k = divmod(int(b["x"]), len(OUTCOMES))
        rows.setdefault(source, dict.fromkeys(OUTCOMES, 0))[OUTCOMES[k]] += int(b["y"])
    counts = sources.sparkSession.createDataFrame([(s, sum(c.values()), *c.values()) for s, c in rows.items()], "source_id long, fetched long, " + ", ".join(f"{n} long" for n in OUTCOMES))
    return _reported(sources, counts)


def new_by_link(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items with a safe link that is not known yet, the first of each link; titles and links are cut to their columns' lengths."""
    rows = items.withColumn("link", F.substring(T.safe_link(F.col("link")), 1, 1000)).filter("link <> ''").withColumn("title", F.substring("title", 1, 500))
    first = rows.groupBy("link").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "link"]), "pos").alias("r"))
    return first.join(known.select("link").distinct(), "link", "left_anti").select("link", "r.*")


def seed(new: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """``known`` and those of ``new`` whose key it doesn't have; nothing known changes."""
    return known.unionByName(new.dropDuplicates([key]).join(known.select(key), key, "left_anti"), allowMissingColumns=True)


def _profiles(titles: list[str], bins: int = 64) -> np.ndarray:
    """How often each of ``bins`` classes of characters occurs in each title. The smaller counts of two titles, summed, are
    at least the number of characters that they can have in common."""
    lengths = [len(t) for t in titles]
    points = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), "<u4")
    places = np.repeat(np.arange(len(titles)), lengths) * bins + (points * np.uint32(2654435761) >> np.uint32(26)) % bins
    return np.bincount(places, minlength=len(titles) * bins).reshape(len(titles), bins).astype(np.int32)


def title_duplicates(items: DataFrame, known: DataFrame, threshold: float = 0.9, window: int = 500) -> DataFrame:
    """(id, known_id) of items whose title equals one of the ``window`` newest known titles (by id), or resembles one by more than ``threshold``.

    Titles are compared as ``normalize_title`` gives them, so that the ratio is one of characters in any script; known_id is
    the smallest such id but the item's own. The window is the bound of what goes to the executors: every item is held
    against all of it where it is read, without a shuffle. Lengths and counts of characters bound the ratio from above, so
    only pairs that may exceed it are compared in full, and none is lost.
    """
    newest = known.orderBy(F.desc("id")).limit(window).select("id", T.normalize_title(F.col("title")).alias("t")).filter("t <> ''").collect()
    ids_of: dict[str, list[int]] = {}
    for r in sorted(newest, key=lambda r: r["id"]):
        ids_of.setdefault(r["t"], []).append(r["id"])
    sent = items.sparkSession.sparkContext.broadcast({t: ids[:2] for t, ids in ids_of.items()})  # the second serves the first itself

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        titles = list(sent.value)
        theirs, lengths = _profiles(titles), np.array([len(t) for t in titles])
        matchers = [SequenceMatcher(None, "", t) for t in titles]
        found: dict[str, list[int]] = {}

        def like(title: str) -> list[int]:
            if not titles:
                return []
            most = np.minimum(_profiles([title]), theirs).sum(1)
            out = [k for k in np.flatnonzero(2 * most > threshold * (lengths + len(title))).tolist() if titles[k] == title or _ratio(matchers[k], title) > threshold]
            return sorted(i for k in out for i in sent.value[titles[k]])

        for b in batches:
            rows = []
            for i, t in zip(b["id"].tolist(), b["t"].tolist()):
                if t not in found:
                    if len(found) > 100_000:
                        found.clear()
                    found[t] = like(t)
                rows += [(i, k) for k in found[t] if k != i][:1]
            yield pd.DataFrame(rows, columns=["id", "known_id"])

    own = items.select(F.col("id").cast("long").alias("id"), T.normalize_title(F.col("title")).alias("t")).filter("t <> ''")
    return own.mapInPandas(alike, "id long, known_id long")


def _ratio(matcher: SequenceMatcher, title: str) -> float:
    matcher.set_seq1(title)
    return matcher.ratio()


def source_language(texts: DataFrame, sample: int = 8, threshold: float = 0.12) -> DataFrame:
    """(source_id, lang): by the share of Han characters in the first ``sample`` texts of each source; en where there are no letters."""
    first = texts.withColumn("r", F.row_number().over(Window.partitionBy("source_id").orderBy("id"))).filter(F.col("r") <= sample)
    counts = first.groupBy("source_id").agg(F.sum(T.han_chars(F.col("content_full"), 2000)).alias("han"), F.sum(T.latin_letters(F.col("content_full"), 2000)).alias("latin"))
    return counts.select("source_id", F.when(F.coalesce(F.try_divide("han", F.col("han") + F.col("latin")), F.lit(0.0)) >= threshold, "zh").otherwise("en").alias("lang"))

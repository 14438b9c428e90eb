"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target of words. Its documents are taken whole: everyone
``floor(rate)`` times, and one time more with the rate's fraction as inclusion
probability, where rate is target / size. Which documents get the extra copy is
drawn with the cube method: the probabilities move through the null space of
the constraints (sum of words, number of documents) until they are 0 or 1, so
both totals stay at their expectation, and only a small landing problem remains.

The flight runs per (source, shard); each leaves a few open units, small
documents of unlike sizes, which meet in fewer shards in the next round. The last round, one shard per source,
also lands: of all selections of its open units (18 at most) the one is taken whose words come nearest the
target, and then swaps of two documents bring them nearer still where any does.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm.common import id_back, id_key, settled, text_of, word_count

EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Moves ``p`` until two units at most are strictly between 0 and 1; sum(p) and sum(p * size) stay as they are.

    Three open units always have a direction that keeps both sums: the cross product of (1, 1, 1) and their sizes.
    """
    p = p.astype(float).copy()
    open_units: list[int] = []
    q, s, draw = p.tolist(), size.astype(float).tolist(), draws.tolist()
    for k in range(len(q)):
        if not EPS < q[k] < 1 - EPS:
            q[k] = float(round(q[k]))
            continue
        open_units.append(k)
        if len(open_units) < 3:
            continue
        a, b, c = open_units
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        # The longest steps forth and back that keep all three in [0, 1].
        forth = min(((1 - q[i]) / d if d > 0 else -q[i] / d) for i, d in zip(open_units, u) if d)
        back = min((q[i] / d if d > 0 else (q[i] - 1) / d) for i, d in zip(open_units, u) if d)
        step = forth if draw[k] < back / (forth + back) else -back
        for i, d in zip((a, b, c), u):
            q[i] = min(1.0, max(0.0, q[i] + step * d))
        open_units = [i for i in (a, b, c) if EPS < q[i] < 1 - EPS]
        for i in (a, b, c):
            if i not in open_units:
                q[i] = float(round(q[i]))
        if len(open_units) == 3:  # rounding errors only: the nearest to a bound is closed
            i = min(open_units, key=lambda j: min(q[j], 1 - q[j]))
            q[i] = float(round(q[i]))
            open_units.remove(i)
    return np.array(q)


def spread_spares(n_units: int, n_spares: int) -> np.ndarray:
    """Places of the units that move last, in an order of falling size: the smallest one and others evenly spread over the lower half.

    Small and unlike sizes let their sums come near any number of words.
    """
    return np.unique(np.linspace(n_units - 1, min(n_units // 2, max(0, n_units - n_spares)), n_spares).astype(int))


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The open units (a few) rounded so that the sum of words comes nearest its expectation, then the number of documents.

    All selections of the open units are looked at.
    """
    p = p.copy()
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if len(left):
        words, units = float((p[left] * size[left]).sum()), float(p[left].sum())
        sums, counts = np.zeros(1), np.zeros(1)
        for s in size[left].tolist():
            sums, counts = np.concatenate((sums, sums + s)), np.concatenate((counts, counts + 1))
        # Words are whole, so errors that differ by less than a word's rounding count as equal, and documents decide.
        off = np.abs(sums - words)
        near = np.flatnonzero(off <= off.min() + 1e-6)
        best = int(near[np.argmin(np.abs(counts[near] - units))])
        p[left] = (best >> np.arange(len(left))) & 1
    return np.round(p)


def swap(p: np.ndarray, size: np.ndarray, error: float, swaps: int = 64) -> np.ndarray:
    """While it brings the words nearer (``error``: taken less wanted), the best swap of a taken for an untaken unit; the number of documents stays."""
    p = p.copy()
    for _ in range(swaps):
        taken, free = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        if abs(error) < 1 or not len(taken) or not len(free):
            break
        free = free[np.argsort(size[free], kind="stable")]
        wanted = size[taken] - error
        at = np.searchsorted(size[free], wanted)
        sides = np.stack((np.clip(at - 1, 0, len(free) - 1), np.clip(at, 0, len(free) - 1)))
        off = np.abs(size[free][sides] - wanted)
        side, k = np.unravel_index(int(np.argmin(off)), off.shape)
        new = error - size[taken[k]] + size[free[sides[side, k]]]
        if abs(new) >= abs(error) - 1e-9:
            break
        p[taken[k]], p[free[sides[side, k]]], error = 0, 1, new
    return p


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): ``sizes`` is (source, source_size), one row a source.

    Sources by code point, null last, get the weights in turn. They share ``share`` times all sizes by
    weight; a target stops at ``cap`` times its source's size, and the excess is shared again by weight
    among the others, until none is above. Ranks come from a range-partitioned sort with an offset for
    each partition and the sums from aggregates, so the number of sources may be large.
    """
    ordered = settled(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    parts = ordered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    ranked = ordered.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offsets), "part")
    turn = (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))) % len(weights)
    ranked = settled(ranked.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("weight"), (F.col("source_size") * cap).alias("most")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    per_weight = None  # words for each unit of weight
    while True:
        full = F.lit(False) if per_weight is None else F.col("weight") * per_weight > F.col("most")
        capped, open_weight = ranked.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (share * total - (capped or 0.0)) / open_weight if open_weight else float("inf")
        if per_weight is not None and new <= per_weight * (1 + 1e-12):
            break
        per_weight = new
        if per_weight == float("inf"):
            break
    target = F.col("most") if per_weight == float("inf") else F.least("most", F.col("weight") * per_weight)
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


_UNIT = ["row", "doc_id", "source", "size", "source_size", "target", "whole", "draw", "p"]


#: So many of a group's documents move last: in a shard they stay open for the next round, in the end all selections of them are tried.
SPARE_SHARD, SPARE_LAST = 10, 16


def _fly(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large documents move first, so that those left open, to be landed, are small. Order and directions
        # come from sizes and the ids' hashes: the same draw in every run.
        pdf = pdf.sort_values(["size", "draw", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
        size = pdf["size"].to_numpy()
        draws = (pdf["draw"].to_numpy() * 32749) % 1
        first = pdf["p"].to_numpy()
        moving = np.ones(len(pdf), bool)
        moving[spread_spares(len(pdf), SPARE_LAST if last else SPARE_SHARD)] = False
        p = first.copy()
        p[moving] = flight(p[moving], size[moving], draws[moving])
        if last:
            p = land(p, size)
            p = swap(p, size, float(((p - first) * size).sum()))
        pdf["p"] = p
        return pdf[_UNIT]

    return fly


def _split_heavy(units: DataFrame, shard_docs: int) -> DataFrame:
    """``units`` whose shards of more than four times ``shard_docs`` rows, as many rows of one id and size make, are dealt over shards of their own by row."""
    heavy = settled(units.groupBy("source", "shard").agg(F.count("*").alias("__n")).filter(F.col("__n") > 4 * shard_docs).select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), F.ceil(F.col("__n") / shard_docs).alias("__parts")))
    if heavy.isEmpty():
        return units
    met = units.join(heavy, units["source"].eqNullSafe(heavy["__source"]) & (units["shard"] == heavy["__shard"]), "left")
    part = F.pmod(F.xxhash64("row"), F.col("__parts"))
    return met.withColumn("shard", F.when(F.col("__parts").isNull(), F.col("shard")).otherwise(F.xxhash64("shard", part))).select(*units.columns)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, shard_docs: int = 1024, broadcast_sources: int = 50_000, row: str | None = None) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies, taken) for every row of ``docs``.

    ``size`` is the number of ASCII-white-space-separated words (null text: 0); ``copies`` is how often
    the mix takes the document (0 up to ``cap``), ``taken`` = copies * size. Documents without words are
    taken ``floor(rate)`` times or once more like any other. A null source is a source of its own, the
    last. Repeated rows and rows with a null id are units of their own. An empty table gives an empty
    result. Draws come from a hash of the id and size, so reruns agree. ``row`` names a column of whole numbers that tells the
    rows apart, which the result carries; without it rows are numbered here. Only where rows of one id and size (null ids,
    repeated rows) fill a shard several times over does it decide which of these equals go where.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    sized = settled(docs.select(number.alias("row"), id_key().alias("doc_id"), "source", word_count(text_of()).cast("long").alias("size")))
    # (source, size) sums are made on the map side first, so that a hot source costs one row a task.
    stats = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    stats = settled(stats)
    n_sources, n_docs = stats.count(), sized.count()
    side = stats.select(F.col("source").alias("__source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = sized.join(F.broadcast(side) if n_sources <= broadcast_sources else side, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    units = units.withColumns({"whole": F.floor(rate + F.lit(EPS)), "draw": F.pmod(F.xxhash64("doc_id", "size", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))})
    units = units.withColumn("p", F.greatest(F.lit(0.0), rate - F.col("whole")))
    schema = "row long, doc_id long, source string, size long, source_size long, target double, whole long, draw double, p double"
    done, shards = [], max(1, -(-n_docs // shard_docs))
    level = 0
    while True:
        last = shards == 1

        shard = F.pmod(F.xxhash64("doc_id", "size", F.lit(level)), F.lit(shards))
        dealt = units.withColumn("shard", shard)
        if level == 0 and not last:
            dealt = _split_heavy(dealt, shard_docs)
        flown = dealt.groupBy("source", "shard").applyInPandas(_fly(last), schema)
        if last:
            done.append(flown)
            break
        flown = settled(flown)
        done.append(flown.filter("p = 0 or p = 1"))
        units, shards, level = flown.filter("p > 0 and p < 1"), max(1, shards // 128), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.round("p")).cast("long")
    return out.select("row", id_back().alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies say; the columns stay as they are.

    Rows are numbered and settled first, so every row has its own part of the plan: null and repeated ids and equal rows
    too. Null texts have no words and null sources are a source, as in ``mix``. An empty table gives an empty result.
    """
    numbered = settled(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*docs.columns).alias("__doc")))
    plan = mix(numbered.select("__row", "__doc.doc_id", "__doc.source", "__doc.text"), row="__row", **parameters)
    taken = numbered.join(plan.filter("copies > 0").select(F.col("row").alias("__row"), F.col("copies").cast("int").alias("__copies")), "__row")
    return taken.select("__doc", F.explode(F.array_repeat(F.lit(1), F.col("__copies")))).select("__doc.*")

"""Document fingerprints of closed syncmers.

A k-mer of code points is a closed syncmer when the smallest of its inner
s-mers stands at its first or last place. Whether a k-mer is chosen depends on
nothing around it, so an edit moves no anchor beyond the k-mers it touches, and
the anchors of the rest match by value and by position. A fingerprint holds the
``size`` anchors of smallest value of the whole text with their positions.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm.common import id_back, id_key, mixed, powers, settled, text_of

_ANCHOR = np.dtype([("value", "<u4"), ("at", "<u4")])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    have, low = 1, x
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


def syncmers(text: str, k: int = 16, s: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(values, positions) of all closed syncmers of the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(points)
    if n < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    power, inverse = powers(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * power)))
    inner = mixed((sums[s:] - sums[:-s]) * inverse[: n - s + 1])
    width = k - s + 1
    low = _sliding_min(inner, width)
    at = np.flatnonzero((inner[: len(low)] == low) | (inner[width - 1 :] == low))
    return mixed(mixed((sums[at + k] - sums[at]) * inverse[at])), at


def fingerprint(text: str, size: int = 64, k: int = 16, s: int = 6) -> np.ndarray:
    """The anchors of the smallest values, each value at its first place; texts without a syncmer are one anchor."""
    values, at = syncmers(text, k, s)
    if not len(values):
        whole = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")
        return np.array([(whole, 0)], _ANCHOR)
    values = (values >> np.uint64(32)).astype(np.uint32)
    if len(values) > 8 * size:  # the smallest for certain, in place of a full sort
        near = np.partition(values, 4 * size)[4 * size]
        some = np.flatnonzero(values <= near)
        if len(np.unique(values[some])) >= size:
            values, at = values[some], at[some]
    unique, first = np.unique(values, return_index=True)
    out = np.empty(min(size, len(unique)), _ANCHOR)
    out["value"], out["at"] = unique[:size], at[first[:size]]
    return out


def likeness(a: np.ndarray, b: np.ndarray, size: int = 64) -> float:
    """The part (0 to 1) that two texts have in common, by anchors that agree in value and in order of position.

    Of the ``size`` smallest values of both together, those in both that follow each other in both texts
    (the longest such chain, so that insertions and deletions lose only the anchors they touch), as a share J; the result is 2J / (1 + J), which for two texts of equal
    length is the share of each that is in the other.
    """
    values = np.union1d(a["value"], b["value"])[:size]
    both, ia, ib = np.intersect1d(a["value"], b["value"], return_indices=True)
    inside = both <= values[-1]
    if not inside.any():
        return 0.0
    order = np.argsort(a["at"][ia[inside]])
    chain: list[int] = []
    for at in b["at"][ib[inside]][order].tolist():
        i = bisect_left(chain, at)
        chain[i : i + 1] = [at]
    j = len(chain) / len(values)
    return 2 * j / (1 + j)


def text_form(anchors: np.ndarray) -> str:
    return base64.b64encode(anchors.tobytes()).decode()


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by the first code points of the next one, as many or all."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


class Ranges:
    """Parts of the order (descending doc_id, ascending hash of the text), found from quantiles of the ids.

    An id that holds several quantiles (all null ids, say) has as many parts of its own, which divide the hashes evenly.
    """

    def __init__(self, quantiles: list[int]) -> None:
        self.ids, self.own = np.unique(np.array(quantiles, np.int64), return_counts=True)
        self.own[self.own == 1] = 0
        # Parts of the ids up to and including each bound: those of the bound itself, then those below it.
        parts = np.append(self.own + 1, 1)
        self.before = np.concatenate((np.cumsum(parts[::-1])[::-1][1:], [0]))
        self.total = int(parts.sum())

    def part(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ids, ids, side="left")
        own = np.append(self.own, 0)[at]
        hit = (own > 0) & (np.append(self.ids, 0)[at] == ids)
        within = np.minimum((hashes / 2.0**64 + 0.5) * own, np.maximum(own - 1, 0)).astype(np.int64)
        return self.before[at] + np.where(hit, within, own)


def with_next(docs: DataFrame, ranges: int | None = None, part_bytes: int = 16 << 20) -> DataFrame:
    """(part, doc_id, text, guest): the documents dealt into ranges of (doc_id, hash of the text), so that in the order of
    descending doc_id every row's successor follows it in its part. A row with ``guest`` 1 is the first document of the next
    part, which stands at the end of each part as well; for the last part it is the first document of all.

    The number of ranges follows the bytes of the texts (``part_bytes`` each, 200,000 ranges at most), so that a task
    does not grow with the corpus. Bounds and first rows come from ids and hashes only, one of them for each range.
    """
    spark = docs.sparkSession
    rows = docs.select(id_key().alias("doc_id"), text_of().alias("text"))
    keys = settled(rows.select("doc_id", F.xxhash64("text").alias("hash"), F.octet_length("text").cast("long").alias("bytes")))
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = ranges or min(200_000, max(least, -(-(keys.agg(F.sum("bytes")).first()[0] or 0) // part_bytes)))
    found = keys.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("c")).first()["c"]
    bounds = Ranges(found or [])

    def part(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(bounds.part(ids.to_numpy(), hashes.to_numpy()))

    part_of = F.pandas_udf(part, "long")
    # The first row of each part: the largest id (its complement is least), and of that id's rows the least hash.
    firsts = settled(keys.select(part_of("doc_id", "hash").alias("part"), F.struct(F.bitwise_not("doc_id").alias("i"), F.col("hash").alias("h")).alias("k")).groupBy("part").agg(F.min("k").alias("k")))
    order = Window.orderBy("part")
    before = firsts.select(F.bitwise_not("k.i").alias("first_id"), F.col("k.h").alias("first_hash"), F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())).alias("to"))
    keyed = rows.withColumn("hash", F.xxhash64("text"))
    # Rows of equal id and hash are equal: any of them is the guest.
    head = keyed.join(F.broadcast(before), (F.col("doc_id") == F.col("first_id")) & (F.col("hash") == F.col("first_hash"))).groupBy("to").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("hash").alias("hash"))
    own = keyed.select(part_of("doc_id", "hash").alias("part"), "doc_id", "text", "hash", F.lit(0).alias("guest"))
    guests = head.select(F.col("to").alias("part"), "doc_id", "text", "hash", F.lit(1).alias("guest"))
    both = own.unionByName(guests)
    # Four neighbouring parts a task, by number: a hash of the part would heap some tasks up and leave others empty.
    return both.repartitionById(-(-bounds.total // 4), (F.col("part") / 4).cast("int")).sortWithinPartitions("part", "guest", F.col("doc_id").desc(), "hash")


def fingerprint_pairs(docs: DataFrame, size: int = 64, k: int = 16, s: int = 6) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Null texts count as empty. The next document is the one with the next smaller doc_id (null is the
    smallest), after the last the first; a single document is its own next. Rows of one id follow each
    other in the order of a hash of their text. Equal texts have equal fingerprints; texts shorter than
    ``k`` code points have one anchor of the whole text. An empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # (part, doc_id, text, print) whose successor is the next row
        for b in batches:
            out = []
            for part, doc_id, text, guest in zip(b["part"].tolist(), b["doc_id"].tolist(), b["text"].tolist(), b["guest"].tolist()):
                own = fingerprint(text, size, k, s)
                if last is not None and last[0] == part:
                    mixed = edited(last[2], text)
                    print_ = fingerprint(mixed, size, k, s)
                    digest = hashlib.sha256(mixed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((last[1], len(last[2]), digest, text_form(last[3]), text_form(print_), likeness(last[3], print_, size), likeness(last[3], own, size)))
                last = None if guest else (part, doc_id, text, own)
            yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInPandas(run, schema).withColumn("doc_id", id_back())

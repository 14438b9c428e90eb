"""Near copies by the exact Jaccard similarity of their word shingles.

Candidates share a band of ``rows`` minima of random permutations (MinHash) of
their shingle sets. A pair of similarity j has no common band with probability
(1 - j^rows)^bands: 3 in a million at 0.8 with the defaults, and less above.
Inside a bucket all pairs are held against each other by their shingle sets,
except those already joined over others. In a large bucket every document is
first held against the bucket's smallest one, which joins most of a group of near
copies in a linear number of comparisons; only documents that this leaves apart
are then held against all of the bucket, in chunks, and each pair of chunks is a
task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import id_back, id_key, member_test, mixed, settled, spread_join, text_of, without_ids
from presswork.llm.simhash import SEED, components, fingerprint_of, groups_of, shingle_hashes


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes, sorted; empty when the text has no word."""
    parts = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of the set's minima."""
    factors = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (factors[:, None] * mixed(hashes[at : at + 4096].copy())[None, :]).min(1))
    keys = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        keys = mixed(mixed(keys ^ column) + np.uint64(SEED))
    return keys


def linked_sets(sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> np.ndarray:
    """For each set the first that it is joined with by pairs of at least the similarity.

    ``side`` (true, false) restricts the pairs to those between both sides.
    """
    size = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)
    bounds = np.concatenate(([0], np.cumsum(size)))
    group = np.arange(len(sets))
    for i in range(len(sets)):
        if side is not None and not side[i]:
            continue
        apart = group != group[i]
        if side is not None:
            apart &= ~side
        if not apart.any():
            continue
        mark = np.zeros(codes.max() + 1, bool)
        mark[codes[bounds[i] : bounds[i + 1]]] = True
        common = np.bincount(owner[mark[codes]], minlength=len(sets))
        for g in np.unique(group[apart & (common >= similarity * (size + size[i] - common))]):
            group[group == max(g, group[i])] = min(g, group[i])
    return group


def _alike(x: bytes, y: bytes, similarity: float) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common)


def signatures(docs: DataFrame, width: int = 5, bands: int = 24, rows: int = 4) -> DataFrame:
    """(doc_id, fp, bands) of every row: the SimHash fingerprint and the bands' keys, from one pass over the words. Texts without a word have no bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp, keys = np.zeros(len(b), np.uint64), []
            for n, text in enumerate(b["text"].tolist()):
                parts = list(shingle_hashes(text, width))
                fp[n] = fingerprint_of(parts)
                keys.append(band_keys(np.unique(np.concatenate(parts)), bands, rows).view(np.int64) if parts else [])
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64), "bands": keys})

    found = docs.select(id_key().alias("doc_id"), text_of().alias("text")).mapInPandas(run, "doc_id long, fp long, bands array<long>")
    return found.withColumn("doc_id", id_back())


def links(docs: DataFrame, banded: DataFrame, similarity: float = 0.8, width: int = 5, chunk_rows: int = 512) -> DataFrame:
    """Edges (a, b) of doc_ids that join all of ``banded`` (doc_id, bands) that share a band and have at least the similarity.

    ids are distinct and not null; ``docs`` (doc_id, text) has their texts. Only documents that share a band with another one
    are read again for their shingle sets.
    """

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "hashes": [shingle_set(t, width).tobytes() for t in b["text"].tolist()]})

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc_id"].to_numpy()
        to = ids[linked_sets([np.frombuffer(x, np.uint64) for x in pdf["hashes"]], None, similarity)]
        moved = ids != to
        return pd.DataFrame({"a": ids[moved], "b": to[moved]})

    def compare_sides(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc_id"].to_numpy()
        to = ids[linked_sets([np.frombuffer(x, np.uint64) for x in pdf["hashes"]], pdf["own"].to_numpy() == 0, similarity)]
        moved = ids != to
        return pd.DataFrame({"a": ids[moved], "b": to[moved]})

    buckets = banded.select("doc_id", F.explode("bands").alias("bucket"))
    found = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("who")).filter("n > 1")
    # Buckets with the same documents are compared once.
    once = found.groupBy("n", "who").agg(F.min("bucket").alias("bucket")).select("bucket", "n", F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks"))
    members = settled(spread_join(buckets, settled(once), "bucket"))
    wanted = member_test(members)
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter(wanted(F.col("doc_id"))).mapInPandas(sets_of, "doc_id long, hashes binary")
    small = members.filter("chunks = 1").select("bucket", "doc_id", F.lit(0).alias("own"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    edges = small.join(sets, "doc_id").groupBy("bucket", "lo", "hi").applyInPandas(compare, "a long, b long")
    large = members.filter("chunks > 1")
    if not large.limit(1).count():
        return edges
    held = settled(large.join(sets, "doc_id"))
    centres = held.groupBy("bucket").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    middle = settled(held.join(centres, ["bucket", "doc_id"]).select("bucket", F.col("doc_id").alias("centre"), "n", F.col("hashes").alias("core")))

    def against_centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"bucket": b["bucket"], "doc_id": b["doc_id"], "centre": b["centre"], "alike": [_alike(x, y, similarity) for x, y in zip(b["hashes"], b["core"])]})

    star = spread_join(held.select("bucket", "doc_id", "hashes"), middle, "bucket").select("bucket", "doc_id", "hashes", "centre", "core")
    told = settled(star.mapInPandas(against_centre, "bucket long, doc_id long, centre long, alike boolean"))
    edges = edges.unionByName(told.filter("alike and doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")))
    # Documents apart from their centre meet all others of the bucket: theirs are the "lo" chunks, those of all the "hi" chunks.
    apart = told.filter("not alike").select("bucket", "doc_id")
    if not apart.limit(1).count():
        return edges
    sizes = large.groupBy("bucket").agg(F.first("chunks").alias("chunks"), F.count("*").alias("n"))
    parts = settled(apart.groupBy("bucket").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("parts")).join(sizes, "bucket"))
    cut = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = spread_join(apart, parts, "bucket").select("bucket", "doc_id", F.lit(0).alias("own"), cut(F.col("parts")).alias("lo"), over(F.col("chunks")).alias("hi"))
    right = spread_join(large.select("bucket", "doc_id"), parts, "bucket").select("bucket", "doc_id", F.lit(1).alias("own"), over(F.col("parts")).alias("lo"), cut(F.col("chunks")).alias("hi"))
    pairs = left.unionByName(right).join(held.select("bucket", "doc_id", "hashes"), ["bucket", "doc_id"])
    return edges.unionByName(pairs.groupBy("bucket", "lo", "hi").applyInPandas(compare_sides, "a long, b long"))


def keep_unlike(docs: DataFrame, similarity: float = 0.8, width: int = 5, bands: int = 24, rows: int = 4, chunk_rows: int = 512) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id. Rows without an id stay; ids must be distinct."""
    banded = settled(signatures(docs.filter("doc_id is not null"), width, bands, rows).select("doc_id", "bands"))
    grouped = components(links(docs.filter("doc_id is not null"), banded, similarity, width, chunk_rows))
    return without_ids(docs, grouped.filter("node <> root").select(F.col("node").alias("doc_id")))


def one_row_an_id(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each id; rows without an id stay. Where no id is repeated, that is ``docs`` itself."""
    with_id = docs.filter("doc_id is not null")
    if not with_id.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return docs
    return settled(with_id.dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id is null")))


def keep_one_of_each(docs: DataFrame, similarity: float = 0.8, width: int = 5, bands: int = 24, rows: int = 4, radius: int = 4, chunk_rows: int = 512) -> DataFrame:
    """``docs`` with one document of each group: SimHash groups first, then, of their representatives, one of each group of
    at least the Jaccard similarity, always the smallest id. Rows without an id stay; of a repeated id one row does.

    Texts are read for the signatures, for the shingle sets of candidates, and for the result, and shuffled for what may go only.
    """
    docs = one_row_an_id(docs)
    marks = settled(signatures(docs, width, bands, rows))
    groups = settled(groups_of(marks.select("doc_id", "fp"), radius).filter("doc_id is not null").select("doc_id", "component_id"))
    first = marks.join(groups.filter("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select("doc_id", "bands")
    near = components(links(docs.filter("doc_id is not null"), settled(first), similarity, width, chunk_rows))
    gone = groups.filter("doc_id <> component_id").select("doc_id").unionByName(near.filter("node <> root").select(F.col("node").alias("doc_id")))
    return without_ids(docs, gone)

"""Near-duplicate groups by SimHash and tiled exact comparison.

A 64-bit fingerprint summarises a text's word shingles. Distinct fingerprints
are dealt into tiles; in a tile numpy xors blocks of fingerprints against each
other and counts bits, and leaves out pairs of blocks whose population counts
lie further apart than the radius.

Which tiles are compared. Two fingerprints that differ in at most r bits agree
on at least ``blocks - r`` of their ``blocks`` bit blocks, so each fingerprint
enters one tile per choice of ``blocks - r`` blocks, named by a prefix of those
blocks' bits. No link is lost. The prefix is as long as keeps a tile at
``tile_rows`` on average; tiles that are larger nevertheless (large groups of
near copies) are cut into chunks, and each pair of chunks is a task of its own.
A tile returns at most one edge per fingerprint (to the tile's representative),
never its pairs, and the edges are contracted by star steps to components.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import SPACE_CHARS, id_back, id_key, settled, spread_join, text_of, without_ids

SEED = 42
_LOWER = {c: c + 32 for c in range(65, 91)}
_SPLIT = {ord(c): " " for c in SPACE_CHARS}
_FLUSH = 1 << 16


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """64-bit hashes of the text's shingles of ``width`` words, in order, repeats included; a shorter text is one shingle."""
    words = (text or "").translate(_LOWER | _SPLIT).split(" ")
    words = [w.encode("utf-8", "surrogatepass") for w in words if w]
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = max(1, len(words) - width + 1)
    tops = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, spans, _FLUSH):
        pairs = zip(starts[at : min(spans, at + _FLUSH)].tolist(), tops[at : at + _FLUSH].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")


def text_fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the text's word shingles, repeats included; 0 when it has no word."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(parts: Iterable[np.ndarray]) -> int:
    """The fingerprint of shingles whose hashes come in parts."""
    votes, seen = np.zeros(64, np.int64), 0
    for hashes in parts:
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        seen += len(hashes)
    bits = np.packbits(votes * 2 > seen, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp long) of every document; ``fp`` holds the 64 bits as a signed number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([text_fingerprint(t, width) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    rows = docs.select(id_key().alias("doc_id"), text_of().alias("text")).mapInPandas(run, "doc_id long, fp long")
    return rows.select(id_back().alias("doc_id"), "fp")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return int(i)


def tile_groups(left: np.ndarray, right: np.ndarray | None, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The values of a tile (pair) and for each the smallest value that it is linked with inside the tile.

    ``right`` None: all pairs inside ``left``; else the pairs between the two.
    Blocks are runs in the order of population counts, so a pair of blocks is
    compared only if their counts come within the radius of each other.
    """
    parts = []
    for side in (left,) if right is None else (left, right):
        side = side.astype(np.uint64)
        parts.append(side[np.argsort(np.bitwise_count(side), kind="stable")])
    values = np.concatenate(parts)
    ones = np.bitwise_count(values).astype(np.int16)
    parent = np.arange(len(values))
    group = parent.copy()
    n_left = len(parts[0])
    rows = range(0, n_left, block)
    columns = range(0, n_left, block) if right is None else range(n_left, len(values), block)
    for i in rows:
        i2 = min(i + block, n_left)
        for j in columns:
            j2 = min(j + block, n_left if right is None else len(values))
            if right is None and j < i or ones[j] - ones[i2 - 1] > radius or ones[i] - ones[j2 - 1] > radius:
                continue
            near = np.bitwise_count(values[i:i2, None] ^ values[None, j:j2]) <= radius
            while True:
                apart = near & (group[i:i2, None] != group[None, j:j2])
                hit = np.flatnonzero(apart.any(1))
                if not len(hit):
                    break
                for a, b in zip((hit + i).tolist(), (apart[hit].argmax(1) + j).tolist()):
                    x, y = _root(parent, a), _root(parent, b)
                    parent[max(x, y)] = min(x, y)
                while not np.array_equal(parent, parent[parent]):
                    parent = parent[parent]
                group = parent.copy()
    least = np.full(len(values), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, group, values)
    return values, least[group]


def _tile_keys(fp: Column, blocks: int, radius: int, bits: int) -> Column:
    """An array with the key of every tile that a fingerprint enters: the choice and a prefix of the chosen blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        left, key = bits, F.lit(0).cast("long")
        for k in chosen:
            width = edges[k + 1] - edges[k]
            take = min(left, width)
            part = F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << take) - 1).cast("long"))
            key = F.shiftleft(key, take).bitwiseOR(part)
            left -= take
        keys.append(F.struct(F.lit(n).alias("choice"), key.alias("prefix")))
    return F.array(*keys)


def block_count(total: int, radius: int, tile_rows: int) -> int:
    """The fewest blocks whose keys are long enough to keep tiles of ``total`` fingerprints at ``tile_rows``.

    For radius 4 and 2048 rows: 5 blocks up to 8 million fingerprints, 6 up to 2 billion, 7 up to 275 billion.
    """
    blocks = radius + 1
    while blocks < 2 * radius + 2 and tile_rows << (64 // blocks) * (blocks - radius) < total:
        blocks += 1
    return blocks


def linked_pairs(distinct: DataFrame, radius: int = 4, blocks: int | None = None, tile_rows: int = 2048, chunk_rows: int = 8192) -> DataFrame:
    """Edges (a, b) that join every two of the distinct fingerprints ``fp`` within the radius, directly or over others.

    ``blocks`` above radius + 1 means longer keys, and so smaller tiles for very many fingerprints, but more of them
    for each; by default it follows the number of fingerprints. Any number loses nothing.
    """
    total = distinct.count()
    blocks = blocks or block_count(total, radius, tile_rows)
    narrow = (64 // blocks) * (blocks - radius)
    bits = min(narrow, max(0, int(math.log2(max(1, total / tile_rows)))))
    tiles = distinct.select("fp", F.explode(_tile_keys(F.col("fp"), blocks, radius, bits)).alias("tile")).select(
        "fp", "tile.choice", "tile.prefix"
    )
    # How many chunks each tile needs; tiles of one chunk are not in this table, the others are at least chunk_rows large.
    large = tiles.groupBy("choice", "prefix").count().filter(F.col("count") > chunk_rows).select("choice", "prefix", F.ceil(F.col("count") / chunk_rows).cast("int").alias("chunks"))
    placed = tiles.join(large, ["choice", "prefix"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = placed.withColumn("own", own).select(
        "fp", "choice", "prefix", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    )
    pairs = pairs.select("fp", "choice", "prefix", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        if key[2] == key[3]:
            values, to = tile_groups(fp, None, radius)
        else:
            left = pdf["own"].to_numpy() == key[2]
            values, to = tile_groups(fp[left], fp[~left], radius)
        moved = values != to
        return pd.DataFrame({"a": values[moved].view(np.int64), "b": to[moved].view(np.int64)})

    return pairs.groupBy("choice", "prefix", "lo", "hi").applyInPandas(compare, "a long, b long")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge, by alternating large and small stars."""
    edges = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    for _ in range(rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: a node's greater neighbours move to the smallest node around it.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.explode(F.array("a", "b")).alias("a")
        edges = settled(large.join(least, "a").select(ends, F.col("m").alias("b")).filter("a <> b").distinct())
        before, mark = mark, edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, blocks: int | None = None, tile_rows: int = 2048, chunk_rows: int = 8192) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest doc_id of the group. Null texts count as empty;
    texts without a word have fingerprint zero and link like any other. Rows
    with a null doc_id are returned; their component is the smallest id of the
    group, or null if no row of it has one. Repeated rows are returned as often
    as they occur; an empty table gives an empty result; other columns are ignored.
    """
    return groups_of(settled(fingerprints(docs, width)), radius, blocks, tile_rows, chunk_rows)


def groups_of(prints: DataFrame, radius: int = 4, blocks: int | None = None, tile_rows: int = 2048, chunk_rows: int = 8192) -> DataFrame:
    """``near_duplicates`` from fingerprints (doc_id, fp) that are there already; they are read twice, and so better settled."""
    by_fp = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    roots = components(linked_pairs(by_fp.select("fp"), radius, blocks, tile_rows, chunk_rows))
    # Members of a component but for its root. A component may hold a third of all fingerprints, and a fingerprint a third of
    # all documents: both joins back are dealt over salts.
    members = settled(by_fp.select(F.col("fp").alias("node"), "least_id").join(roots, "node"))
    top = by_fp.select(F.col("fp").alias("root"), "least_id").join(roots.select("root").distinct(), "root")
    least = settled(members.select("root", "least_id", F.lit(1).alias("one")).unionByName(top.withColumn("one", F.lit(0))).groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("one").alias("n")))
    linked = spread_join(members.select("node", "root"), least, "root").select(F.col("node").alias("fp"), "component_id")
    linked = linked.unionByName(least.select(F.col("root").alias("fp"), "component_id")).withColumn("linked", F.lit(True))
    label = settled(by_fp.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id"), "n"))
    return spread_join(prints, label, "fp").select("doc_id", "fp", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id; the columns stay as they are.

    Rows without an id stay. If an id occurs in several rows, one row of them stays.
    """
    groups = near_duplicates(docs, **parameters)
    per_id = settled(groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("least")).filter("doc_id is not null and (n > 1 or least <> doc_id)"))
    kept = without_ids(docs, per_id.filter("least <> doc_id"))
    if per_id.filter("n > 1 and least = doc_id").limit(1).count():
        kept = kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))
    return kept.select(*docs.columns)

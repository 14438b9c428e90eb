"""Packing documents into sequences of bounded length by vector best-fit.

A document's tokens (with an end id) are cut into pieces only where they exceed
the sequence length. Pieces are packed, largest first, into the open sequence
that leaves the least weighted norm of what is left in three capacities: tokens,
documents and attention cost (sum of squared lengths); "dot" takes the greatest
weighted product of a piece and the capacities left instead.

Packing runs per shard of pieces. Only sequences that are nearly full are
closed; the pieces of the others meet in fewer shards in the next round, until
one shard of bounded size is left, or until shards of the greatest size no
longer close half of the pieces: then all their sequences are final as they are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import byte_slices, id_back, id_key, settled, text_of
from presswork.llm.tokens import encoder


def token_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, length: int = 2048, with_ids: bool = False) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32[, ids]) of each document's ids and ``end_id``.

    Pieces of a longer document have ``length`` ids each; its first may be shorter. ``row`` tells rows of one id apart.
    """
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(tokenizer).ids_of, np.array([end_id], "<u4")
        for b in batches:
            # A batch may have thousands of long texts; only a slice of them is in Python's own strings at a time.
            for first, last in byte_slices(pc.binary_length(b.column("text")).to_pylist(), 2_000_000):
                part, rows = b.slice(first, last - first), []
                for doc_id, row, ids in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row")), ids_of(part.column("text").to_pylist())):
                    ids = np.concatenate((ids, end))
                    head = len(ids) % length or length
                    bounds = [0, *range(min(head, len(ids)), len(ids) + 1, length)]
                    for n, (x, y) in enumerate(zip(bounds, bounds[1:])):
                        cut = ids[x:y]
                        rows.append((doc_id, row, n, x, y - x, zlib.crc32(cut.tobytes()), *([cut.astype(np.int32)] if with_ids else [])))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), fields.types)]
                yield pa.RecordBatch.from_arrays(columns, schema=fields)

    fields = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)
    keyed = docs.select(id_key().alias("doc_id"), F.xxhash64(text_of(), F.monotonically_increasing_id()).alias("row"), text_of().alias("text"))
    return keyed.mapInArrow(run, schema)


#: How much tokens, documents and attention cost count in choosing a sequence. Where only tokens bind, as with the default
#: capacities, the other two only break ties; with a binding number of documents or cost, like weights save sequences.
WEIGHTS = (1.0, 1e-4, 1e-3)


def best_fit(sizes: np.ndarray, capacity: int, max_docs: int, max_cost: float, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """The bin of each size; ``sizes`` must come largest first.

    A piece that alone exceeds the cost gets a bin of its own. Bins that can't take the smallest piece any more are closed.
    """
    out = np.empty(len(sizes), np.int64)
    room = max(16, len(sizes))
    tokens, docs, cost, name = (np.empty(room) for _ in range(4))
    n = made = 0
    smallest = int(sizes[-1]) if len(sizes) else 0
    wt, wd, wc = weights[0] / capacity**2, weights[1] / max_docs**2, weights[2] / max_cost**2
    for k, size in enumerate(sizes.tolist()):
        square = float(size) * size
        fits = np.flatnonzero((tokens[:n] >= size) & (docs[:n] >= 1) & (cost[:n] >= square))
        if len(fits):
            t, d, c = tokens[fits] - size, docs[fits] - 1, cost[fits] - square
            if rule == "norm":
                at = int(fits[np.argmin(wt * t * t + wd * d * d + wc * c * c)])
            else:
                at = int(fits[np.argmin(-(wt * size * tokens[fits] + wd * docs[fits] + wc * square * cost[fits]))])
            out[k] = name[at]
            tokens[at] -= size
            docs[at] -= 1
            cost[at] -= square
            if tokens[at] < smallest or docs[at] < 1:
                n -= 1
                for a in (tokens, docs, cost, name):
                    a[at] = a[n]
            continue
        out[k] = made
        if capacity - size >= smallest and max_docs > 1:
            tokens[n], docs[n], cost[n], name[n] = capacity - size, max_docs - 1, max_cost - square, made
            n += 1
        made += 1
    return out


_PACKED = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def _placer(capacity: int, max_docs: int, cost: float, rule: str, weights: tuple[float, float, float], full: float, last: bool, level: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Packs one shard; ``closed`` tells whether a piece's sequence is final."""

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], ignore_index=True)
        size = pdf["length"].to_numpy()
        bins = best_fit(size, capacity, max_docs, cost, rule, weights)
        pdf["closed"] = last | (np.bincount(bins, weights=size)[bins] >= full * capacity)
        order = np.argsort(bins, kind="stable")
        begin = np.cumsum(size[order]) - size[order]
        first = np.concatenate(([True], np.diff(bins[order]) != 0))
        offset = np.empty(len(pdf), np.int64)
        offset[order] = begin - np.maximum.accumulate(np.where(first, begin, 0))
        pdf["offset"] = offset
        pdf["sequence_id"] = (level << 56) | (int(key[0]) << 24) | bins
        return pdf[[*_PACKED, "closed"]]

    return place


def pack(pieces: DataFrame, capacity: int = 2048, max_docs: int | None = None, max_cost: float | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS, shard_pieces: int = 8192, full: float = 0.995) -> DataFrame:
    """``pieces`` with sequence_id and offset: no sequence exceeds ``capacity`` tokens, ``max_docs`` pieces or ``max_cost``.

    ``max_docs`` defaults to the capacity and ``max_cost``, the bound of the sum of squared piece lengths, to its
    square; both are implied by the tokens. Shards have ``shard_pieces`` pieces on average, at most four times as many
    where pieces fit badly.
    A piece has 1 to ``capacity`` tokens. Offsets run gapless from 0 in each sequence.
    """
    max_docs = capacity if max_docs is None else max_docs
    largest = 4 * shard_pieces
    cost = float(capacity) ** 2 if max_cost is None else float(max_cost)
    columns = _PACKED
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, closed boolean"
    settled_pieces = settled(pieces.select(*columns[:6]))
    left, done, level = settled_pieces, [], 0
    n_left = left.count()
    while True:
        shards = max(1, math.ceil(n_left / shard_pieces))
        last = shards == 1

        placed = left.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "row", F.lit(level)), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_placer(capacity, max_docs, cost, rule, weights, full, last, level), schema)
        if last:
            done.append(placed.select(*columns))
            break
        placed = settled(placed)
        done.append(placed.filter("closed").select(*columns))
        left = placed.filter("not closed").select(*columns[:6])
        before, n_left, level = n_left, left.count(), level + 1
        if n_left > 0.5 * before:  # few sequences come near full at this shard size: fewer, larger shards
            if shard_pieces >= largest and n_left > shard_pieces:
                done.append(placed.filter("not closed").select(*columns))
                break
            shard_pieces = min(largest, 2 * shard_pieces)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = 2048, **parameters) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's tokens in sequences.

    Null and empty texts are the end id alone. Rows with one doc_id are packed each for itself; a null id
    stays null. Equal sizes are placed in the order of ids. An empty table gives an empty result.
    """
    packed = pack(token_pieces(docs, tokenizer, end_id, capacity), capacity, **parameters)
    return packed.select(id_back().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

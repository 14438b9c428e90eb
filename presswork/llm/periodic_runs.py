"""Periodic runs of words by internal pattern matching.

Texts are word sequences, many of which lie end to end in one array in which
every text has words of its own. The suffix array comes from prefix doubling,
whose round of length b also tells, for each block of b words that starts at a
multiple of b, the interval of suffixes that begin with it. A wavelet matrix
over the suffix array gives the nearest occurrence of the block after and
before it (range successor). A run of period q that lasts four periods holds
an aligned block with q < b <= 2q, and on one side of it q more words; as the
block is longer than a period, its nearest occurrence there is exactly q away.
Occurrences that follow each other at the same distance make a progression,
whose ends are then extended word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import byte_slices, text_of

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class RangeSuccessor:
    """A wavelet matrix over an array of different numbers from 0 on: what is nearest to a number within a range of places."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values)).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            packed = np.zeros(len(values) // 64 + 1, np.uint64)
            packed.view(np.uint8)[: -(-len(values) // 8)] = np.packbits(ones, bitorder="little")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            zeros = len(values) - int(before[-1])
            self.levels.append((bit, packed, before, zeros))
            values = np.concatenate((values[~ones], values[ones]))

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many numbers below ``x`` stand at places ``left`` to ``right`` (without)."""
        count = np.zeros(len(left), np.int64)
        for bit, packed, before, zeros in self.levels:
            left1, right1 = self._ones(packed, before, left), self._ones(packed, before, right)
            up = (x >> bit) & 1 == 1
            count += np.where(up, (right - right1) - (left - left1), 0)
            left, right = np.where(up, zeros + left1, left - left1), np.where(up, zeros + right1, right - right1)
        return count

    def kth(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number with ``k`` smaller ones among those at places ``left`` to ``right``."""
        value = np.zeros(len(left), np.int64)
        for bit, packed, before, zeros in self.levels:
            left1, right1 = self._ones(packed, before, left), self._ones(packed, before, right)
            low = (right - right1) - (left - left1)
            up = k >= low
            value += up.astype(np.int64) << bit
            k = np.where(up, k - low, k)
            left, right = np.where(up, zeros + left1, left - left1), np.where(up, zeros + right1, right - right1)
        return value

    def nearest(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(predecessor, successor) of ``x``, which is itself one of the numbers; -1 where there is none."""
        own, size = self.below(left, right, x), right - left
        before, after = np.full(len(x), -1), np.full(len(x), -1)
        for out, has, k in ((before, own > 0, own - 1), (after, own + 1 < size, own + 1)):
            out[has] = self.kth(left[has], right[has], k[has])
        return before, after


def suffix_blocks(words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """(suffix array, [(b, starts, left, right)]): for each power b from 2 on, the aligned blocks of b words that occur
    more than once, and the interval of the suffixes which begin with them."""
    n = len(words)
    suffixes = np.argsort(words, kind="stable")
    rank, size = np.empty(n, np.int64), np.zeros(n, np.int64)
    blocks, active, key = [], np.arange(n), words[suffixes]
    b = 1
    while len(active):
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        counts = np.diff(np.append(first, len(active)))
        rank[suffixes[active]] = np.repeat(active[first], counts)
        size[active[first]] = counts
        active = active[np.repeat(counts, counts) > 1]
        if b > 1:
            starts = np.arange(0, n - b + 1, b)
            left = rank[starts]
            many = size[left] > 1
            if many.any():
                blocks.append((b, starts[many], left[many], left[many] + size[left[many]]))
        at = suffixes[active]
        after = at + b
        key = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key)
        suffixes[active], key = at[order], key[order]
        b *= 2
    return suffixes, blocks


def _ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places of the pieces, place within its piece of every item) of pieces of these sizes in a row."""
    first = np.cumsum(sizes) - sizes
    return first, np.arange(int(sizes.sum())) - np.repeat(first, sizes)


def _extended(words: np.ndarray, at: np.ndarray, period: np.ndarray, width: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on, in the direction of ``step``, equal the word a period back from there."""
    grown, active = np.zeros(len(at), np.int64), np.arange(len(at))
    n = len(words)
    while len(active):
        here = at[active] + step * grown[active]
        left = np.where(step > 0, n - here, here + 1)
        sizes = np.minimum(width[active], np.maximum(left, 0))
        active, here, sizes = active[sizes > 0], here[sizes > 0], sizes[sizes > 0]
        if not len(active):
            break
        first, inside = _ragged(sizes)
        place = np.repeat(here, sizes) + step * inside
        same = words[place] == words[place - step * np.repeat(period[active], sizes)]
        equal = np.minimum.reduceat(np.where(same, np.repeat(sizes, sizes), inside), first)
        grown[active] += equal
        active = active[equal == sizes]
    return grown


def find_runs(words: np.ndarray, min_length: int = 6, min_periods: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least ``min_length`` words and ``min_periods`` (4 at least) periods, by start, then period."""
    if min_periods < 4:
        raise ValueError("blocks of this method find runs of four periods and more")
    if len(words) < min_length:
        return (np.empty(0, np.int64),) * 3
    suffixes, blocks = suffix_blocks(words)
    found = RangeSuccessor(suffixes) if blocks else None
    starts, periods, widths = [], [], []
    for b, at, left, right in blocks:
        for other in found.nearest(left, right, at):
            d = np.abs(other - at)
            hit = (other >= 0) & (d >= b // 2) & (d < b)
            starts.append(np.minimum(at, other)[hit])
            periods.append(d[hit])
            widths.append(np.full(int(hit.sum()), b))
    if not starts:
        return (np.empty(0, np.int64),) * 3
    start, period, b = np.concatenate(starts), np.concatenate(periods), np.concatenate(widths)
    order = np.lexsort((start, period))
    start, period, b = start[order], period[order], b[order]
    if not len(start):
        return start, start, period
    # Each covers its block and a period; two that share a period's words or more belong to one progression.
    new = np.concatenate(([True], (period[1:] != period[:-1]) | (start[1:] - start[:-1] > b[1:])))
    last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
    end = start[last] + period[last] + b[last]
    start, period, b = start[new], period[new], b[new]
    begin = start - _extended(words, start - 1, period, 2 * b, -1)
    length = end + _extended(words, end, period, 2 * b, 1) - begin
    long = length >= np.maximum(min_length, min_periods * period)
    runs = np.unique(np.stack((begin[long], period[long], length[long]), axis=1), axis=0)
    return runs[:, 0], runs[:, 2], runs[:, 1]


def _block(ids: pa.Array, texts: pa.Array, schema: pa.Schema, min_length: int, min_periods: int) -> pa.RecordBatch:
    """Runs, best run and collapsed text of some rows, whose words lie end to end in one array."""
    parted = pc.ascii_split_whitespace(texts)  # at the six ASCII spaces and at nothing else; spaces at the ends leave empty strings
    flat = parted.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    bounds = before[parted.offsets.to_numpy() - parted.offsets[0].as_py()]
    words, sizes = flat.filter(real), np.diff(bounds)
    own = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    own += np.repeat(np.arange(len(sizes)), sizes) * (int(own.max(initial=0)) + 1)
    start, length, period = find_runs(own, min_length, min_periods)
    edges = np.zeros(len(own) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    stays = np.cumsum(edges)[:-1] == 0
    kept = np.concatenate(([0], np.cumsum(stays)))[bounds]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(kept.astype(np.int32), words.filter(pa.array(stays))), " ")
    cut = np.searchsorted(start, bounds)
    start -= np.repeat(bounds[:-1], np.diff(cut))
    runs = pa.ListArray.from_arrays(cut.astype(np.int32), pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], fields=list(RUNS.value_type)))
    best = []
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
        of = zip(start[x:y].tolist(), length[x:y].tolist(), period[x:y].tolist())
        top = max(of, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        best.append(top and dict(zip(("start", "length", "period"), top)))
    return pa.RecordBatch.from_arrays([ids, pa.array(sizes), runs, pa.array(best, RUNS.value_type), collapsed], schema=schema)


def collapse_runs(docs: DataFrame, min_length: int = 6, min_periods: int = 4, bytes_at_once: int = 1 << 20) -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) of every row of ``docs``.

    A run is a stretch of words with smallest period q, of at least ``min_length`` words and ``min_periods`` periods, that no
    neighbouring word extends. ``runs`` is an array of (start, length, period) by start, then period; ``best`` the one of the
    greatest length a period (then least start, then period), null without runs; ``collapsed`` the words, joined by one space,
    that stand in no run beyond its first period.

    Null and empty texts have no words: no runs and an empty ``collapsed``. Rows count each for themselves, repeated ids and
    null ids too; an empty table gives an empty result; other columns are left out. Nothing is shuffled: texts are searched
    some ``bytes_at_once`` together, a longer one whole by itself (some 150 bytes a word).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUNS), ("best", RUNS.value_type), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for x, y in byte_slices(pc.binary_length(texts).to_pylist(), bytes_at_once):
                yield _block(ids.slice(x, y - x), texts.slice(x, y - x), schema, min_length, min_periods)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, best struct<start long, length long, period long>, collapsed string"
    )

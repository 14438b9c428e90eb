"""Product quantisation of integer vectors with exact distances.

Vectors are scaled to integers and cut into parts; each part position has a
codebook that rounds of assignment and of floored means improve. A distance is
|x|^2 - 2xc + |c|^2, whose dot products come from BLAS in float64: integers are
split into limbs so short that no sum of products reaches 2^53, and the limbs'
products are put together again in int64. So nothing is rounded, and ties go to
the first entry on every machine. Only codebooks, whose size doesn't depend on
the number of vectors, pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import settled, spread_join

#: Vectors that are compared with a codebook at once.
_ROWS = 4096
#: Stands for a null id where the smallest ids are sought: nulls come last.
_LAST = np.iinfo(np.int64).max


def limbs(x: np.ndarray, width: int) -> list[np.ndarray]:
    """Integers as float64 digits to the base 2^width, the lowest first; only the last has a sign."""
    out = []
    while len(x) and np.abs(x).max(initial=0) >= 1 << width:
        out.append((x & ((1 << width) - 1)).astype(np.float64))
        x = x >> width
    return [*out, x.astype(np.float64)]


def exact_dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of int64 matrices by float64 products without rounding; the results must fit in int64."""
    width = (53 - max(1, x.shape[1]).bit_length()) // 2
    total = np.zeros((len(x), len(y)), np.int64)
    right = limbs(y, width)
    for i, a in enumerate(limbs(x, width)):
        for j, b in enumerate(right):
            total += (a @ b.T).astype(np.int64) << (width * (i + j))
    return total


def nearest(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the lowest of equals; squared distance) of each part."""
    far = (codebook * codebook).sum(axis=1) - 2 * exact_dot(parts, codebook)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(parts)), best] + (parts * parts).sum(axis=1)


def scaled(vectors: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows that are kept, their floor(scale * x)): not those that are null or hold a null or non-finite component."""
    bounds = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))[bounds]
    keep = np.flatnonzero((np.diff(bad) == 0) & vectors.is_valid().to_numpy(zero_copy_only=False))
    x = np.floor(np.where(np.isfinite(flat), flat, 0) * scale)
    return keep, [x[a:b] for a, b in zip(bounds[keep].tolist(), bounds[keep + 1].tolist())]


def _by_part(rows: list[np.ndarray], dims: int, parts: int) -> np.ndarray:
    """Rows as integers by part: rows x parts x width. The last components of the last part may be zeros that are put there."""
    width = -(-dims // parts)
    whole = np.zeros((len(rows), parts * width))
    whole[:, :dims] = np.array(rows).reshape(len(rows), dims)
    # Squared distances of all parts must fit in a long.
    if np.abs(whole).max(initial=0) >= 2.0 ** ((61 - max(1, dims).bit_length()) // 2):
        raise ValueError("components too large: errors would not fit in a long")
    return whole.astype(np.int64).reshape(len(rows), parts, width)


def _matrix(vectors: pa.Array, scale: int, dims: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``dims`` components that are kept, their integers by part)."""
    keep, rows = scaled(vectors, scale)
    fits = np.array([len(r) == dims for r in rows], bool)
    return keep[fits], _by_part([r for r in rows if len(r) == dims], dims, parts)


def _first_vectors(rows: DataFrame, scale: int, entries: int) -> list[np.ndarray]:
    """The integers of the ``entries`` kept rows of least (id, integers); each task and each of some joining tasks hands on so many at most."""

    def least(ids: list, vectors: list) -> tuple[list, list]:
        order = sorted(range(len(ids)), key=lambda i: (ids[i], vectors[i]))[:entries]
        return [ids[i] for i in order], [vectors[i] for i in order]

    def batch(ids: list, vectors: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "vector"])

    def top(batches: Iterator[pa.RecordBatch], read) -> Iterator[pa.RecordBatch]:
        ids: list = []
        vectors: list = []
        for b in batches:
            new, own = read(b)
            # Only ids up to the greatest of those gathered can be among the least.
            near = np.flatnonzero(new <= ids[-1]) if len(ids) == entries else np.arange(len(new))
            if len(near) > entries:
                near = near[new[near] <= np.partition(new[near], entries - 1)[entries - 1]]
            if len(near):
                ids, vectors = least([*ids, *new[near].tolist()], [*vectors, *(own[i].tolist() for i in near.tolist())])
        yield batch(ids, vectors)

    def of_rows(b: pa.RecordBatch) -> tuple[np.ndarray, list]:
        keep, x = scaled(b.column("vector"), scale)
        return b.column("id").to_numpy()[keep], x

    def of_firsts(b: pa.RecordBatch) -> tuple[np.ndarray, list]:
        return b.column("id").to_numpy(), [np.array(v) for v in b.column("vector").to_pylist()]

    schema = "id long, vector array<double>"
    firsts = rows.select(F.coalesce("id", F.lit(_LAST)).alias("id"), "vector").mapInArrow(lambda b: top(b, of_rows), schema)
    joined = firsts.repartition(ceil(sqrt(rows.rdd.getNumPartitions()) or 1)).mapInArrow(lambda b: top(b, of_firsts), schema)
    return [np.array(r["vector"]) for r in joined.orderBy("id", "vector").limit(entries).collect()]


def _rounds(rows: DataFrame, books: np.ndarray, scale: int, dims: int, rounds: int) -> np.ndarray:
    """The codebooks after so many rounds of assignment and floored means."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            x = _matrix(b.column("vector"), scale, dims, parts)[1]
            for at in range(0, len(x), _ROWS):
                for p in range(parts):
                    own = x[at : at + _ROWS, p]
                    code = nearest(own, sent.value[p])[0]
                    order = np.argsort(code, kind="stable")
                    used, first = np.unique(code[order], return_index=True)
                    count[p] += np.bincount(code, minlength=entries)
                    total[p, used] += np.add.reduceat(own[order], first, axis=0)
        p, e = np.nonzero(count)
        columns = [pa.array(c) for c in (p, e, count[p, e], *total[p, e].T)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["part", "entry", "n", *(f"s{i}" for i in range(width))]
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(books)
        found = rows.select("vector").mapInArrow(sums, ", ".join(f"{n} long" for n in names))
        books = books.copy()
        for r in found.groupBy("part", "entry").agg(*[F.sum(n).alias(n) for n in names[2:]]).collect():
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        sent.unpersist()
    return books


def compress(vectors: DataFrame, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of the rows of (vec_id, embedding, label) that are kept.

    Rows whose vector is null or has a null or non-finite component are dropped. Components become floor(scale * x). The
    codebooks start as the parts of the ``entries`` (256 at most) smallest kept ids, fewer where there are fewer rows; equal
    ids go by their integers, null ids come last, repeated rows count each. The vector length is that of the smallest of
    these; rows of another length can't be coded and are dropped too. Lengths that ``parts`` doesn't divide count as if zeros
    followed. ``code`` has two hex digits for each part, ``error`` is the squared distance to the entries, ``label_error``
    its sum over equal labels, nulls together. Components so large that an error might not fit in a long (131,072 at 64
    components and scale 1,024) are an error. An empty table gives an empty result.

    Each round reads the vectors, adds up sums by entry in every task and sends ``parts`` x ``entries`` rows a task; nothing
    of the vectors is shuffled. Labels with very many rows are joined back over salts.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), F.col("label"))
    first = _first_vectors(rows, scale, entries)
    dims = len(first[0]) if first else 0
    books = _by_part([v for v in first if len(v) == dims], dims, parts).transpose(1, 0, 2)
    if first:
        books = _rounds(rows, books, scale, dims, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, x = _matrix(b.column("vector"), scale, dims, parts)
            for at in range(0, len(keep) if len(first) else 0, _ROWS):
                found = [nearest(x[at : at + _ROWS, p], sent.value[p]) for p in range(parts)]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                text = codes.tobytes().hex()
                own = pa.array(keep[at : at + _ROWS])
                code = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("id").take(own), b.column("label").take(own), code, pa.array(sum(d for _, d in found))], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    out = settled(rows.mapInArrow(coded, f"vec_id long, label {kind}, code string, error long").withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    sums = out.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return spread_join(out, sums, "__label").select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

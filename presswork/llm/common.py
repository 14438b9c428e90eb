"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space is the only separator of words, so that JVM, Python and SQL agree.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a temporary one is, but only with a local master (tests)."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared)
        return shared
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="presswork-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Stands for a null id where rows go through Python, which has no null integers; it is also the smallest id.
NO_ID = -(1 << 63)


def id_key(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def id_back(col: str = "doc_id") -> Column:
    return F.nullif(F.col(col), F.lit(NO_ID))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def ascii_lower(text: Column) -> Column:
    """Only A-Z become lower case; pure ASCII strings take the JVM's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def held_out(doc_id: Column) -> Column:
    """The fold that fitting never sees: crc32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def one_row_an_id(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(turn, y, text) for the ids of ``chosen`` (doc_id, turn, y), a bounded frame with one row an id: of several documents of an id
    the one whose text has the least hash. Tasks hand on one row an id at most, so an id that stands in many rows costs no more."""
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("turn", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], parts: int = 1000) -> DataFrame:
    """The inner join of ``left`` with ``right``, which has one row for each ``key`` (a column, or several) and the number of its left rows in column ``n``.

    Keys with more than a ``parts``-th of all left rows, at most ``parts`` of them and so broadcast, are dealt over salts in
    proportion, in which their right row is repeated: no task gets more than about that part of the rows by one key. ``n`` goes.
    """
    total = right.agg(F.sum("n")).first()[0] or 0
    most = max(1, -(-total // parts))
    keys = [key] if isinstance(key, str) else key
    salts = right.select(*keys, F.ceil(F.col("n") / most).cast("int").alias("__salts")).filter("__salts > 1")
    dealt = left.join(F.broadcast(salts), keys, "left").withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.monotonically_increasing_id() % F.col("__salts")).cast("int"))
    repeated = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / most).cast("int") - 1))))
    return dealt.drop("__salts").join(repeated.drop("n"), [*keys, "__salt"]).drop("__salt")


def member_test(ids: DataFrame, col: str = "doc_id", bits: int = 27) -> Callable[[Column], Column]:
    """A test of a column of ids that is true for all of ``ids`` and for few others.

    It is a bitmap of ``2**bits`` hashed ids (16 MB, whatever the number of ids), built by an aggregate. What it lets pass too
    much is settled by an exact join behind it; it spares that join the rows that surely have no partner, texts included.
    """

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast("long")), F.lit(1 << bits)) + 1

    rows = ids.select(place(F.col(col)).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.collect():
        part = np.frombuffer(bytes(r["m"]), np.uint8)
        whole[(r["b"] - 1) * len(part) :][: len(part)] = part
    sent = ids.sparkSession.sparkContext.broadcast(whole)

    def test(places: pd.Series) -> pd.Series:
        v = places.to_numpy() - 1
        return pd.Series((sent.value[v >> 3] >> (v & 7).astype(np.uint8)) & 1 == 1)

    found = F.pandas_udf(test, "boolean")
    return lambda c: found(place(c))


def without_ids(docs: DataFrame, gone: DataFrame, col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``gone``; null ids stay. Only rows that may be in it are shuffled."""
    gone = settled(gone.select(col).distinct())
    maybe = F.coalesce(member_test(gone, col)(F.col(col)), F.lit(False))
    return docs.filter(~maybe).unionByName(docs.filter(maybe).join(gone, col, "left_anti").select(*docs.columns))


def byte_slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes sum to about ``limit`` at most (one item at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


#: An odd multiplier and its inverse modulo 2^64. With prefix sums of byte * _BASE**place, a span's sum times
#: _INVERSE**start is a hash of the span that doesn't depend on where it stands.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the multiplier and of its inverse; kept for up to a million places."""
    have = _POWERS[0] if _POWERS else None
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        have = tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(m - 1, b, np.uint64)))) for b in (_BASE, _INVERSE))
        if m <= 1 << 20:
            _POWERS[:] = [have]
    return have[0][:n], have[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits depend on all bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x

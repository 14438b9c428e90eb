"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next stage's documents.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import line_dedup, mixing, packing, quality_rules, shingle_dedup
from presswork.llm.common import checkpoint_dir, read_documents


def whole_row(docs: DataFrame) -> Column:
    """All columns as one, so that none clashes with an operator's own."""
    return F.struct("*").alias("__row")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality_rules.judge(docs.select("text", "lang", whole_row(docs)), carry=["__row"]).filter("kept").select("__row.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that many share; n_chars follows the text. A document that loses all its lines goes."""
    out = line_dedup.drop_shared_lines(docs.select("doc_id", "text", whole_row(docs))).filter((F.col("n_dropped") == 0) | (F.col("text") != ""))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash groups over five words, and of what these leave five-word Jaccard of 0.8 or more."""
    return shingle_dedup.keep_one_of_each(docs, similarity=0.8, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_shared_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express SimHash fingerprints, the cube method's draws or best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline/{uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

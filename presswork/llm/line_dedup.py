"""Removal of lines that many documents share.

Lines are exploded with their position, normalised and hashed; the distinct
documents of each hash are counted; lines of hashes in enough documents are
dropped everywhere but in the largest doc_id; and the rest is put together
again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import SPACE_CHARS, ascii_lower, id_key, settled, spread_join, text_of


def long_lines(text: Column, min_chars: int) -> Column:
    """An array of (pos, key) of the lines whose trimmed form has ``min_chars`` code points; keys still have their case."""
    keys = F.transform(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE_CHARS)))
    return F.filter(F.transform(keys, lambda k, i: F.struct(i.alias("pos"), k.alias("key"))), lambda x: F.char_length(x["key"]) >= min_chars)


def shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(row_id, row_hash, drop array<int>): the positions of the lines that each document loses.

    Only hashes are shuffled, and each document's hashes are made distinct before that.
    """
    row = [id_key().alias("row_id"), F.xxhash64(text_of()).alias("row_hash")]
    found = docs.select(*row, F.explode(long_lines(text_of(), min_chars)).alias("x"))
    # 128 bits of a key: both halves come from xxhash64, the second with a prefix, so that even among 10^12 distinct
    # lines two with one hash are not to be expected.
    key = ascii_lower(F.col("x.key"))
    hashed = found.select("row_id", "row_hash", "x.pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))
    # Numbers only, and settled: they are read twice, and made from the texts once.
    lines = settled(hashed)
    per_doc = lines.groupBy("h1", "h2", "row_id").agg(F.count("*").alias("lines"))
    common = per_doc.groupBy("h1", "h2").agg(F.sum("lines").alias("n"), F.count("*").alias("n_docs"), F.max("row_id").alias("keeper")).filter(F.col("n_docs") >= min_docs)
    # A line in very many documents is one key: its rows are dealt over as many tasks as its share of all shared lines asks for.
    lost = spread_join(lines, settled(common.select("h1", "h2", "n", "keeper")), ["h1", "h2"]).filter("row_id <> keeper")
    return lost.groupBy("row_id", "row_hash").agg(F.collect_set("pos").alias("drop"))


def without(lines: Column, places: Column) -> Column:
    """``lines`` without those at ``places`` (distinct): the runs between the sorted places are joined, so each line is looked at once."""

    def cut(x: Column) -> Column:
        starts = F.concat(F.array(F.lit(-1)), x["drop"])
        ends = F.concat(x["drop"], F.array(F.size(x["lines"])))
        runs = lambda s: F.transform(s["starts"], lambda a, i: F.slice(x["lines"], a + 2, F.get(s["ends"], i) - a - 1))
        return F.flatten(F.element_at(F.transform(F.array(F.struct(starts.alias("starts"), ends.alias("ends"))), runs), 1))

    return F.element_at(F.transform(F.array(F.struct(lines.alias("lines"), F.sort_array(places).alias("drop"))), cut), 1)


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with text as it remains, and n_lines, n_dropped (long).

    The text is split at every newline; null and empty texts are one empty line and stay empty.
    A line's key is the line without ASCII white space at its ends and with A-Z in lower case.
    Keys of at least ``min_chars`` code points found in at least ``min_docs`` distinct doc_ids
    lose all their lines except those in the largest doc_id (a null id is the smallest).
    A document may lose all its lines: its text is then empty. Repeated rows are kept, and each
    loses its lines; other columns are kept as they are, but for those with a result's name, which are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_dropped")
    lost = shared_lines(docs, min_chars, min_docs).select(F.col("row_id").alias("__row_id"), F.col("row_hash").alias("__row_hash"), F.col("drop").alias("__drop"))
    keyed = docs.withColumns({"__id": id_key(), "__hash": F.xxhash64(text_of())})
    found = keyed.join(lost, (F.col("__id") == F.col("__row_id")) & (F.col("__hash") == F.col("__row_hash")), "left")
    lines = F.split(text_of(), "\n", -1)
    rest = F.array_join(without(lines, F.col("__drop")), "\n")
    return found.select(
        *[F.when(F.col("__drop").isNull(), text_of()).otherwise(rest).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )

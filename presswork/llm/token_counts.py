"""Token counts without token ids: once per distinct pre-token, joined to frequencies.

Each document becomes its pre-tokens with their frequencies. The distinct
pre-tokens of the corpus are counted once each, and the counts are joined back
and summed. Two kinds of pre-tokens are told apart so that the join stays even
and small: the ``head``, the most frequent ones of a bounded number, is
broadcast as a table of counts; every other pre-token goes through a shuffled
join. Which pre-tokens are in the head changes no result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import byte_slices, id_back, id_key, settled, text_of
from presswork.llm.tokens import encoder

#: Distinct pre-tokens that a task gathers before it hands them on.
_FLUSH = 200_000


def _head(docs: DataFrame, tokenizer: str, head_rows: int, fraction: float) -> dict[str, int]:
    """Counts of the most frequent pre-tokens of a random part of the rows; any choice is right, a good one is fast."""

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, seen = encoder(tokenizer), Counter()
        for b in batches:
            for text in b["text"].tolist():
                seen.update(enc.pieces(text) or ())
            if len(seen) > _FLUSH:
                yield pd.DataFrame({"piece": list(seen), "n": list(seen.values())})
                seen.clear()
        yield pd.DataFrame({"piece": list(seen), "n": list(seen.values())}).astype({"piece": object, "n": "int64"})

    found = docs.select(text_of().alias("text")).sample(fraction, seed=11).mapInPandas(frequencies, "piece string, n long")
    top = found.groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "piece").limit(head_rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for b in batches:
            yield pd.DataFrame({"piece": b["piece"], "n": [len(enc.piece_ids(p)) for p in b["piece"]]})

    return dict(top.select("piece").repartition(8).mapInPandas(count, "piece string, n long").toPandas().itertuples(index=False, name=None))


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, head_rows: int = 200_000, head_fraction: float = 0.02) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    Counts are those of the tokenizers library for the whole text without added special tokens; null and
    empty texts have 0. Only texts with special strings are counted by the library whole. Rows of one doc_id are counted each for itself; a null
    id stays null. ``head_rows`` bounds the broadcast table, ``head_fraction`` the part of rows it is chosen from.
    """
    rows = docs.select(id_key().alias("doc_id"), text_of().alias("text"))
    head = docs.sparkSession.sparkContext.broadcast(_head(docs, tokenizer, head_rows, head_fraction))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each document a row without piece (bytes and the head's sum), and its rare pre-tokens with their frequencies."""
        enc, known = encoder(tokenizer), head.value
        for b in batches:
            texts = b["text"].tolist()
            for x, y in byte_slices([len(t) for t in texts], 4_000_000):
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, row, text in zip(b["doc_id"].iloc[x:y].tolist(), b["row"].iloc[x:y].tolist(), texts[x:y]):
                    pieces = enc.pieces(text)
                    counts = Counter(pieces or ())
                    total = 0 if pieces is not None else enc.count_ids(text)
                    for piece, n in counts.items():
                        size = known.get(piece)
                        if size is not None:
                            total += size * n
                            continue
                        for column, value in zip(out, (doc_id, row, piece, n, None)):
                            column.append(value)
                    for column, value in zip(out, (doc_id, row, None, total, len(text.encode("utf-8", "surrogatepass")))):
                        column.append(value)
                yield pd.DataFrame(dict(zip(("doc_id", "row", "piece", "n", "n_bytes"), out))).astype({"piece": object, "n_bytes": "Int64"})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for b in batches:
            yield pd.DataFrame({"piece": b["piece"], "size": [len(enc.piece_ids(p)) for p in b["piece"]]}).astype({"size": "int64"})

    # The row number in its partition keeps rows of one doc_id apart. Texts are cut into pre-tokens once: what comes of it is
    # settled, and read for the vocabulary and for the join.
    keyed = rows.withColumn("row", F.monotonically_increasing_id())
    counts = settled(keyed.mapInPandas(frequencies, "doc_id long, row long, piece string, n long, n_bytes long"))
    rare = counts.filter("piece is not null")
    vocabulary = rare.select("piece").distinct().mapInPandas(count, "piece string, size long")
    # The rows without piece, one a document, have no part in the join: as null keys they would all meet in one task.
    own = counts.filter("piece is null").select("doc_id", "row", F.col("n").alias("tokens"), "n_bytes")
    joined = rare.join(vocabulary, "piece").select("doc_id", "row", (F.col("n") * F.col("size")).alias("tokens"), F.lit(None).cast("long").alias("n_bytes"))
    total = own.unionByName(joined).groupBy("doc_id", "row").agg(F.sum("tokens").alias("n_tokens"), F.max("n_bytes").alias("n_bytes"))
    return total.select(id_back().alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

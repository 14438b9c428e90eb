"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of a word, of two neighbouring words and of two words
with one between them, hashed to ``2**BITS`` places. Each coordinate learns at
its own rate, and the L1 term keeps nearly all weights at exactly zero, so the
model that goes to the executors is a short list of places and weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import byte_slices, held_out, id_back, id_key, mixed, one_row_an_id, powers, text_of

BITS = 22
_SLICE = 1 << 20
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def gram_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, place) of every gram of the texts, repeats included."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
    inside = _WORD_BYTE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    power, inverse = powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)))
    word = mixed((sums[ends] - sums[starts]) * inverse[starts])
    doc = np.searchsorted(begins, starts, side="right") - 1
    places, owners = [word], [doc]
    for gap, factor in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        same = doc[gap:] == doc[:-gap]
        places.append(mixed(word[:-gap] * np.uint64(factor) + word[gap:])[same])
        owners.append(doc[gap:][same])
    return np.concatenate(owners), (np.concatenate(places) >> np.uint64(64 - BITS)).astype(np.int64)


def train_ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 20.0, l2: float = 0.5, bias_alpha: float = 0.5, positive: float = 2.0, threshold: float = 0.7) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, places, weights) fitted to rows of (distinct places, label), in the order given.

    A place weighs nothing before its gradients sum to ``l1``, which takes several documents; toxic rows weigh ``positive`` times.
    At the end the bias is moved so that a score of ``threshold`` parts the rows best.
    """
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = -2.0, 0.0
    for _ in range(epochs):
        for at, y in rows:
            zs, ns = z[at], n[at]
            w = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            g *= positive if y else 1.0
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[at] = ns + g * g
            bias_n += g * g
            bias -= bias_alpha / (beta + np.sqrt(bias_n)) * g
    weights = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    cut = _best_cut(np.array([bias + weights[at].sum() for at, _ in rows]), np.array([y for _, y in rows]))
    if cut is not None:
        bias += np.log(threshold / (1 - threshold)) - cut
    at = np.flatnonzero(weights)
    return float(bias), at, weights[at]


def _best_cut(total: np.ndarray, labels: np.ndarray) -> float | None:
    """The log odds that part the rows with the greatest F1, in the middle between the rows beside it; None with one label only."""
    order = np.argsort(-total, kind="stable")
    hits = np.cumsum(labels[order] == 1)
    if not len(hits) or hits[-1] in (0, len(hits)):
        return None
    ranks = np.arange(1, len(hits) + 1)
    f1 = 2 * hits / (ranks + hits[-1])
    f1[:-1][total[order][:-1] == total[order][1:]] = 0  # no cut between equals
    k = int(np.argmax(f1))
    return float((total[order][k] + total[order][min(k + 1, len(order) - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, **parameters) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, places, weights) learnt from at most ``max_rows`` labelled documents outside the held-out fold.

    The rows are those of the smallest hashes of doc_id, so a larger bound only adds rows. One task
    gathers their places, ``max_rows`` rows at most, and goes through them in that order. Of several rows of one id the one
    whose text has the least hash serves; null labels and null ids don't count and an id that has several labels takes the
    greatest. Without labelled rows every score is that of the first bias.
    """
    chosen = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).withColumn("turn", F.xxhash64("doc_id")).orderBy("turn").limit(max_rows)
    rows = one_row_an_id(docs, chosen)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"turn": b["turn"], "y": b["y"], "at": [np.unique(gram_places([t])[1]).astype(np.int32) for t in b["text"]]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in zip(b["turn"].tolist(), b["y"].tolist(), b["at"])]
        rows.sort(key=lambda r: r[0])
        bias, at, weight = train_ftrl([(r[2], r[1]) for r in rows], **parameters)
        yield pd.DataFrame({"at": np.concatenate(([-1], at)), "weight": np.concatenate(([bias], weight))})

    grams = rows.mapInPandas(places, "turn long, y int, at array<int>")
    found = grams.repartition(1).mapInPandas(learn, "at long, weight double").toPandas()
    if not len(found):
        return -2.0, np.empty(0, np.int64), np.empty(0)
    found = found.sort_values("at")
    return float(found["weight"].iloc[0]), found["at"].to_numpy()[1:], found["weight"].to_numpy()[1:]


def score_texts(texts: list[str], model: tuple[float, np.ndarray, np.ndarray]) -> np.ndarray:
    bias, at, weight = model
    total = np.full(len(texts), bias)
    if len(at):
        known = np.zeros(1 << BITS, bool)
        known[at] = True
        for x, y in byte_slices([len(t) for t in texts], _SLICE):
            doc, place = gram_places(texts[x:y])
            hit = known[place]
            pairs = np.unique(np.stack((doc[hit], place[hit])), axis=1)
            np.add.at(total, pairs[0] + x, weight[np.searchsorted(at, pairs[1])])
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null and empty texts get the bias's score.

    Whole texts count, however long. A null id stays null and is not held out; repeated rows are scored each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": score_texts(b["text"].tolist(), sent.value)})

    scored = docs.select(id_key().alias("doc_id"), text_of().alias("text")).mapInPandas(run, "doc_id long, score double")
    scored = scored.withColumn("doc_id", id_back())
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

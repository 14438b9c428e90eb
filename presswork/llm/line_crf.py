"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features describe it and its neighbours;
the chain's transitions tie neighbouring lines together. Forward-backward gives
each line's probability of being good, and their mean weighted by line length
is the document's score. Labels are known for documents only, so in fitting all
lines of a document carry its label; chains are never cut, in fitting or scoring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import byte_slices, held_out, id_back, id_key, one_row_an_id, text_of

_SLICE = 1 << 20
#: Classes of UTF-8 bytes: lower, upper, digit, blank, mark of a sentence, shouting, symbol, other ASCII, above ASCII.
_CLASS = np.full(256, 7, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 8
for _n, _chars in ((3, b" \t\r\v\f"), (4, b".,;:'\"()?-"), (5, b"!"), (6, b"#*$%&|<>")):
    _CLASS[list(_chars)] = _n
_N = 9
OWN = 17
FEATURES = OWN + 2 * (OWN - 1)
MODEL = FEATURES + 4


def own_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of the line itself, lengths, number of lines of each text) of all lines of the texts."""
    lines = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in lines])
    data = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    breaks = data == 10
    number = np.cumsum(breaks)
    total = int(counts.sum())
    kinds = np.bincount(number[~breaks] * _N + _CLASS[data[~breaks]], minlength=total * _N).reshape(total, _N).astype(np.float64)
    length = kinds.sum(1)
    per = 1 / np.maximum(length, 1)
    own = np.zeros((total, OWN))
    own[:, 0] = 1
    own[:, 1:10] = kinds * per[:, None]
    own[:, 10] = np.log1p(length) / 8
    at = 0
    for doc in lines:
        seen: set[str] = set()
        for line in doc:
            words = line.split()
            n = len(words)
            if n:
                d = len(set(words))
                own[at, 11] = 1 - d / n
                own[at, 12] = math.log1p(n - d) / 6
                own[at, 13] = min(2.0, length[at] / n / 20)
                own[at, 14] = line in seen
                seen.add(line)
            else:
                own[at, 15] = 1
            own[at, 16] = n < 4
            at += 1
    return own, length, counts


def with_neighbours(own: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """Each line's own features and those of the lines before and after it in its text (``counts``: lines of each text; default: one text)."""
    counts = np.array([len(own)]) if counts is None else counts
    before, after = np.zeros((len(own), OWN - 1)), np.zeros((len(own), OWN - 1))
    before[1:], after[:-1] = own[:-1, 1:], own[1:, 1:]
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    before[first], after[first + counts - 1] = 0, 0
    return np.hstack((own, before, after))


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, number of lines of each text) of all lines of the texts."""
    own, length, counts = own_features(texts)
    return with_neighbours(own, counts), length, counts


def chain(gain: list[float], steps: list[float]) -> tuple[list[float], list[float], float]:
    """Forward-backward over one document's lines: (probability of "good" for each line, expected numbers of the
    four kinds of steps, log of the sum over all labellings).

    gain is the log odds of a line by itself, steps the log weights of bad-bad, bad-good, good-bad, good-good. Both
    passes keep their two values summing to 1, so chains may be of any length.
    """
    bb, bg, gb, gg = (math.exp(x) for x in steps)
    odds = [math.exp(min(30.0, max(-30.0, x))) for x in gain]
    forward, f, log = [], None, 0.0
    for o in odds:  # f: probability of good given the lines so far
        good, bad = (o, 1.0) if f is None else (o * (f * gg + (1 - f) * bg), f * gb + (1 - f) * bb)
        f = good / (good + bad)
        log += math.log(good + bad)
        forward.append(f)
    out, kinds, good, bad = [0.0] * len(odds), [0.0] * 4, 1.0, 1.0
    for k in range(len(odds) - 1, -1, -1):
        f = forward[k]
        g, b = f * good, (1 - f) * bad
        out[k] = g / (g + b)
        up_good, up_bad = odds[k] * good, bad
        if k:
            e = forward[k - 1]
            each = (1 - e) * bb * up_bad, (1 - e) * bg * up_good, e * gb * up_bad, e * gg * up_good
            total = sum(each)
            for n in range(4):
                kinds[n] += each[n] / total
        good, bad = gg * up_good + gb * up_bad, bg * up_good + bb * up_bad
        scale = good + bad
        good, bad = good / scale, bad / scale
    return out, kinds, log


def marginals(gain: list[float], steps: list[float]) -> list[float]:
    """The probability of "good" for each line."""
    return chain(gain, steps)[0]


def document_scores(texts: list[str], model: np.ndarray) -> list[float]:
    out = []
    for x, y in byte_slices([len(t) for t in texts], _SLICE):
        features, length, counts = line_features(texts[x:y])
        gain, at = (features @ model[:FEATURES]).tolist(), 0
        for n in counts.tolist():
            p, w = np.array(marginals(gain[at : at + n], model[FEATURES:].tolist())), length[at : at + n]
            out.append(float((p * w).sum() / w.sum()) if w.sum() else float(p.mean()))
            at += n
    return [min(1.0, max(0.0, s)) for s in out]


def loss_and_gradient(own: np.ndarray, label: int, model: np.ndarray) -> tuple[float, np.ndarray]:
    """A whole document's negative log likelihood per line, all its lines having the label, and the gradient by the model."""
    x, n = with_neighbours(own), len(own)
    gain = np.clip(x @ model[:FEATURES], -30, 30)
    p, kinds, log = chain(gain.tolist(), model[FEATURES:].tolist())
    seen = np.zeros(4)
    seen[3 * label] = n - 1
    loss = log - label * float(gain.sum()) - float(seen @ model[FEATURES:])
    return loss / n, np.concatenate((x.T @ (np.array(p) - label), np.array(kinds) - seen)) / n


def train_crf(rows: list[tuple[np.ndarray, int]], epochs: int = 8, rate: float = 0.4, l2: float = 1e-4) -> np.ndarray:
    """Weights that make the labels of the documents' lines likeliest; ``rows`` are (own line features, label), in the order given.

    Stochastic gradient steps, one whole document each, with a rate for each coordinate (by its summed squared
    gradients). Both labels weigh alike in sum, and so do documents of any number of lines. The weights are the
    mean of those of the last half of the steps. With one label only, all weights are zero.
    """
    good = sum(y for _, y in rows)
    if good in (0, len(rows)):
        return np.zeros(MODEL)
    weight = {1: 0.5 * len(rows) / good, 0: 0.5 * len(rows) / (len(rows) - good)}
    model, squares, mean, met = np.zeros(MODEL), np.full(MODEL, 1e-8), np.zeros(MODEL), 0
    for epoch in range(epochs):
        for own, y in rows:
            g = weight[y] * loss_and_gradient(own, y, model)[1] + l2 * model
            squares += g * g
            model = model - rate * g / np.sqrt(squares)
            model[FEATURES:] = np.clip(model[FEATURES:], -2, 2)
            if 2 * epoch >= epochs:
                met += 1
                mean += (model - mean) / met
    return mean if met else model


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, **parameters) -> np.ndarray:
    """The model learnt from at most ``max_rows`` labelled documents outside the held-out fold, those of the smallest hashes of doc_id.

    Every document of the sample serves with all its lines, as one chain. One task gathers their features, ``max_rows`` rows at
    most, and goes through them in the order of the hashes; only the weights reach the driver. Of several rows of one id the
    one whose text has the least hash serves. Null labels and null ids don't count; an id with several labels takes the
    greatest. Without labelled rows all weights are zero.
    """
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")).withColumn("turn", F.xxhash64("doc_id")).orderBy("turn").limit(max_rows)
    rows = one_row_an_id(docs, chosen)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"turn": b["turn"], "y": b["y"], "f": [own_features([t])[0].astype("<f4").tobytes() for t in b["text"].tolist()]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = sorted((turn, y, f) for b in batches for turn, y, f in zip(b["turn"].tolist(), b["y"].tolist(), b["f"].tolist()))
        model = train_crf([(np.frombuffer(f, "<f4").reshape(-1, OWN), y) for _, y, f in found], **parameters)
        yield pd.DataFrame({"at": np.arange(MODEL), "weight": model})

    learnt = rows.mapInPandas(features, "turn long, y int, f binary").repartition(1).mapInPandas(learn, "at long, weight double").toPandas()
    return learnt.sort_values("at")["weight"].to_numpy() if len(learnt) else np.zeros(MODEL)


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; whole texts count, however long.

    Null and empty texts are one empty line, and have the score of it. A null id stays null and is not
    held out; repeated rows are scored each; other columns are not looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": np.array(document_scores(b["text"].tolist(), model), dtype=float)})

    scored = docs.select(id_key().alias("doc_id"), text_of().alias("text")).mapInPandas(run, "doc_id long, score double").withColumn("doc_id", id_back())
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

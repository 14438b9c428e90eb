"""Periodic runs, vector codes and SentencePiece against plain computations, and on awkward rows."""

from __future__ import annotations

import glob
import hashlib
import math
import os
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from pyspark.sql import functions as F

from presswork.llm import common, line_crf, line_dedup, mixing, oracles, periodic_runs, piece_merges, queries, token_files, toxicity, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, runs long, ids string"
ODD = [
    (1, None, None, 1, "x"),
    (2, "", "en", 1, "x"),
    (3, " \n\t ", "en", 1, "x"),
    (4, "a a a a a a", "en", 1, "x"),
    (None, "a b a b a b a b a", "en", 1, "x"),
    (5, "x\x1cy \x0b z  ▁w ▁▁ 漢字漢字 \U0001f600\x00 é  ", "de", 1, "x"),
    (5, "x\x1cy \x0b z  ▁w ▁▁ 漢字漢字 \U0001f600\x00 é  ", "de", 1, "x"),
    (6, "  leading\n\n\nlines \r\n <s> <0x41> <unk>", "fr", 1, "x"),
    (7, "\n".join("one two three four five six seven".split() * 300) + " end", "en", 1, "x"),
    (8, "".join(chr(0x4E00 + i % 900) for i in range(20_000)), "zh", 1, "x"),
    (9, " ".join(f"w{i}" for i in range(20_000)), "en", 1, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


# 11


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """All runs by comparing the words with themselves at every distance."""
    codes = {}
    w = np.array([codes.setdefault(x, len(codes)) for x in words], np.int64)
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        same = np.concatenate(([0], (w[q:] == w[:-q]).astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(same))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if y + q - x >= max(6, 4 * q):
                found.setdefault((x, y + q - x), q)  # a stretch of period q whose smallest period was found before
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list) -> str:
    lost = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in lost)


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        n, kinds = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 8 else 0):
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            for i in range(a, rng.randint(a, n)):
                w[i] = w[a + (i - a) % p]
        got = list(zip(*(x.tolist() for x in periodic_runs.find_runs(np.array(w, np.int64)))))
        assert got == plain_runs(w)


def test_range_successor():
    rng = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 65, 300):
        values = rng.permutation(n)
        left = rng.integers(0, n, 50)
        right = np.minimum(n, left + rng.integers(1, n + 1, 50))
        own = np.array([rng.choice(values[a:b]) for a, b in zip(left, right)])
        before, after = periodic_runs.RangeSuccessor(values).nearest(left, right, own)
        for a, b, x, p, s in zip(left, right, own, before, after):
            part = values[a:b]
            assert p == max(part[part < x], default=-1) and s == min(part[part > x], default=-1)


def test_other_minimum():
    words = np.array([1, 2] * 3 + [3] * 7 + [4, 5] * 6)
    assert [tuple(map(int, r)) for r in zip(*periodic_runs.find_runs(words, 12, 4))] == [(13, 12, 2)]
    assert [tuple(map(int, r)) for r in zip(*periodic_runs.find_runs(words, 6, 7))] == [(6, 7, 1)]
    with pytest.raises(ValueError):
        periodic_runs.find_runs(words, 6, 3)


def test_op11_equals_plain(spark, sf):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    texts = texts_of(spark, sf)
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        words = WORD.findall(text)
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        expected = (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())
        assert tuple(got[doc_id]) == expected
    assert sum(r["n_runs"] for r in got.values()) > 10


@pytest.mark.parametrize("at_once", [1, 1 << 20])
def test_runs_of_odd_rows(odd, nothing, at_once):
    rows = periodic_runs.collapse_runs(odd, bytes_at_once=at_once).collect()
    assert sorted(map(repr, (r["doc_id"] for r in rows))) == sorted(repr(r[0]) for r in ODD)
    texts = {r[0]: WORD.findall(r[1] or "") for r in ODD}
    for r in rows:
        runs = [tuple(x) for x in r["runs"]]
        assert runs == plain_runs(texts[r["doc_id"]]) and r["n_words"] == len(texts[r["doc_id"]]) and r["collapsed"] == collapsed(texts[r["doc_id"]], runs)
        assert (r["best"] is None) == (not runs)
    assert periodic_runs.collapse_runs(nothing).collect() == []
    planted = queries.with_planted_runs(odd)
    assert planted.count() == len(ODD) and planted.filter("doc_id is null").first()["text"] == ODD[4][1]


# 12


def plain_codes(rows: list[tuple]) -> dict | list:
    """The contract by Python's integers: [(vec_id, code, error, label_error)], digest."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // 4
    cut = [[v[p * width : (p + 1) * width] for p in range(4)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:256]] for p in range(4)]

    def assign(p: int, part: list[int]) -> tuple[int, int]:
        far = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(4):
        for p in range(4):
            members: dict[int, list] = {}
            for c in cut:
                members.setdefault(assign(p, c[p])[0], []).append(c[p])
            for e, ms in members.items():
                books[p][e] = [sum(col) // len(ms) for col in zip(*ms)]
    found = [[assign(p, c[p]) for p in range(4)] for c in cut]
    errors = [sum(d for _, d in f) for f in found]
    by_label: dict = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for k, _ in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors)]


def test_exact_dot():
    rng = np.random.default_rng(1)
    for top in (10, 1 << 20, 1 << 27):
        x, y = rng.integers(-top, top, (9, 16)), rng.integers(-top, top, (7, 16))
        expected = [[sum(int(a) * int(b) for a, b in zip(r, s)) for s in y] for r in x]
        assert vector_codes.exact_dot(x, y).tolist() == expected
    x = np.array([[-(1 << 30) + 1, (1 << 30) - 7]])
    assert vector_codes.exact_dot(x, x).tolist() == [[sum(int(v) ** 2 for v in x[0])]]
    assert len(vector_codes.limbs(np.array([[1 << 60]]), 20)) == 4


def test_first_of_equal_entries():
    code, error = vector_codes.nearest(np.array([[0, 0], [5, 5]]), np.array([[1, 0], [0, 1], [5, 5], [5, 5]]))
    assert code.tolist() == [0, 2] and error.tolist() == [1, 0]


def test_op12_equals_plain(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = [tuple(r) for r in queries.op12_vector_codes(spark, sf).collect()]
    assert sorted(got) == sorted(plain_codes(rows))


def test_op12_equals_sql(spark, sf):
    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = db.execute(oracles.ORACLES["op12_vector_codes"])
    names = [d[0] for d in found.description]
    got = queries.op12_vector_codes(spark, sf).select(*names).collect()
    assert sorted(tuple(r) for r in got) == sorted(found.fetchall())


def test_codes_of_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [rows[0], (0, rows[1][1], 7), (None, rows[5][1], None), (None, rows[6][1], 1), (400, None, 1), (401, [1.0] * 7 + [None], 1)]
    rows += [(402, [1.0] * 7 + [math.nan], 1), (403, [math.inf] * 8, 1), (404, [1.0] * 4, 1), (405, [], 1), (406, [-1000.0, 1000.0] * 4, 3)]
    schema = "vec_id long, embedding array<double>, label int, code long, error string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema).repartition(5)
    got = vector_codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_codes(rows)))
    assert vector_codes.compress(df.limit(0)).collect() == []
    assert vector_codes.compress(df.filter("vec_id = 400")).collect() == []
    assert [r["code"] for r in vector_codes.compress(df.filter("vec_id = 405")).collect()] == ["00000000"]
    few = vector_codes.compress(df.filter("vec_id < 3 or vec_id = 404"), parts=3, entries=2).collect()
    assert len(few) == 5 and {r["code"][:2] for r in few} <= {"00", "01"}
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1)], "vec_id long, embedding array<double>, label int")).collect()


# 13


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def some_texts(library) -> list[str]:
    rng = random.Random(4)
    pieces = [library.id_to_piece(i) for i in range(260, 32_000)]

    def one() -> str:
        kind = rng.randrange(4)
        if kind == 0:
            return "".join(rng.choice("- =a\n▁#_*") * rng.randint(1, 40) for _ in range(rng.randint(0, 6)))
        if kind == 1:
            return "".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))).replace("▁", " ")
        if kind == 2:
            return "".join(rng.choice("etaoinshrdlu  cABC\n123 ,.") for _ in range(rng.randint(1, 200)))
        return "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0xE000, 0xE004), rng.randrange(0x1F300, 0x1F600)])) for _ in range(rng.randint(1, 60)))

    return [one() for _ in range(3000)] + ["", " ", "  ", "\n", "\n\n", "-" * 5000 + "x", " " * 3000, "".join(rng.choice("abcdefgh+/XYZ019") for _ in range(20_000))]


@pytest.mark.parametrize("max_rounds", [400, 2])
def test_pieces_equal_the_library(library, max_rounds):
    model, texts = piece_merges.PieceModel(MODEL, cache=2000, max_rounds=max_rounds), some_texts(library)
    for at in range(0, len(texts), 500):
        assert model.encode(pa.array(texts[at : at + 500])).to_pylist() == library.encode(texts[at : at + 500])


def test_any_ids_decode_as_in_the_library(library):
    model, rng = piece_merges.PieceModel(MODEL), random.Random(6)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32_000), 0, 1, 2, 35]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_op13_equals_the_library(spark, sf, library):
    got = {r["doc_id"]: tuple(r) for r in queries.op13_piece_merges(spark, sf).collect()}
    texts = texts_of(spark, sf)
    assert got.keys() == texts.keys()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc_id, text in texts.items():
        ids = library.encode(text)
        assert got[doc_id] == (doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def test_pieces_of_odd_rows(spark, odd, nothing, library):
    encoded = piece_merges.encode(odd)
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in encoded.collect()) == sorted((repr(i), library.encode(t or "")) for i, t, *_ in ODD)
    assert sorted((repr(r["doc_id"]), r["text"]) for r in piece_merges.decode(encoded).collect()) == sorted((repr(i), library.decode(library.encode(t or ""))) for i, t, *_ in ODD)
    assert piece_merges.decode(piece_merges.encode(nothing)).collect() == []
    nulls = piece_merges.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()
    assert [(r["n_tokens"], r["text"]) for r in nulls] == [(0, ""), (0, "")]


# What the other operators do with rows of one id


def test_rows_that_reach_the_fit(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7}") for i in range(500)] + [(2, "b"), (3, None), (None, "x")], "doc_id long, text string")
    chosen = spark.createDataFrame([(1, 10, 0), (2, 20, 1), (3, 30, 0), (9, 40, 1)], "doc_id long, turn long, y int")
    rows = common.one_row_an_id(docs, chosen).collect()
    assert sorted((r["turn"], r["y"], r["text"]) for r in rows if r["turn"] != 10) == [(20, 1, "b"), (30, 0, "")]
    assert len(rows) == 3
    again = common.one_row_an_id(docs.orderBy(F.rand(1)), chosen).collect()
    assert sorted(rows) == sorted(again)


def test_hot_labelled_id(spark):
    """An id that fills the table doesn't change what is learnt from the others."""
    docs = spark.createDataFrame([(i, "good words of a quiet text " * 5 if i % 2 else "zz## $$ %% && junk") for i in range(60)], "doc_id long, text string")
    hot = docs.union(docs.filter("doc_id = 1").withColumn("text", F.explode(F.array_repeat(F.col("text"), 3000))))
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    assert np.array_equal(line_crf.fit(hot, labels), line_crf.fit(docs, labels))
    assert all(np.array_equal(a, b) for a, b in zip(toxicity.fit(hot, labels), toxicity.fit(docs, labels)))


def words_by_source(rows) -> dict:
    out: dict = {}
    for r in rows:
        out[r["source"]] = out.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    return out


def test_written_words_are_the_plans(spark):
    """Null ids, repeated ids, equal rows and null sources: every source's written words are those of the plan."""
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else i // 4, " ".join(["w"] * rng.randint(0, 60)) if i % 11 else None, rng.choice(["a", "b", None]), i % 5) for i in range(300)]
    rows += [(7, "same words here", "a", 1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long").repartition(7)
    plan: dict = {}
    for r in mixing.mix(docs).collect():
        plan[r["source"]] = plan.get(r["source"], 0) + r["taken"]
    written = mixing.mixed_documents(docs)
    assert written.columns == docs.columns
    assert words_by_source(written.collect()) == {k: v for k, v in plan.items() if v}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_heavy_shards_are_split(spark):
    rows = [(None, "one two three", "a")] * 2000 + [(i, "one two", "b") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, shard_docs=50).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 3 for r in found)
    units = spark.range(1000).select(F.col("id").alias("row"), F.lit("a").alias("source"), F.when(F.col("id") < 900, 1).otherwise(2).alias("shard"))
    split = mixing._split_heavy(units, 50).groupBy("source", "shard").count()
    assert split.agg(F.max("count")).first()[0] <= 150 and split.agg(F.sum("count")).first()[0] == 1000


def test_several_files_for_one_id(spark, tmp_path):
    docs = spark.createDataFrame([(i % 3 if i % 5 else None, f"text number {i}") for i in range(200)], "doc_id long, text string")
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}", file_bytes=300)
    assert manifest.count() > 5
    rows = token_files.read_token_files(manifest, f"file://{tmp_path}").orderBy("start").collect()
    assert len(rows) == 200 and [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()


def test_a_line_in_most_documents(spark):
    line = "this very line stands in most of the documents of the table"
    docs = spark.createDataFrame([(i, f"{line}\nown line of the document number {i} and no other\n{line.upper()} ") for i in range(3000)], "doc_id long, text string")
    got = line_dedup.drop_shared_lines(docs, min_docs=5)
    assert got.filter("doc_id < 2999").agg(F.min("n_dropped"), F.max("n_dropped")).first() == (2, 2)
    assert got.filter("doc_id = 2999").first()["n_dropped"] == 0

"""The corpus pipeline's stages on a small table, each against its own input."""

from __future__ import annotations

import re

import xxhash

from presswork.llm import simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def least_of_groups(ids, linked):
    """The smallest id of each group of ids that ``linked`` joins."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in ids})


def plain_near_dedup(texts):
    """The stage's contract by all pairs: five-word SimHash within 4 bits, then five-word Jaccard of 0.8 or more among what is left."""
    words = {i: WORDS.findall(t.translate(simhash._LOWER)) for i, t in texts.items()}
    shingles = {i: [" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else [] for i, w in words.items()}
    prints = {}
    for i, s in shingles.items():
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    left = least_of_groups(sorted(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    sets = {i: set(s) for i, s in shingles.items()}
    return least_of_groups(left, lambda a, b: sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def test_stages(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, before, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality_rules":
            assert 0 < docs.count() < before.count()
        if name == "line_dedup":
            assert docs.filter("n_chars <> char_length(text)").count() == 0
        if name == "simhash_dedup":
            assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == plain_near_dedup({r["doc_id"]: r["text"] or "" for r in before.select("doc_id", "text").collect()})
        if name == "mix_sources":
            assert docs.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
    assert seen == ["quality_rules", "line_dedup", "simhash_dedup", "mix_sources", "best_fit_packing"]
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, None, None, None, None), (None, "x " * 50, "en", "a", 100), (3, "", "en", "a", 0), (4, "the of and to " * 30, "en", None, 1)]
    for n, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").write.parquet(str(tmp_path / f"{n}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}{name}"))


def test_clashing_columns(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).selectExpr("*", "'x' as kept", "1 as n_lines", "2 as size", "3 as target", "4 as fp", "5 as component_id", "6 as copies", "7 as n_words", "8 as classes")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and docs.filter("kept <> 'x' or n_lines <> 1 or size <> 2 or classes <> 8").count() == 0
    odd = docs.selectExpr("*", "9 as piece", "8 as row", "7 as start", "6 as length", "5 as sequence_id", "4 as offset", "3 as shard", "2 as closed", "1 as part", "'h' as hash", "'b' as bands", "0 as n")
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, sf)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packed.agg({"piece": "min"}).first()[0] == 0
    again = corpus_pipeline.drop_near_duplicates(spark, odd, sf)
    assert again.columns == odd.columns and again.count() == odd.select("doc_id").distinct().count()


def test_oracles(spark, sf):
    import duckdb

    from presswork.llm import oracles, queries

    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    for name, sql in oracles.ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        found = db.execute(sql)
        order = [d[0] for d in found.description]
        assert sorted(order) == sorted(df.columns)
        assert sorted(map(repr, (tuple(r[c] for c in order) for r in df.collect()))) == sorted(map(repr, found.fetchall()))


def test_rules_of_other_languages_in_sql(spark, sf, tmp_path):
    """Languages without a reference and other scripts, which the tables lack, are judged alike in both engines."""
    import duckdb

    from presswork.llm import oracles, queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    finnish = "tämä on pitkä suomenkielinen lause joka ei sisällä tavallisia sanoja muista kielistä lainkaan " * 12
    rows = [(-1, finnish, "fi"), (-2, finnish, "en"), (-3, finnish, None), (-4, "это длинное предложение на другом языке " * 20, "en"), (-5, "这是 一句 中文 话 " * 60, "und"), (-6, finnish.upper(), "XX"), (-7, finnish, "en-GB"), (-8, None, "fi"), (-9, finnish, "de")]
    both = docs.union(spark.createDataFrame([(i, t and " ".join(f"{w}{k}" if k % 5 == 0 else w for k, w in enumerate(t.split())), x) for i, t, x in rows], docs.schema))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = db.execute(oracles.ORACLES["op4_divergence_rules"])
    order = [d[0] for d in found.description]
    got = [tuple(r[c] for c in order) for r in queries.op4_divergence_rules(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, found.fetchall()))
    kept = {r[order.index("doc_id")]: r[order.index("kept")] for r in got if r[order.index("doc_id")] < 0}
    assert kept[-1] and not kept[-2] and not kept[-3] and kept[-4] and not kept[-8]


def test_near_copies_of_five_words(spark):
    """Planted copies of similarity 0.8 to 0.95 go, those below stay; small chunks find the same."""
    import random

    import corpus_pipeline
    from presswork.llm import shingle_dedup

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    draw, rows = random.Random(1), []
    for n in range(40):
        words = [f"w{draw.randrange(5000)}" for _ in range(400)]
        for k, edits in enumerate((0, 3, 5, 8, 20, 30)):
            copy = list(words)
            for at in draw.sample(range(0, 390, 10), edits):
                copy[at + 5] = f"new{draw.randrange(10**6)}"
            rows.append((10 * n + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    sets = {i: shingles(t) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    by_base = [[10 * n + k for k in range(6)] for n in range(40)]
    assert sum(0.8 <= alike(g[0], x) < 0.95 for g in by_base for x in g[1:]) >= 80
    for g in by_base:
        left = [x for x in g if x in kept]
        assert g[0] in kept and all(alike(a, b) < 0.8 for a in left for b in left if a < b)
        assert all(any(alike(x, y) >= 0.8 for y in g if y < x) for x in g if x not in kept)
    assert kept >= {10 * n + 5 for n in range(40)}
    small = shingle_dedup.keep_unlike(docs, chunk_rows=2)
    assert {r["doc_id"] for r in small.collect()} == kept


def test_large_buckets_lose_no_link(spark):
    """One group in which near copies drift away from the first: chains of links, equal to all pairs, with the star and the chunks in play."""
    import random

    from presswork.llm import shingle_dedup

    draw, rows = random.Random(4), []
    words = [f"w{draw.randrange(9000)}" for _ in range(300)]
    for n in range(120):
        if n % 3 == 0:  # the text that the next ones are like moves on
            words = list(words)
            for at in draw.sample(range(0, 290, 10), 4):
                words[at + 5] = f"new{n}x{at}"
        copy = list(words)
        copy[draw.randrange(300)] = f"own{n}"
        rows.append((n, " ".join(copy)))
    sets = {i: {" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    expected = least_of_groups(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk_rows in (512, 16, 3):
        assert sorted(r["doc_id"] for r in shingle_dedup.keep_unlike(docs, chunk_rows=chunk_rows).select("doc_id").collect()) == expected

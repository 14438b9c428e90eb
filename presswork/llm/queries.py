"""The queries of the training-data operators, as the driver calls them: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import fingerprints, line_crf, line_dedup, mixing, packing, periodic_runs, piece_merges, quality_rules, simhash, token_counts, token_files, toxicity, vector_codes
from presswork.llm.common import WORD, read_documents, read_labels


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return line_crf.score(docs, line_crf.fit(docs, read_labels(spark, sf_dir)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, read_labels(spark, sf_dir)))


def op3_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_documents(spark, sf_dir).select("doc_id", "text", "lang"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_documents(spark, sf_dir).select("doc_id", "text"))


def op6_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_documents(spark, sf_dir).select("doc_id", "text"))


def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(read_documents(spark, sf_dir).select("doc_id", "text"))


def op8_seekable_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_documents(spark, sf_dir).select("doc_id", "text"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(read_documents(spark, sf_dir).select("doc_id", "text"))
    return groups.select("doc_id", "fingerprint", "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(read_documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where h = crc32 of the decimal doc_id ends in 0, words from place a = g % n on (g = h // 10, n words)
    repeat the first p = 1 + (n - a) // (3 + g % 8) of them; a null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(0)))
    cut = docs.select("doc_id", "text", g.alias("g"), words.alias("words")).withColumn("n", F.size("words").cast("long"))
    placed = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(with_planted_runs(read_documents(spark, sf_dir)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return found.select(
        *("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, F.expr("best.length * 1000 div best.period").alias("exponent_milli")),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_piece_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = piece_merges.decode(piece_merges.encode(read_documents(spark, sf_dir)))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_line_crf, op2_toxicity, op3_cube_mix, op4_divergence_rules, op5_vector_best_fit, op6_piece_counts, op7_syncmer_fingerprints, op8_seekable_token_files, op9_simhash_groups, op10_line_dedup, op11_periodic_runs, op12_vector_codes, op13_piece_merges)}

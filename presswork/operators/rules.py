"""Keyword rules that block or star articles, and their hit counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswork.functions.keywords import BOUNDED, first_rules, folded_column
from presswork.operators.settling import settled
from presswork.operators.visibility import ts


def rule_pattern(keyword: Column) -> Column:
    """A case-blind regular expression: Latin keywords between non-alphanumerics, others anywhere."""
    quoted = F.concat(F.lit(r"\Q"), F.btrim(keyword), F.lit(r"\E"))
    bounded = F.concat(F.lit(r"(?iu)(?<![A-Za-z0-9])"), quoted, F.lit("(?![A-Za-z0-9])"))
    return F.when(F.btrim(keyword).rlike(BOUNDED), bounded).otherwise(F.concat(F.lit("(?iu)"), quoted))


def matcher(keyword: str) -> str:
    """The same as a literal pattern."""
    word = re.escape(keyword.strip())
    return rf"(?iu)(?<![A-Za-z0-9]){word}(?![A-Za-z0-9])" if re.match(BOUNDED, keyword.strip()) else f"(?iu){word}"


def first_match(text: Column, rules: list[tuple[int, str]]) -> Column:
    """The id of the first matching rule in the given order, else null, as one expression: for a handful of rules."""
    out = F.lit(None).cast("int")
    for rule_id, keyword in reversed(rules):
        out = F.when(text.rlike(matcher(keyword)), rule_id).otherwise(out)
    return out


def load_rules(rules: DataFrame, kind: str) -> DataFrame:
    """(id, keyword) of the enabled rules of a kind."""
    return rules.filter((F.col("enabled") == 1) & (F.col("kind") == kind)).select("id", "keyword")


SEARCHED = ("title", "title_zh", "title_en", "summary", "digest", "digest_zh", "content_full", "content_zh")
KINDS = ("block", "star")
#: A list of (id, keyword), or a frame of these two columns.
Rules = list[tuple[int, str]] | DataFrame


def _rule_table(spark: SparkSession, block: Rules, star: Rules) -> DataFrame:
    """(id, kind, keyword) of both lists."""
    frames = [r if isinstance(r, DataFrame) else spark.createDataFrame(r, "id long, keyword string") for r in (block, star)]
    rows = [f.select(F.col("id").cast("long").alias("id"), F.lit(k).alias("kind"), "keyword") for f, k in zip(frames, KINDS)]
    return rows[0].unionByName(rows[1])


def _least_rules(rules: DataFrame) -> DataFrame:
    """One rule (id, kind, keyword) for each keyword and kind, the one of the least id: no other of these can be the first in a text."""
    least = rules.groupBy("kind", F.btrim("keyword").alias("__word")).agg(F.min(F.struct("id", "keyword")).alias("__r"))
    return least.select("__r.id", "kind", "__r.keyword")


def _automaton_bytes(rules: DataFrame) -> int:
    """About what an automaton of these keywords takes in a Python process: nodes by characters, and objects for each keyword."""
    return rules.agg(F.sum(64 * F.octet_length("keyword").cast("long") + 1024)).first()[0] or 0


def text_keys(low: Column, others: bool = True) -> Column:
    """What a folded text can be found by: its runs of letters and digits, and with ``others`` its other characters, and these with the one behind."""
    runs = F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1))
    if not others:
        return F.array_distinct(runs)
    other = r"[^a-z0-9 \n]"
    return F.array_distinct(F.concat(runs, F.regexp_extract_all(low, F.lit(f"({other})"), F.lit(1)), F.regexp_extract_all(low, F.lit(f"(?=({other}[^\n]))"), F.lit(1))))


def rule_key(word: Column, bounded: Column) -> Column:
    """One of ``text_keys`` that every text with the folded keyword has: the longest run of a bounded one, else a character that is
    no letter, digit or space, with the one behind where there is one."""
    runs = F.regexp_extract_all(word, F.lit("([a-z0-9]+)"), F.lit(1))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.char_length(r).alias("n"), r.alias("r"))))["r"]
    pair = F.regexp_extract(word, r"[^a-z0-9 ][\s\S]", 0)
    return F.when(bounded, longest).otherwise(F.coalesce(F.nullif(pair, F.lit("")), F.regexp_extract(word, "[^a-z0-9 ]", 0)))


def matched_by_keys(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, block, star) of the texts (id, text) in which a rule (id, kind, keyword) is, by a join: for more rules than fit a broadcast.

    Texts and rules meet under the rule's key. Where the key is the whole keyword that settles it; other texts are read again,
    once for each pair that met, against the keyword.
    """
    low = texts.select("id", folded_column(F.col("text")).alias("low")).filter("low <> ''")
    bounded = F.btrim("keyword").rlike(BOUNDED).alias("bounded")
    words = rules.select(F.col("id").alias("rule_id"), "kind", bounded, folded_column(F.btrim("keyword")).alias("word")).filter("word <> ''")
    keyed = settled(words.withColumn("key", rule_key(F.col("word"), F.col("bounded"))).groupBy("kind", "word", "bounded", "key").agg(F.min("rule_id").alias("rule_id")))
    sure = (F.col("word") == F.col("key")) & F.col("bounded") & F.col("word").rlike("^[a-z0-9]+$")
    # Keys of other characters, and the second reading, are only made where there are rules for them.
    others, unsure = keyed.agg(F.max(~F.col("bounded")), F.max(~sure)).first()
    met = low.select("id", F.explode(text_keys(F.col("low"), bool(others))).alias("key")).join(keyed, "key")
    hits = met.filter(sure).select("id", "kind", "rule_id")
    if unsure:
        said = F.when(F.col("bounded"), F.rlike("low", rule_pattern(F.col("word")))).otherwise(F.contains("low", "word"))
        hits = hits.unionByName(met.filter(~sure).join(low, "id").filter(said).select("id", "kind", "rule_id"))
    return hits.groupBy("id").agg(*[F.min(F.when(F.col("kind") == k, F.col("rule_id"))).alias(k) for k in KINDS])


def apply_rules(articles: DataFrame, block: Rules, star: Rules, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``articles`` with ``blocked_by``, ``starred_by`` (rule ids) and ``blocked_word``: the rule of the least id of each kind that is in
    any text of the article, in either language. Deleted and starred rows are left alone, and so are rows without a body; a
    blocked one is not starred. Blank keywords match nothing.

    Of rules with one keyword only the first goes on. One pass with an automaton of all keywords, which goes to the executors while
    it takes about ``broadcast_bytes`` in a process at most; with more of them texts and rules are joined under keys (``matched_by_keys``), but for the few keywords that
    are Latin by an odd letter only (such as a long s), which have no key and stay with the automaton.
    """
    spark = articles.sparkSession
    text = F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in SEARCHED if c in articles.columns])
    open_ = F.col("deleted_at").isNull() & (F.col("starred") == 0) & F.col("content_full").isNotNull()
    if isinstance(block, list) and isinstance(star, list) and broadcast_bytes > 0:  # lists are in the driver's memory already
        found = [(i, kind, keyword) for kind, listed in zip(KINDS, (block, star)) for i, keyword in listed]
        return _with_first(articles, F.when(open_, text), found)
    rules = settled(_least_rules(_rule_table(spark, block, star).filter(F.col("id").isNotNull() & (F.btrim("keyword") != ""))))
    size = _automaton_bytes(rules)
    odd = ~F.btrim("keyword").rlike(BOUNDED) & ~folded_column(F.btrim("keyword")).rlike("[^a-z0-9 ]")
    found = [(r["id"], r["kind"], r["keyword"]) for r in (rules if size <= broadcast_bytes else rules.filter(odd)).collect()]
    if size <= broadcast_bytes:
        return _with_first(articles, F.when(open_, text), found)
    texts = articles.filter(open_).select("id", text.alias("text"))
    hits = matched_by_keys(texts, rules.filter(~odd))
    if found:
        more = texts.select("id", first_rules(spark, F.col("text"), found, KINDS).alias("r")).select("id", "r.*")
        hits = hits.unionByName(more).groupBy("id").agg(*[F.min(k).alias(k) for k in KINDS])
    keywords = rules.filter("kind = 'block'").groupBy(F.col("id").alias("block")).agg(F.min("keyword").alias("word"))
    hits = settled(hits.join(keywords, "block", "left").select("id", F.struct(*KINDS, "word").alias("__r")))
    return _read_off(articles.join(hits, "id", "left"), F.col("__r.word"))


def _read_off(rows: DataFrame, word: Column) -> DataFrame:
    blocked = F.col("__r.block")
    return rows.withColumns({"blocked_by": blocked, "starred_by": F.when(blocked.isNull(), F.col("__r.star")), "blocked_word": word}).drop("__r")


def _with_first(articles: DataFrame, text: Column, rules: list[tuple[int, str, str]]) -> DataFrame:
    """``apply_rules`` by the automaton."""
    spark = articles.sparkSession
    words: dict[int, str] = {}
    for rule_id, kind, keyword in rules:
        if kind == "block":
            words.setdefault(rule_id, keyword)
    rows = articles.withColumn("__r", first_rules(spark, text, rules, KINDS))
    return _read_off(rows, _looked_up(spark, words)(F.col("__r.block")))


def _looked_up(spark: SparkSession, words: dict[int, str]):
    """A function from a column of rule ids to one of their keywords. A few are an expression, many a broadcast dictionary."""
    if len(words) <= 50:
        cases = F.lit(None).cast("string")
        return lambda c: _cases(c, words, cases)
    sent = spark.sparkContext.broadcast(words)
    return F.pandas_udf(lambda ids: ids.map(sent.value.get, na_action="ignore").astype(object), "string")


def _cases(column: Column, words: dict[int, str], out: Column) -> Column:
    for rule_id, word in words.items():
        out = F.when(column == rule_id, word).otherwise(out)
    return out


def carried_out(applied: DataFrame, now: str, prefix: str = "blocked: ") -> DataFrame:
    """What the rules do to the articles: blocked ones go to the trash with the keyword as their reason, others get their star."""
    old = F.col("degraded_reason") if "degraded_reason" in applied.columns else F.lit(None).cast("string")
    hit = F.col("blocked_by").isNotNull()
    effects = {
        "deleted_at": F.when(hit, ts(now)).otherwise(F.col("deleted_at")),
        "degraded_reason": F.when(hit, F.substring(F.concat(F.lit(prefix), F.col("blocked_word")), 1, 300)).otherwise(old),
        "starred": F.when(F.col("starred_by").isNotNull(), 1).otherwise(F.col("starred")),
    }
    return applied.withColumns(effects).drop("blocked_by", "starred_by", "blocked_word")


def counted(rules: DataFrame, applied: DataFrame) -> DataFrame:
    """``rules`` with the hits of this run added to theirs."""
    run = hit_counts(applied).select(F.col("rule_id").alias("id"), F.col("hits").alias("__new"))
    return rules.join(F.broadcast(run), "id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)) + F.coalesce("__new", F.lit(0))).drop("__new")  # one row a rule that matched


def hit_counts(applied: DataFrame) -> DataFrame:
    """(rule_id, hits) of the rules that matched at all."""
    ids = F.explode(F.array_compact(F.array("blocked_by", "starred_by"))).alias("rule_id")
    return applied.select(ids).groupBy("rule_id").agg(F.count("*").alias("hits"))


def rule_stats(rules: DataFrame) -> DataFrame:
    """(kind, rules, enabled, hits), a null count as 0."""
    return rules.groupBy("kind").agg(F.count("*").alias("rules"), F.count_if(F.col("enabled") == 1).alias("enabled"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def rule_totals(rules: DataFrame, articles: DataFrame) -> DataFrame:
    """One row: rules of either kind, all hits, articles in the trash, and starred ones that are not."""
    counts = rules.agg(F.count_if(F.col("kind") == "block").alias("block_rules"), F.count_if(F.col("kind") == "star").alias("star_rules"), F.coalesce(F.sum("hits"), F.lit(0)).alias("total_hits"))
    marked = articles.agg(F.count("deleted_at").alias("blocked_articles"), F.count_if((F.col("starred") == 1) & F.col("deleted_at").isNull()).alias("starred_articles"))
    return counts.crossJoin(marked)  # one row each


def rule_lists(rules: DataFrame) -> DataFrame:
    """All rules with their place in the list of their kind: most hits first, then the newest."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("hits"), F.desc("id")))
    return rules.withColumn("place", place)


def top_rules(rules: DataFrame, kind: str = "star", top: int = 8) -> DataFrame:
    return rules.filter((F.col("kind") == kind) & (F.col("enabled") == 1)).orderBy(F.desc("hits"), F.desc("id")).limit(top)


def toggle_rules(rules: DataFrame, ids: list[int]) -> DataFrame:
    return rules.withColumn("enabled", F.when(F.col("id").isin(ids), 1 - F.col("enabled")).otherwise(F.col("enabled")))


def delete_rules(rules: DataFrame, ids: list[int]) -> DataFrame:
    return rules.filter(~F.col("id").isin(ids))

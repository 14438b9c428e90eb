"""Queries over texts that the tables don't have: Chinese and mixed texts, replies of models, payloads. Every document has one of a
list of patterns, half of them with words of its own behind it, so that these tables grow with the documents; both engines make the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions import replies as R
from presswork.functions import text as T
from presswork.operators import ingest
from presswork.plans import long_sql as L
from presswork.plans.articles import articles, table
from presswork.plans.catalog import query

TEXTS = [
    None,
    "",
    " 　 ",
    "厂商推出平台。本地处理数据。语音识别准确。团队明年开放测试。费用尚无消息。",
    "这家公司介绍了它的新平台，数据可以在本地处理，识别的结果也比以前更准确，所以用户会愿意在明年试用。",
    "Just 40 cents above the older edition, as two of the reviewers put it in their notes.",
    "前一句是中文而且足够长。Just 40 cents above the older edition of it!",
    "工具 Visual Studio Code 与 Blender Studio 的更新已经发布，用户可以在下周开始下载和安装。",
    "Café — Déjà_Vu!! 新的标题 2024",
    "短标题 with few letters",
    "中文 " * 300,
    "word " * 600 + "中文" * 500,
    "一二三四五六七八九十" * 12 + "，" + "一二三四五六七八九十" * 12,
    "没有任何标点" * 60,
    "第一句话在这里。第二句话也在这里！第三句话还在这里？" * 4,
    "Sentence one is here. Sentence two is here too. And a third one follows.",
    "The Apple About neural networks said 神经网络",
    "日本語のタイトル カタカナ and more words",
    "key sk-abcdefgh12 and Bearer abc.def_1 stay hidden",
    "a，b、;c;d,e,f,g",
    "## 标题\n- **加粗** 的要点\n1. 第一\n正文",
]
REPLIES = [
    None,
    "",
    "「新的标题」\n第二行\n第三行",
    "# - A title\nA digest in\n two lines",
    "**中文导读**第一句。\nEN: An English line.\nen：another one",
    "只有中文。",
    "Entirely English without a mark",
    "- yes, the same",
    "是同一件事",
    "no",
    "同一事件的两篇报道",
    "  • Yes\nbecause",
]
PAYLOADS = [
    '{"input_tokens": 10, "output_tokens": 5, "total_tokens": 15}',
    '{"prompt_tokens": 7, "completion_tokens": 3, "prompt_tokens_details": {"cached_tokens": 4}, "completion_tokens_details": {"reasoning_tokens": 9}}',
    '{"input_tokens": -3, "output_tokens": "8", "cache_read_input_tokens": 2}',
    "{}",
    "not json",
]


#: Both engines' expression of a document's text: the pattern x of its number, as it is or before the document's own words.
MADE = "case when x is null then null when floor(doc_id / {n}) % 2 = 0 then x else concat(x, ' ', substr(coalesce(text, ''), 1, 60)) end"
PAID = "replace(replace(x, '10', cast(doc_id % 1013 as {text})), '7', cast(doc_id % 89 as {text}))"


def rows(spark, sf: str, values: list, made: str = MADE) -> DataFrame:
    """(n, x) of every document, n its id. The patterns are a short list."""
    patterns = F.broadcast(spark.createDataFrame(list(enumerate(values)), "k int, x string"))
    docs = table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % len(values)).alias("k"))
    return docs.join(patterns, "k").select(F.col("doc_id").alias("n"), F.expr(made.format(n=len(values), text="string")).alias("x"))


def rows_sql(values: list, made: str = MADE) -> str:
    listed = ", ".join(f"({n}, {'NULL::varchar' if v is None else L.quoted(v)})" for n, v in enumerate(values))
    return f"x AS (SELECT doc_id AS n, {made.format(n=len(values), text='varchar')} AS x FROM documents JOIN (VALUES {listed}) v(k, x) ON k = doc_id % {len(values)})"


TRIMMED = L.trimmed("coalesce(x, '')")
MINUTES = "greatest(1, round_even(length(regexp_replace(coalesce(x, ''), '[^一-鿿]', '', 'g')) / 400 + len(regexp_extract_all(coalesce(x, ''), '[A-Za-z]+')) / 230, 0)::int)"


@query(f"""WITH {rows_sql(TEXTS)} SELECT n, {L.english('x')} AS english, {L.letters('x', '一-鿿')} > 0 AS chinese, round({L.ratio('x')}, 6) AS share, {L.untranslated("coalesce(x, '')")} AS untranslated, {L.telegraphic('x')} AS telegraphic,
  {L.ratio(TRIMMED)} >= 0.4 AND NOT {L.untranslated(TRIMMED)} AS usable, {L.ratio(TRIMMED)} >= 0.3 AS usable_loosely, {MINUTES} AS minutes FROM x""", raw=True)
def language_of_texts(spark, sf):
    x = F.col("x")
    return rows(spark, sf, TEXTS).select(
        "n", T.looks_english(x).alias("english"), T.is_chinese(x).alias("chinese"), F.round(T.chinese_ratio(x), 6).alias("share"), T.has_untranslated_sentence(F.coalesce(x, F.lit(""))).alias("untranslated"),
        T.looks_telegraphic(x).alias("telegraphic"), T.chinese_usable(x).alias("usable"), T.chinese_usable(x, strict=False).alias("usable_loosely"), T.reading_minutes(x).alias("minutes"),
    )


@query(f"""WITH {rows_sql(TEXTS)} SELECT n, trim(regexp_replace(lower(coalesce(x, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS title_key, array_to_string({L.story_words('x')}, '|') AS words,
  CASE WHEN length({TRIMMED}) <= 12 THEN {TRIMMED} ELSE regexp_replace(substr({TRIMMED}, 1, 12), '{L.BLANK}+$', '') || '…' END AS short, {L.strip_markdown('x')} AS plain,
  regexp_replace(coalesce(x, ''), '(sk-[A-Za-z0-9_-]{{6,}}|(?i:bearer)\\s+[A-Za-z0-9._-]+)', '***', 'g') AS masked,
  array_to_string(list_filter(list_transform(string_split_regex(coalesce(x, ''), '[,，、;；]'), lambda v: {L.trimmed('v')}), lambda v: v <> '')[1:5], '|') AS tags FROM x""", raw=True)
def forms_of_texts(spark, sf):
    x = F.col("x")
    return rows(spark, sf, TEXTS).select(
        "n", T.normalize_title(x).alias("title_key"), F.array_join(F.sort_array(T.story_words(x)), "|").alias("words"), T.truncate(x, 12).alias("short"), T.strip_markdown(x).alias("plain"),
        T.redacted(F.coalesce(x, F.lit(""))).alias("masked"), F.array_join(T.split_tags(x), "|").alias("tags"),
    )


@query(f"""WITH {rows_sql(TEXTS)}, {L.digests("SELECT n AS id, 'long' AS kind, 108 AS lim, x FROM x UNION ALL SELECT n, 'short', 30, x FROM x UNION ALL SELECT n, 'body', 216, x FROM x")}
SELECT id AS n, kind, b AS digest FROM brief""", raw=True)
def digests_of_texts(spark, sf):
    each = [rows(spark, sf, TEXTS).select("n", F.lit(kind).alias("kind"), T.brief_digest(F.col("x"), limit).alias("digest")) for kind, limit in (("long", 108), ("short", 30), ("body", 216))]
    return each[0].unionByName(each[1]).unionByName(each[2])


LINES = f"list_filter(list_transform(string_split(coalesce(x, ''), chr(10)), lambda v: {L.trimmed('v')}), lambda v: v <> '')"
QUOTES = L.quoted(R.QUOTES)


@query(f"""WITH {rows_sql(REPLIES)}, l AS (SELECT n, x, {LINES} AS ls FROM x), t AS (SELECT *, array_to_string(ls[2:], ' ') AS rest, list_filter(ls, lambda v: regexp_matches(v, '(?i)^EN')) AS en, list_filter(ls, lambda v: NOT regexp_matches(v, '(?i)^EN')) AS zh FROM l)
SELECT n, nullif({L.trimmed(f"regexp_replace(trim(ls[1], {QUOTES}), '^[#*\\-— ]+', '')")}, '') AS title, ls[1] AS translated_title, nullif(CASE WHEN length(rest) <= 400 THEN rest ELSE substr(rest, 1, 400) || '…' END, '') AS translated_digest,
  {L.strip_markdown("array_to_string(zh, ' ')")} AS zh, {L.strip_markdown(f"array_to_string(list_transform(en, lambda v: {L.trimmed("regexp_replace(v, '(?i)^EN\\s*[:：]\\s*', '')")}), ' ')")} AS en,
  regexp_matches(lower(substr(regexp_replace(coalesce(x, ''), '^[\\s\\-•*#]+', ''), 1, 8)), '^(yes|y|是|同一)') AS same FROM t""", raw=True)
def readings_of_replies(spark, sf):
    x = F.col("x")
    read = rows(spark, sf, REPLIES).select("n", R.parse_title(x).alias("title"), R.parse_translate(x).alias("t"), R.split_digest(x).alias("d"), R.same_story(x).alias("same"))
    return read.select("n", "title", F.col("t.title").alias("translated_title"), F.col("t.digest").alias("translated_digest"), F.col("d.zh").alias("zh"), F.col("d.en").alias("en"), "same")


def _count(*paths: str) -> str:
    return "greatest(0, coalesce(" + ", ".join(f"try_cast(json_extract_string(j, '{p}') AS bigint)" for p in paths) + ", 0))"


@query(f"""WITH {rows_sql(PAYLOADS, PAID)}, j AS (SELECT n, CASE WHEN json_valid(x) THEN x ELSE '{{}}' END AS j FROM x),
u AS (SELECT n, {_count('$.input_tokens', '$.prompt_tokens')} AS input, {_count('$.output_tokens', '$.completion_tokens')} AS output, {_count('$.input_tokens_details.cached_tokens', '$.prompt_tokens_details.cached_tokens', '$.cache_read_input_tokens')} AS cached,
  {_count('$.output_tokens_details.reasoning_tokens', '$.completion_tokens_details.reasoning_tokens')} AS reasoning, {_count('$.total_tokens')} AS given FROM j)
SELECT n, input, output, cached, reasoning, coalesce(nullif(given, 0), input + output + greatest(0, reasoning - output)) AS total FROM u""", raw=True)
def usage_of_payloads(spark, sf):
    return rows(spark, sf, PAYLOADS, PAID).select("n", R.parse_usage(F.col("x")).alias("u")).select("n", "u.*")


NATIVE = "CASE WHEN source_id % 3 = 0 THEN concat('中文正文，说的是第', id, '件事。', substr(content_full, 1, 40)) ELSE content_full END"


@query(f"""WITH f AS (SELECT source_id, {NATIVE} AS t FROM a WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY id) <= 8),
c AS (SELECT source_id, sum({L.letters('t', '一-鿿', 2000)}) AS han, sum({L.letters('t', 'A-Za-z', 2000)}) AS latin FROM f GROUP BY source_id)
SELECT source_id, CASE WHEN han / (han + latin) >= 0.12 THEN 'zh' ELSE 'en' END AS lang FROM c""")
def source_language(spark, sf):
    """Every third source has Chinese texts with some English in them."""
    native = articles(spark, sf).filter("source_id is not null").withColumn("content_full", F.expr(NATIVE))
    return ingest.source_language(native)

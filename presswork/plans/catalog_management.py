"""Further queries: audits, archive, management pages, renderers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions import html as H
from presswork.functions import replies as R
from presswork.functions import text as T
from presswork.operators import audits, reading
from presswork.operators.visibility import latest_first, reportable
from presswork.plans import long_sql
from presswork.plans.articles import NOW, articles, sources, table
from presswork.plans.catalog import RULE_TABLE_SQL, STORED_SQL, daily_report, query, rule_table, stored

REPORTS_SQL = "reports AS (SELECT strftime(published_at, '%Y-%m-%d') AS date, count(*) AS article_count FROM rep WHERE id % 3 <> 0 GROUP BY 1)\n"


def reports(spark, sf) -> DataFrame:
    return articles(spark, sf).filter(reportable() & (F.col("id") % 3 != 0)).groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("article_count"))


@query(f"""WITH {REPORTS_SQL}, l AS (SELECT strftime(published_at, '%Y-%m-%d') AS date, count(*) AS live FROM rep GROUP BY 1)
SELECT r.date, r.article_count, coalesce(l.live, 0) AS live, (SELECT count(*) FROM reports) AS total FROM reports r LEFT JOIN l ON r.date = l.date ORDER BY r.date DESC LIMIT 20""")
def archive_list(spark, sf):
    return audits.archive(articles(spark, sf), reports(spark, sf), 20)


@query(f"WITH {REPORTS_SQL} SELECT date, article_count, (isodow(date::date) - 1)::int AS weekday FROM reports WHERE date >= '2024-01-10'")
def reports_in_range(spark, sf):
    return audits.reports_in_range(reports(spark, sf), "2024-01-10")


def source_table(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.expr("cast(s_suppkey % 3 <> 0 as int)").alias("enabled"), F.expr("cast(s_suppkey % 8 = 0 as int)").alias("deleted"), F.lit(None).cast("string").alias("disabled_reason"), F.lit(None).cast("timestamp_ntz").alias("disabled_at"))


SOURCE_SQL = "WITH src AS (SELECT s_suppkey AS id, s_name AS name, (s_suppkey % 3 <> 0)::int AS enabled, (s_suppkey % 8 = 0)::int AS deleted FROM supplier)\n"


@query(SOURCE_SQL + "SELECT enabled = 1 AS enabled, count(*) AS n FROM src WHERE deleted = 0 GROUP BY 1", raw=True)
def source_tabs(spark, sf):
    return audits.tab_counts(source_table(spark, sf))


@query(SOURCE_SQL + "SELECT id, name FROM src WHERE enabled = 1 AND deleted = 0", raw=True)
def enabled_sources(spark, sf):
    from presswork.sources.feeds import enabled_sources as scan

    return scan(source_table(spark, sf)).select("id", "name")


@query(SOURCE_SQL + "SELECT id, CASE WHEN id IN (1, 3, 5) THEN 1 - enabled ELSE enabled END AS enabled, CASE WHEN id IN (1, 3, 5) AND enabled = 1 THEN 'manual' END AS disabled_reason, CASE WHEN id IN (1, 3, 5) AND enabled = 1 THEN timestamp '2024-01-31' END AS disabled_at FROM src", raw=True)
def switch_sources(spark, sf):
    return audits.switch_sources(source_table(spark, sf), [1, 3, 5], NOW).select("id", "enabled", "disabled_reason", "disabled_at")


@query(RULE_TABLE_SQL + """, n AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE 'New ' || (s_suppkey // 4)::varchar END AS keyword, 'star' AS kind FROM supplier)
SELECT min(trim(keyword)) AS keyword, kind, 1 AS enabled, 0 AS hits FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE lower(r.keyword) = lower(n.keyword) AND r.kind = n.kind) GROUP BY lower(trim(keyword)), kind""", raw=True)
def create_rules(spark, sf):
    new = table(spark, sf, "supplier").select(F.expr("case when s_suppkey % 2 = 0 then upper(s_name) else concat('New ', cast(s_suppkey div 4 as string)) end").alias("keyword"), F.lit("star").alias("kind"))
    return audits.create_rules(rule_table(spark, sf), new)


@query(STORED_SQL + "SELECT id, process_attempts FROM st WHERE duplicate_of IS NULL AND deleted_at IS NULL AND relevance = 1 AND status IN ('processed', 'failed', 'pending') AND length(content_full) < 600 ORDER BY process_attempts, published_at DESC, id DESC LIMIT 50")
def content_queue(spark, sf):
    return audits.backfill_queue(stored(spark, sf), F.char_length("content_full") < 600).select("id", "process_attempts")


#: What backfills mark, derived from ids in either engine.
MARKS = {
    "body_sections": "case id % 3 when 0 then '[]' end",
    "body_sections_zh": "case id % 4 when 0 then '[]' end",
    "image_urls": "case id % 5 when 1 then '[]' when 2 then concat('[\"/rel.jpg\", \"https://cdn.example.com/', id, '.jpg\"]') when 3 then '[\"/only.jpg\"]' when 4 then concat('[\"https://cdn.example.com/', id, '.jpg\"]') end",
    "media_map": "case when id % 7 = 0 then concat('{\"https://cdn.example.com/', id, '.jpg\": \"/img/x.jpg\"}') when id % 7 = 1 then 'no json' end",
    "body_images": "case id % 6 when 1 then '[]' when 2 then '[{\"i\": 0, \"url\": \"u\", \"local\": \"/img/x.jpg\"}]' when 3 then '[{\"i\": 0, \"url\": \"u\"}]' end",
    "i18n_attempts": "cast(id % 7 as int)",
}
NEWEST, OPEN = "ORDER BY published_at DESC, id DESC", "link NOT LIKE 'http://localhost%'"


def _queue(name: str, where: str, limit: int, first: str = "") -> str:
    """One queue in SQL: its rows by order, numbered."""
    order = f"ORDER BY {first} published_at DESC, id DESC"
    return f"SELECT '{name}' AS queue, id, row_number() OVER ({order})::int AS place FROM (SELECT * FROM q WHERE {where} AND {OPEN} {order} LIMIT {limit})"


BRIEF_DIGEST = long_sql.strip_markdown(long_sql.filled("digest_zh", "digest"))
COVER = "list_filter(cast(json_extract(image_urls, '$') AS varchar[]), lambda u: starts_with(u, 'http'))[1]"


@query(f"""WITH q AS (SELECT *, {", ".join(f"{sql} AS {name}" for name, sql in MARKS.items())} FROM a),
b AS (SELECT * FROM q WHERE brief_zh IS NULL AND relevance = 1 {NEWEST} LIMIT 60), c AS (SELECT *, {COVER} AS cover FROM (SELECT * FROM q WHERE image_urls IS NOT NULL AND image_urls <> '[]' {NEWEST} LIMIT 150))
{_queue("translate", "(digest_zh IS NULL OR title_zh IS NULL OR content_zh IS NULL) AND (relevance = 1 OR (relevance = 0 AND title_zh IS NULL)) AND content_full IS NOT NULL AND i18n_attempts < 5", 20, "i18n_attempts,")}
UNION ALL {_queue("sections", "(body_sections_zh IS NULL OR body_sections IS NULL) AND coalesce(content_zh, '') <> '' AND relevance = 1", 15)}
UNION ALL SELECT 'brief', id, row_number() OVER ({NEWEST})::int FROM (SELECT * FROM b WHERE {BRIEF_DIGEST} <> '' AND {long_sql.letters(BRIEF_DIGEST, '一-鿿')} > 0 {NEWEST} LIMIT 20)
UNION ALL {_queue("image", "image_urls IS NULL AND relevance = 1", 20)}
UNION ALL SELECT 'cover', id, row_number() OVER ({NEWEST})::int FROM (SELECT * FROM c WHERE cover IS NOT NULL AND NOT coalesce(contains(media_map, '"' || cover || '"'), false) {NEWEST} LIMIT 50)
UNION ALL {_queue("body_fresh", "body_images IS NULL AND coalesce(content_full, '') <> '' AND relevance = 1", 20)}
UNION ALL {_queue("body_remote", "body_images IS NOT NULL AND body_images <> '[]' AND NOT contains(body_images, chr(34) || 'local' || chr(34))", 20)}""")
def backfill_queues(spark, sf):
    """The rows of all queues in their order."""
    from pyspark.sql import Window

    from presswork.operators import queues

    a = articles(spark, sf).withColumns({name: F.expr(sql) for name, sql in MARKS.items()})
    body = queues.without_body_images(a)
    found = {"translate": queues.to_translate(a), "sections": queues.without_sections(a), "brief": queues.without_brief(a), "image": queues.without_image(a), "cover": queues.covers_to_store(a), "body_fresh": body.filter("fresh"), "body_remote": body.filter("not fresh")}
    out = None
    for name, rows in found.items():
        order = [*([F.col("i18n_attempts")] if name == "translate" else []), *latest_first()]
        # A queue has some dozens of rows.
        one = rows.select(F.lit(name).alias("queue"), "id", F.row_number().over(Window.orderBy(*order)).alias("place"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT count(*) AS n, CASE WHEN count(*) = 0 THEN 'no articles in the window' ELSE 'no article matched' END AS hint FROM rep WHERE published_at >= timestamp '2024-01-28'")
def empty_hint(spark, sf):
    return audits.empty_hint(articles(spark, sf), NOW, 3)


@query("SELECT count_if(status = 'pending') AS pending, count_if(status = 'failed') AS failed, count_if(status = 'pending')::varchar || ' pending, ' || count_if(status = 'failed')::varchar || ' failed' AS note FROM a WHERE deleted_at IS NULL")
def pipeline_note(spark, sf):
    return audits.pipeline_note(articles(spark, sf))


@query("""WITH d AS (SELECT DISTINCT o_orderdate::date AS day FROM orders)
SELECT strftime(day, '%Y-%m-%d') AS date, month(day)::varchar || '/' || day(day)::varchar AS label, (isodow(day) - 1)::int AS weekday, ((day - date '0001-01-01') + 1)::int % 7 AS quote FROM d""", raw=True)
def date_labels(spark, sf):
    return audits.date_labels(table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct())


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN t >= 30 THEN 'hot' WHEN t >= 25 THEN 'warm' WHEN t >= 18 THEN 'mild' WHEN t >= 10 THEN 'cool' WHEN t >= 0 THEN 'cold' ELSE 'freezing' END AS clothing, r >= 50 AS umbrella,
  CASE WHEN w >= 88 THEN 'typhoon' WHEN w >= 62 THEN 'gale' WHEN w >= 39 THEN 'windy' END AS wind, c IN (95, 96, 99) AS storm
FROM (SELECT *, l_quantity - 10 AS t, l_discount * 1000 AS r, l_tax * 1200 AS w, l_partkey % 100 AS c FROM lineitem)""", raw=True)
def weather_advice(spark, sf):
    advice = audits.weather_advice(F.col("l_quantity") - 10, F.col("l_discount") * 1000, F.col("l_tax") * 1200, F.col("l_partkey") % 100)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", advice.alias("w")).select("l_orderkey", "l_linenumber", "w.clothing", "w.umbrella", "w.wind", "w.storm")


@query("SELECT source_id, '/img/' || (id % 7)::varchar AS url, count(*) AS n FROM a GROUP BY 1, 2 HAVING count(*) >= 3")
def site_default_images(spark, sf):
    rows = articles(spark, sf).select("source_id", F.array(F.concat(F.lit("/img/"), (F.col("id") % 7).cast("string"))).alias("images"))
    return audits.site_defaults(rows)


@query("SELECT sha1(id::varchar) || '.png' AS name FROM a WHERE id % 4 <> 0")
def orphan_images(spark, sf):
    name = F.concat(F.sha1(F.col("id").cast("string").cast("binary")), F.lit(".png"))
    a = articles(spark, sf).select("id", name.alias("name"))
    used = a.filter("id % 4 = 0").select(F.concat(F.lit('{"x": "/img/'), "name", F.lit('"}')).alias("media"))
    return audits.orphans(a.select("name"), used, "media")


@query("SELECT id, CASE WHEN score IS NULL THEN 1 ELSE 0 END AS turn FROM a")
def ordered_union(spark, sf):
    """The scored articles, then all others."""
    a = articles(spark, sf)
    return audits.ordered_union(a.filter("score is not null").select("id"), a.select("id"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN '' ELSE tags END AS reason FROM a")
def reasons(spark, sf):
    return articles(spark, sf).select("id", audits.reason_of(F.col("tags"), F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), "tags"))).alias("reason"))


@query("SELECT id, concat_ws(' · ', category, '#t' || (id % 11)::varchar || ' #u' || (id % 13)::varchar, CASE WHEN starred = 1 THEN '★' END) AS subtitle FROM a")
def section_subtitles(spark, sf):
    categories = F.array_compact(F.array("category"))
    return articles(spark, sf).select("id", audits.section_subtitle(categories, T.comma_tags(F.col("tags")), F.col("starred")).alias("subtitle"))


@query("SELECT id, source_id, title FROM rep QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, id DESC) = 1")
def newest_per_source(spark, sf):
    return audits.newest_per_group(articles(spark, sf).filter(reportable()), "source_id").select("id", "source_id", "title")


@query(f"""WITH {long_sql.brief_texts("a")} SELECT a.id, coalesce(s.name, 'unknown') AS source_name, CASE WHEN said.brief <> '' OR {long_sql.trimmed(long_sql.filled('a.title_zh', 'a.title'))} = '' THEN said.brief ELSE '(translation in preparation)' END AS digest_brief,
  coalesce(array_to_string((cast(json_extract(topics, '$') AS varchar[]))[1:3], '|'), '') AS topics_list FROM a JOIN said ON said.id = a.id LEFT JOIN s ON s.id = a.source_id""")
def article_details(spark, sf):
    return reading.article_details(articles(spark, sf), sources(spark, sf)).withColumn("topics_list", F.array_join("topics_list", "|"))


@query(f"SELECT {', '.join(reading.API_FIELDS)}, NULL::varchar AS title_en, NULL::varchar AS digest_en FROM rep")
def api_articles(spark, sf):
    return reading.api_articles(articles(spark, sf))


SHORT = "CASE WHEN id % 3 = 0 THEN '厂商推出平台。本地处理数据。语音识别准确。团队明年开放测试。费用尚无消息。' WHEN id % 3 = 1 THEN '这家公司介绍了它的新平台，数据可以在本地处理，识别的结果也比以前更准确，所以用户会愿意在明年试用。' END"


@query(f"""SELECT field, count(*) AS n FROM (SELECT 'title_zh' AS field, title_zh AS x FROM a UNION ALL SELECT 'digest', digest FROM a UNION ALL SELECT 'short', {SHORT} FROM a) WHERE {long_sql.telegraphic('x')} GROUP BY field""")
def telegraphic_audit(spark, sf):
    """With a field that is telegraphic in a third of the rows and prose in another third."""
    return audits.telegraphic_fields(articles(spark, sf).withColumn("short", F.expr(SHORT)), ["title_zh", "digest", "short"])


HALF = "CASE id % 3 WHEN 0 THEN concat(repeat('这是译文', 20), substr(content_full, 1, 60)) WHEN 1 THEN content_full ELSE repeat('全是中文的译文。', 9) END"


@query(f"SELECT id, {long_sql.english('content_full')} AND len(regexp_extract_all(z, '[A-Za-z]{{2,}}')) > 20 AND len(regexp_extract_all(z, '[A-Za-z]{{2,}}')) > length(regexp_replace(z, '[^一-鿿]', '', 'g')) AS half FROM (SELECT *, {HALF} AS z FROM a)")
def half_translated_audit(spark, sf):
    """Translations of three kinds: mostly Chinese, not translated at all, all Chinese."""
    return articles(spark, sf).select("id", audits.half_translated(F.col("content_full"), F.expr(HALF)).alias("half"))


@query("""SELECT id, CASE WHEN length(content_full) >= 400 AND NOT length(regexp_replace(substr(content_full, 1, 400), '[^A-Za-z]', '', 'g')) > 40 THEN NULL ELSE title END AS title FROM a""")
def native_cleanup(spark, sf):
    return audits.drop_foreign_side(articles(spark, sf), "content_full", ["title"]).select("id", "title")


@query(long_sql.report_html())
def report_html(spark, sf):
    return audits.report_html(daily_report(spark, sf), "2024-01-15")


@query(long_sql.page_contents(), raw=True)
def page_contents(spark, sf):
    blocks = H.block_texts(H.without_furniture(F.col("html")), 2)
    return table(spark, sf, "pages").select("page_id", F.array_join(H.contents(blocks), "|").alias("contents"))


@query(long_sql.page_sections(), raw=True)
def page_sections(spark, sf):
    """A page's sections beside those of a version of it: the same, without its first block, or with another end."""
    page = table(spark, sf, "pages").select("page_id", H.block_texts(H.without_furniture(F.col("html")), 2).alias("l"))
    other = F.when(F.col("page_id") % 3 == 0, F.col("l")).when(F.col("page_id") % 3 == 1, F.slice("l", 2, F.greatest(F.size("l"), F.lit(1))))
    both = page.withColumn("r", other.otherwise(F.concat(F.slice("l", F.lit(1), F.greatest(F.size("l") - 1, F.lit(0))), F.array(F.lit("And one more sentence stands at the end.")))))
    made = both.select("page_id", H.headings(F.col("l")).alias("l"), H.headings(F.col("r")).alias("r")).select("page_id", H.sections_of(F.col("l")).alias("s"), H.paired_sections(F.col("l"), F.col("r")).alias("p"))
    first = F.coalesce(F.size(F.get("p", F.lit(0))["right"]), F.lit(0))
    return made.select("page_id", F.array_join(F.transform("s", lambda x: x["start"].cast("string")), " ").alias("starts"), F.size("p").alias("pairs"), first.alias("first_right"))


@query(f"SELECT conv_id, turn, ls[1] AS first_line, len(ls) AS n_lines FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: {long_sql.trimmed('x')}), lambda x: x <> '') AS ls FROM conversations WHERE role = 'assistant')", raw=True)
def reply_first_lines(spark, sf):
    rows = table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", R.lines_of(F.col("text")).alias("ls"))
    return rows.select("conv_id", "turn", F.get("ls", F.lit(0)).alias("first_line"), F.size("ls").cast("long").alias("n_lines"))


@query(long_sql.reply_halves(), raw=True)
def reply_halves(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(R.halves(F.col("text")), " | ").alias("halves"))


@query(SOURCE_SQL + "SELECT id, CASE WHEN id IN (2, 5) AND deleted = 0 THEN 'New name' ELSE name END AS name, CASE WHEN id IN (3, 6) THEN 1 WHEN id IN (8, 9) THEN 0 ELSE deleted END AS deleted, CASE WHEN id IN (3, 6) AND deleted = 0 THEN 0 WHEN id = 8 AND deleted = 1 THEN 1 ELSE enabled END AS enabled FROM src", raw=True)
def managed_sources(spark, sf):
    named = audits.rename_sources(source_table(spark, sf), {2: " New name ", 5: "New name", 4: " ", 7: "x" * 300})
    return audits.restore_sources(audits.drop_sources(named, [3, 6]), [8, 9]).select("id", "name", "deleted", "enabled")


@query("SELECT count_if(status = 'pending') AS pending, count_if(status = 'failed') AS failed, count_if(status = 'pending')::varchar || ' pending, ' || count_if(status = 'failed')::varchar || ' failed' AS note FROM a WHERE deleted_at IS NULL AND published_at::date = date '2024-01-15'")
def day_note(spark, sf):
    return audits.pipeline_note(articles(spark, sf), "2024-01-15")


@query(long_sql.trimmed_tails())
def trimmed_tails(spark, sf):
    promo = F.concat("content_full", F.when(F.col("id") % 3 == 0, "\n\nSign up for our letter").otherwise(""))
    return audits.trimmed_tails(articles(spark, sf).withColumn("content_full", promo))


@query("SELECT id, title FROM a ORDER BY id DESC LIMIT 15 OFFSET 15")
def second_page_by_id(spark, sf):
    return reading.by_id(articles(spark, sf), 2, 15).select("id", "title")


@query("SELECT strftime(published_at, '%Y-%m-%d') AS date, count(*) AS n FROM rep GROUP BY 1 ORDER BY 1 DESC LIMIT 14")
def newest_issues(spark, sf):
    return audits.newest_issues(articles(spark, sf).filter(reportable()).groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("n")))


@query(f"SELECT r.id, {long_sql.filled('title_zh', 'title')} AS title, s.name AS source, status = 'failed' AS degraded FROM rep r JOIN s ON r.source_id = s.id WHERE published_at >= timestamp '2024-01-15' AND published_at < timestamp '2024-01-15 12:00:00'")
def rolling_report(spark, sf):
    a, s = articles(spark, sf), sources(spark, sf)
    items = reading.report_items(a, s, "2024-01-15", "2024-01-15 12:00:00")
    ids = a.select("id", "link")
    return items.join(ids, "link").select("id", "title", "source", "degraded")

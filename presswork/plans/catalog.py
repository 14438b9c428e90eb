"""The registered queries, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions import html as H
from presswork.functions import replies as R
from presswork.functions import text as T
from presswork.operators import analytics, enrichment, ingest, lifecycle, reading, rules, stories, usage
from presswork.operators.visibility import latest_first, reportable, since, ts, visible, with_source
from presswork.plans import long_sql
from presswork.plans.articles import ARTICLES_SQL, NOW, articles, sources, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DAYS = 30


def query(sql: str | None = None, raw: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its function's name; the SQL may use a, vis, rep, win and s unless ``raw``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            joined = sql.strip()
            if not raw:
                first = ARTICLES_SQL.rstrip()
                if joined.startswith("WITH RECURSIVE "):
                    first, joined = first.replace("WITH", "WITH RECURSIVE", 1), joined.replace("RECURSIVE ", "", 1)
                joined = first + (",\n" + joined[5:] if joined.startswith("WITH ") else "\n" + joined)
            ORACLES[f.__name__] = joined
        return f

    return add


def window(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).filter(reportable() & since(NOW, DAYS))


# Reports and analytics


@query(long_sql.daily_report())
def daily_report(spark, sf):
    return reading.report_items(articles(spark, sf), sources(spark, sf), "2024-01-15")


@query(long_sql.report_markdown())
def report_markdown(spark, sf):
    return reading.report_markdown(daily_report(spark, sf), "2024-01-15")


@query(long_sql.rss_items())
def rss_items(spark, sf):
    return reading.rss_items(daily_report(spark, sf))


TRANSLATED = f"""count_if({long_sql.trimmed("coalesce(content_zh, '')")} <> '' OR NOT {long_sql.english('content_full')})"""


@query(f"""SELECT count(*) AS total, count_if(starred = 1) AS starred, count(DISTINCT cast(published_at AS date)) AS active_days,
  count_if(status = 'processed') AS processed, {TRANSLATED} AS translated, round_even({TRANSLATED} / count(*) * 100, 1) AS translated_pct, coalesce(round_even(avg(score), 1), 0.0) AS avg_score,
  round_even(count_if(status = 'processed') / count(*) * 100, 1) AS processed_pct,
  round_even(count(*) / count(DISTINCT cast(published_at AS date)), 1) AS per_day FROM win""")
def kpi_summary(spark, sf):
    return analytics.kpis(window(spark, sf))


@query("""WITH days AS (SELECT unnest(generate_series(date '2024-01-02', date '2024-01-31', INTERVAL 1 DAY))::date AS day),
t AS (SELECT d.day, count(w.id) AS total, coalesce(sum(w.starred), 0)::bigint AS starred FROM days d LEFT JOIN win w ON w.published_at::date = d.day GROUP BY d.day)
SELECT strftime(day, '%Y-%m-%d') AS date, total, starred, round_even(total / max(total) OVER () * 100, 1) AS pct,
  (row_number() OVER (ORDER BY day DESC) - 1) % 4 = 0 AS show_label FROM t""")
def trend_zero_filled(spark, sf):
    return analytics.daily_series(window(spark, sf), NOW, DAYS)


@query("""SELECT category AS name, count(*) AS count, round_even(count(*) / (SELECT count(*) FROM win) * 100, 1) AS pct FROM win WHERE category <> '' GROUP BY category""")
def category_share(spark, sf):
    return analytics.distribution(window(spark, sf), "category")


@query("""SELECT name, count(*) AS count, round_even(count(*) / (SELECT count(*) FROM win) * 100, 1) AS pct
FROM win w JOIN s ON w.source_id = s.id GROUP BY name ORDER BY count DESC, name LIMIT 12""")
def source_top12(spark, sf):
    return analytics.distribution(with_source(window(spark, sf), sources(spark, sf)), "source", 12)


TAGS = "trim(unnest(string_split(tags, ',')))"


@query(f"""SELECT name, count(*) AS count FROM (SELECT {TAGS} AS name FROM win) GROUP BY name ORDER BY count DESC, name LIMIT 20""")
def tag_top20(spark, sf):
    return analytics.tag_counts(window(spark, sf))


@query("""WITH h AS (SELECT g.hour, count(w.id) AS n FROM (SELECT unnest(range(24))::int AS hour) g LEFT JOIN win w ON hour(w.published_at) = g.hour GROUP BY g.hour)
SELECT hour, n AS count, round_even(n / max(n) OVER () * 100, 0) AS pct FROM h""")
def hour_histogram(spark, sf):
    return analytics.hour_histogram(window(spark, sf))


BUCKET = "CASE WHEN score >= 85 AND score < 101 THEN '85+' WHEN score >= 70 AND score < 85 THEN '70-84' WHEN score >= 55 AND score < 70 THEN '55-69' WHEN score >= 40 AND score < 55 THEN '40-54' WHEN score >= 0 AND score < 40 THEN '<40' END"


@query(f"""SELECT b.label, count(w.id) AS count, round_even(count(w.id) / (SELECT count(score) FROM win) * 100, 1) AS pct
FROM (SELECT unnest(['85+', '70-84', '55-69', '40-54', '<40']) AS label) b LEFT JOIN (SELECT id, {BUCKET} AS label FROM win) w ON w.label = b.label GROUP BY b.label""")
def score_buckets(spark, sf):
    return analytics.score_buckets(window(spark, sf))


def _drill(name: str, value: str, sql: str) -> None:
    def run(spark, sf):
        rows = with_source(window(spark, sf), sources(spark, sf))
        return analytics.drill(rows, name, value).select("id", "title", "source", "score", "published_at")

    run.__name__ = f"drill_{name}"
    query(f"SELECT w.id, title, s.name AS source, score, published_at FROM win w JOIN s ON w.source_id = s.id WHERE {sql}")(run)


_drill("category", "model", "category = 'model'")
_drill("tag", "t3", "list_contains(list_transform(string_split(tags, ','), lambda x: trim(x)), 't3')")
_drill("starred", "", "starred = 1")
_drill("hour", "7", "hour(published_at) = 7")
_drill("score", "70-84", "score >= 70 AND score < 85")
_drill("source", "src3", "s.name = 'src3'")
_drill("date", "2024-01-15", "published_at::date = date '2024-01-15'")
_drill("all", "", "true")


@query("""SELECT source_id, count(id) AS articles, max(published_at) AS newest FROM a WHERE source_id IS NOT NULL GROUP BY source_id""")
def source_stats(spark, sf):
    return analytics.source_stats(articles(spark, sf))


@query("""SELECT s.id, s.name, coalesce(count(a.id), 0) AS articles, max(a.published_at) AS newest FROM s LEFT JOIN a ON a.source_id = s.id GROUP BY s.id, s.name""")
def source_rows(spark, sf):
    stats = analytics.source_stats(articles(spark, sf)).withColumnRenamed("source_id", "id")
    return sources(spark, sf).join(stats, "id", "left").select("id", "name", F.coalesce("articles", F.lit(0)).alias("articles"), "newest")


@query(f"""SELECT 'category' AS facet, category AS name, count(*) AS count FROM rep WHERE category <> '' GROUP BY category
UNION ALL (SELECT 'tag', name, count(*) AS count FROM (SELECT {TAGS} AS name FROM rep) GROUP BY name ORDER BY count DESC, name LIMIT 30)
UNION ALL (SELECT 'topic', name, count(*) AS count FROM (SELECT trim(unnest({long_sql.topics('topics')})) AS name FROM rep) WHERE name <> '' GROUP BY name ORDER BY name LIMIT 60)""")
def facet_options(spark, sf):
    return analytics.facets(articles(spark, sf).filter(reportable()))


@query("""SELECT d.date, count(r.id) AS count FROM (SELECT unnest(['2024-01-01', '2024-01-10', '2024-01-20', '2024-02-05']) AS date) d
LEFT JOIN rep r ON strftime(r.published_at, '%Y-%m-%d') = d.date GROUP BY d.date""")
def counts_by_day(spark, sf):
    return analytics.counts_by_day(articles(spark, sf).filter(reportable()), ["2024-01-01", "2024-01-10", "2024-01-20", "2024-02-05"])


@query("""SELECT count(*) AS articles, count_if(published_at::date = date '2024-01-15') AS today, count_if(published_at::date = date '2024-01-15' AND relevance = 1) AS today_relevant,
  count_if(published_at::date = date '2024-01-15' AND status = 'pending') AS today_pending, count_if(deleted_at IS NOT NULL) AS deleted,
  count_if(deleted_at::date = date '2024-01-15') AS deleted_today, count_if(starred = 1) AS starred, count_if(content_full <> '') AS with_text,
  count_if(status = 'failed' AND process_attempts >= 6) AS exhausted FROM a""")
def status_counters(spark, sf):
    return analytics.status_counters(articles(spark, sf), "2024-01-15")


# Lists, search, briefs


def found_in(term: str, full: bool = False) -> str:
    """SQL: the term is in any of the searched columns, whatever its case."""
    return "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), {long_sql.quoted(term.lower())})" for c in (reading.FULL if full else reading.META)) + ")"


@query(f"""SELECT id, title, score FROM rep WHERE {found_in("tion")} ORDER BY published_at DESC, id DESC LIMIT 50""")
def search_meta(spark, sf):
    return reading.search(articles(spark, sf), "tion").select("id", "title", "score")


@query(f"""SELECT id, title, score FROM rep WHERE {found_in("模型")} ORDER BY published_at DESC, id DESC LIMIT 40""")
def search_translations(spark, sf):
    return reading.search(articles(spark, sf), " 模型 ", limit=40).select("id", "title", "score")


@query(f"""WITH h AS (SELECT * FROM rep WHERE {found_in("license", True)} ORDER BY published_at DESC, id DESC LIMIT 100)
SELECT id, title, score FROM h WHERE category = 'model'""")
def search_full(spark, sf):
    return reading.search(articles(spark, sf), "license", "full", category="model", limit=100).select("id", "title", "score")


@query(r"""WITH w AS (SELECT id, CASE id % 5 WHEN 0 THEN 'up 100% a_b' WHEN 1 THEN 'up 1000 aXb' WHEN 2 THEN 'back\slash' END AS r FROM rep)
SELECT id, '100%' AS term FROM w WHERE contains(r, '100%') UNION ALL SELECT id, 'a_b' FROM w WHERE contains(r, 'a_b') UNION ALL SELECT id, 'backslash' FROM w WHERE contains(r, 'k\s')""")
def search_literal_wildcards(spark, sf):
    """No column of the tables has a wildcard of LIKE, so the reasons get some; the same words without them must not be found."""
    reason = F.when(F.col("id") % 5 == 0, "up 100% a_b").when(F.col("id") % 5 == 1, "up 1000 aXb").when(F.col("id") % 5 == 2, "back\\slash")
    rows = articles(spark, sf).filter(reportable()).withColumn("reason", reason)
    hits = [rows.filter(reading.matches(term)).select("id", F.lit(name).alias("term")) for term, name in (("100%", "100%"), ("A_b", "a_b"), ("k\\S", "backslash"))]
    return hits[0].unionByName(hits[1]).unionByName(hits[2])


@query(f"""WITH h AS (SELECT * FROM rep WHERE {found_in("th")})
SELECT category, count(*) AS count FROM h WHERE category <> '' GROUP BY category UNION ALL SELECT '_all', count(*) FROM h""")
def search_facets(spark, sf):
    return reading.search_facets(articles(spark, sf), "th")


@query(f"""WITH h AS (SELECT * FROM rep WHERE {found_in("the", True)} AND category = 'paper' AND list_contains(list_transform(string_split(tags, ','), lambda x: trim(x)), 't3'))
SELECT category, count(*) AS count FROM h GROUP BY category UNION ALL SELECT '_all', count(*) FROM h""")
def search_facets_filtered(spark, sf):
    return reading.search_facets(articles(spark, sf), "the", "full", category="paper", tag="T3")


@query("""SELECT 'three' AS list, id FROM (SELECT id FROM rep ORDER BY published_at DESC, id DESC LIMIT 3 OFFSET 2)""")
def limited_lists(spark, sf):
    """A limit of 0 and a blank term give no rows, other limits as many as there are."""
    rows = articles(spark, sf).filter(reportable())
    some = lambda limit, offset, name: reading.listed(rows, limit, offset).select(F.lit(name).alias("list"), "id")
    return some(0, 0, "none").unionByName(some(3, 2, "three")).unionByName(reading.search(rows, "  ").select(F.lit("blank").alias("list"), "id"))


@query("""SELECT id, title FROM rep ORDER BY published_at DESC, id DESC LIMIT 20 OFFSET 20""")
def paginate_filtered(spark, sf):
    return reading.page(articles(spark, sf).filter(reportable()), 2, 20).select("id", "title")


@query("""WITH o AS (SELECT category AS oc, list_transform(string_split(tags, ','), lambda x: trim(x)) AS ot FROM a WHERE id = 30),
r AS (SELECT rep.* FROM rep WHERE id <> 30 ORDER BY published_at DESC, id DESC LIMIT 120),
x AS (SELECT r.*, CASE WHEN category = oc THEN 2 ELSE 0 END + len(list_intersect(list_transform(string_split(tags, ','), lambda x: trim(x)), ot)) AS affinity FROM r, o)
SELECT id, affinity::int AS affinity, category, tags FROM x WHERE affinity > 0 ORDER BY affinity DESC, published_at DESC, id DESC LIMIT 6""")
def related_articles(spark, sf):
    return reading.related(articles(spark, sf), 30)


@query("""WITH d AS (SELECT DISTINCT published_at::date - 9 AS day FROM a WHERE id % 5 = 0 ORDER BY day DESC LIMIT 14)
SELECT strftime(coalesce(max(published_at)::date, date '2024-01-31'), '%Y-%m-%d') AS date FROM rep WHERE published_at < timestamp '2024-02-01' AND (published_at::date IN (SELECT day FROM d) OR published_at::date = date '2024-01-31')""")
def homepage_date(spark, sf):
    """The reports lag nine days behind, so that the newest one with articles is not yesterday's."""
    a = articles(spark, sf)
    reports = a.filter("id % 5 = 0").select(F.date_sub(F.to_date("published_at"), 9).alias("date"))
    return reading.homepage_date(a, reports, NOW)


@query("SELECT id, title FROM rep ORDER BY published_at DESC, id DESC LIMIT 7 OFFSET (SELECT 7 * greatest(0, least(1499, (count(*) - 1) // 7)) FROM rep)")
def deep_page(spark, sf):
    """Page 1,500 of 7 rows, or the last: found by counts of sorted partitions."""
    return reading.page(articles(spark, sf).filter(reportable()), 1500, 7).select("id", "title")


@query("""WITH p AS (SELECT * FROM rep WHERE published_at >= timestamp '2024-01-31' - INTERVAL 7 DAY AND published_at <= timestamp '2024-01-31' ORDER BY published_at DESC, id DESC LIMIT 400)
SELECT id, title, score, starred FROM p WHERE category IN ('model', 'paper', 'product') AND NOT contains(lower(concat_ws(' ', title, title_zh, summary, digest, digest_zh, brief_zh, reason)), '短讯')
ORDER BY starred DESC, coalesce(score, 0) DESC, published_at DESC, id DESC LIMIT 10""")
def brief_topn(spark, sf):
    return reading.brief(articles(spark, sf), NOW, days=7, categories=["model", "paper", "product"], exclude=["短讯"]).select("id", "title", "score", "starred")


SECTIONS = [
    {"name": "models", "top": 5, "where": {"categories": ["model"]}},
    {"name": "tagged", "top": 8, "where": {"tags": ["t1", "u2"]}},
    {"name": "words", "top": 4, "where": {"keywords": ["THE"], "exclude": ["licen"]}},
    {"name": "topics", "top": 6, "where": {"topics": ["主题2", "topic1"], "keywords": ["消息", "the"]}},
]
WORDS_SQL = "lower(concat_ws(' ', nullif(title, ''), nullif(title_zh, ''), nullif(summary, ''), nullif(digest, ''), nullif(digest_zh, ''), nullif(brief_zh, ''), nullif(reason, '')))"


SECTIONS_SQL = f"""WITH p AS (SELECT *, list_transform(string_split(tags, ','), lambda x: trim(x)) AS tl, {WORDS_SQL} AS words FROM rep WHERE published_at >= timestamp '2024-01-31' - INTERVAL 14 DAY AND published_at <= timestamp '2024-01-31' ORDER BY published_at DESC, id DESC LIMIT 400),
u AS (SELECT 0 AS no, 'models' AS section, 5 AS top, * FROM p WHERE category = 'model' UNION ALL SELECT 1, 'tagged', 8, * FROM p WHERE list_has_any(tl, ['t1', 'u2'])
  UNION ALL SELECT 2, 'words', 4, * FROM p WHERE contains(words, 'the') AND NOT contains(words, 'licen')
  UNION ALL SELECT 3, 'topics', 6, * FROM p WHERE list_has_any({long_sql.topics('topics')}, ['主题2', 'topic1']) AND (contains(words, '消息') OR contains(words, 'the'))),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY starred DESC, coalesce(score, 0) DESC, published_at DESC, id DESC) AS rank FROM u)
"""


@query(SECTIONS_SQL + "SELECT section, rank, id, title, score, starred FROM r WHERE rank <= top")
def brief_sections(spark, sf):
    return reading.brief_sections(articles(spark, sf), NOW, SECTIONS, days=14).select("section", "rank", "id", "title", "score", "starred")


ITEMS_SQL = (
    SECTIONS_SQL
    + ", shown AS (SELECT DISTINCT id, title, title_zh, brief_zh, digest_zh, digest, reason, summary, content_zh, content_full FROM r WHERE rank <= top), "
    + long_sql.brief_texts("shown")
    + f""", i AS (SELECT r.no, r.section, r.rank, r.id, {long_sql.trimmed(long_sql.filled('r.title_zh', 'r.title'))} AS title, said.brief, coalesce(s.name, 'unknown') AS source, coalesce(r.category, '') AS category, r.starred, r.link,
  strftime(r.published_at, '%Y-%m-%d %H:%M') AS published, row_number() OVER (PARTITION BY r.no ORDER BY r.rank) AS place FROM r JOIN said ON said.id = r.id LEFT JOIN s ON s.id = r.source_id WHERE r.rank <= r.top AND said.brief <> '')
"""
)


def section_items(spark, sf) -> DataFrame:
    return reading.brief_items(reading.brief_sections(articles(spark, sf), NOW, SECTIONS, days=14), sources(spark, sf))


@query(ITEMS_SQL + "SELECT section, rank, id, title, brief, source, category, starred, link, published FROM i")
def brief_items(spark, sf):
    return section_items(spark, sf).select("section", "rank", "id", "title", "brief", "source", "category", "starred", "link", "published")


@query(ITEMS_SQL + "SELECT '2024-01-31' AS date, no::int AS no, section AS name, place::int AS place, id, title, brief, (SELECT count(*) FROM i) AS article_count, (SELECT count(DISTINCT no) FROM i) AS section_count FROM i")
def brief_issues(spark, sf):
    """The day's issue written, read back and taken apart."""
    from presswork.sources import feeds
    from presswork.streaming import jobs

    folder = jobs.work_folder(spark)
    feeds.write_by_date(reading.brief_issue(section_items(spark, sf), "2024-01-31", "Today"), folder)
    seen = reading.issues_view(spark.read.parquet(folder)).select("date", "article_count", "section_count", F.explode("sections").alias("s"))
    rows = seen.select("date", "article_count", "section_count", "s.no", "s.name", F.explode("s.entries").alias("e"))
    return rows.select("date", "no", "name", "e.place", "e.id", "e.title", "e.brief", "article_count", "section_count")


@query(f"""WITH d AS ({long_sql.DAY}) SELECT title || ' (' || tags || ')' AS title, link, substr(summary || CASE WHEN degraded THEN ' (degraded)' ELSE '' END, 1, 600) AS content, published_at FROM d""")
def rss_document(spark, sf):
    """The day's feed written as XML and read again by the feed reader."""
    from presswork.sources import feeds
    from presswork.streaming import jobs

    folder = jobs.work_folder(spark)
    feeds.write_rss(reading.rss_channel(daily_report(spark, sf), "Daily", "https://news.example.com/", "The report of a day"), folder)
    return feeds.read_feeds(spark, folder).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


def _document(entry: str) -> str:
    return f", e AS (SELECT no, section, string_agg({entry}, chr(10) || chr(10) ORDER BY place) AS body FROM i GROUP BY no, section) SELECT '# Today' || chr(10) || chr(10) || string_agg(CASE WHEN (SELECT count(*) FROM e) > 1 THEN '## ' || section || chr(10) || chr(10) ELSE '' END || body, chr(10) || chr(10) ORDER BY no) || chr(10) AS text FROM e"


HEAD = "place::varchar || '. ' || CASE WHEN starred = 1 THEN '★ ' ELSE '' END || title"


@query(ITEMS_SQL + _document(f"concat_ws(chr(10), {HEAD}, brief, '—— ' || concat_ws(' · ', source, nullif(category, ''), published))"))
def brief_text_render(spark, sf):
    return reading.brief_text(section_items(spark, sf), "Today")


@query(ITEMS_SQL + _document(f"concat_ws(chr(10) || chr(10), '### ' || {HEAD}, brief, '- ' || concat_ws(' · ', source, nullif(category, ''), published, link))"))
def brief_markdown_render(spark, sf):
    return reading.brief_markdown(section_items(spark, sf), "Today")


@query("WITH " + long_sql.brief_texts("a") + " SELECT id, brief FROM said")
def brief_texts(spark, sf):
    """The ladder of briefs over all articles, so that every rung has rows."""
    return articles(spark, sf).select("id", reading.brief_of_row().alias("brief"))


@query(f"""WITH t AS (SELECT id, title, {long_sql.strip_html("content_full")} AS t FROM a), b AS (SELECT id, CASE WHEN length(t) >= 30 AND length({long_sql.trimmed("regexp_replace(t, " + long_sql.quoted(T.BOILERPLATE) + ", ' ', 'g')")}) >= 30 THEN t ELSE title END AS t FROM t),
c AS (SELECT id, {long_sql.trimmed("t")} AS t FROM b)
SELECT id, CASE WHEN length(t) <= 90 THEN t ELSE regexp_replace(substr(t, 1, 90), '{long_sql.BLANK}+$', '') || '…' END AS digest FROM c""")
def fallback_digests(spark, sf):
    return articles(spark, sf).select("id", T.fallback_digest(F.col("title"), F.col("content_full"), chars=90).alias("digest"))


@query(long_sql.story_cards())
def story_cards(spark, sf):
    return reading.cards(articles(spark, sf), sources(spark, sf), NOW)


@query("""SELECT id, strftime(published_at, '%Y-%m-%d') AS date_key, count(*) OVER (PARTITION BY published_at::date) AS items FROM rep""")
def cards_by_date(spark, sf):
    return reading.by_date(articles(spark, sf).filter(reportable()).withColumn("date_key", F.date_format("published_at", "yyyy-MM-dd")))


# Text


@query("""SELECT id, length(regexp_replace(substr(content_full, 1, 400), '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(substr(content_full, 1, 400), '[^A-Za-z]', '', 'g')) > 40 AS english FROM a""")
def lang_profile(spark, sf):
    body = F.col("content_full")
    return articles(spark, sf).select("id", T.latin_letters(body, 400).cast("long").alias("latin"), T.looks_english(body).alias("english"))


@query("""SELECT id, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS title_key FROM a""")
def normalize_title(spark, sf):
    return articles(spark, sf).select("id", T.normalize_title(F.col("title")).alias("title_key"))


@query("""SELECT id, array_to_string(list_transform(string_split_regex(replace(tags, ',', ';'), '[,;]'), lambda x: trim(x))[1:5], '|') AS wide,
  array_to_string(list_filter(list_transform(string_split(replace(tags, ',', ';'), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS narrow FROM a""")
def split_tags_two_ways(spark, sf):
    tags = F.replace("tags", F.lit(","), F.lit(";"))
    return articles(spark, sf).select("id", F.array_join(T.split_tags(tags), "|").alias("wide"), F.array_join(T.comma_tags(tags), "|").alias("narrow"))


@query("""SELECT id, length(trim(content_full)) >= 30 AND length(trim(regexp_replace(trim(content_full), '(?i)(submitted\\s+by|\\[link\\]|\\[comments\\]|comments|level\\s*\\d+|/u/[A-Za-z0-9_-]+|\\b\\d+\\s*(mo|yr|day|hour|min)s?\\s*ago\\b|\\bupvote\\b|\\bpermalink\\b|\\breport\\b)', ' ', 'g'))) >= 30 AS real FROM a""")
def real_body(spark, sf):
    return articles(spark, sf).select("id", T.is_real_body(F.col("content_full")).alias("real"))


@query("""SELECT id, greatest(1, round_even(len(regexp_extract_all(content_full, '[A-Za-z]+')) / 230, 0)::int) AS minutes FROM a""")
def reading_stats(spark, sf):
    return articles(spark, sf).select("id", T.reading_minutes(F.col("content_full")).alias("minutes"))


@query("""SELECT id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(substr(t, 1, 80)) || '…' END AS short FROM (SELECT id, trim(title) AS t FROM a)""")
def truncated_titles(spark, sf):
    return articles(spark, sf).select("id", T.truncate(F.col("title"), 80).alias("short"))


@query("""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace('## ' || title || chr(10) || '- **' || tags || '**', '(?m)^\\s*(?:#{1,6}\\s+|[-*+]\\s+|\\d+[.)]\\s*)', '', 'g'), '\\*\\*|__', '', 'g'), '[\\s\\x{00A0}]+', ' ', 'g')) AS plain FROM a""")
def strip_markdown(spark, sf):
    marked = F.concat(F.lit("## "), "title", F.lit("\n- **"), "tags", F.lit("**"))
    return articles(spark, sf).select("id", T.strip_markdown(marked).alias("plain"))


@query("""SELECT id, CASE WHEN regexp_matches(trim(u), '(?i)^https?:') THEN trim(u) ELSE '' END AS link, split_part(split_part(link0, '://', 2), '/', 1) AS host
FROM (SELECT id, link AS link0, CASE id % 4 WHEN 0 THEN ' ' || link || ' ' WHEN 1 THEN 'javascript:alert(1)' WHEN 2 THEN upper(link) ELSE '' END AS u FROM a)""")
def link_gate(spark, sf):
    raw = F.expr("case id % 4 when 0 then concat(' ', link, ' ') when 1 then 'javascript:alert(1)' when 2 then upper(link) else '' end")
    return articles(spark, sf).select("id", T.safe_link(raw).alias("link"), T.url_host(F.col("link")).alias("host"))


@query("""SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages""", raw=True)
def url_host(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))


@query("""SELECT id, list_count(list_filter(string_split(regexp_replace(content_full, '([。！？!?])', '\\1' || chr(10), 'g'), chr(10)), lambda p: length(trim(p, ' ' || chr(9) || chr(160))) >= 10)) > 0 AS untranslated FROM a""")
def untranslated_sentences(spark, sf):
    return articles(spark, sf).select("id", T.has_untranslated_sentence(F.col("content_full")).alias("untranslated"))


@query(r"""WITH o AS (SELECT o_orderkey, o_orderkey * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1237 ELSE 1000003 END AS n FROM orders)
SELECT o_orderkey, n, CASE WHEN n < 1000 THEN n::varchar WHEN n < 1000000 THEN regexp_replace(regexp_replace(printf('%.1f', (n + 50) // 100 / 10.0), '(\.\d*?)0+$', '\1'), '\.$', '') || 'K'
  WHEN n < 1000000000 THEN regexp_replace(regexp_replace(printf('%.2f', (n + 5000) // 10000 / 100.0), '(\.\d*?)0+$', '\1'), '\.$', '') || 'M'
  ELSE regexp_replace(regexp_replace(printf('%.2f', (n + 5000000) // 10000000 / 100.0), '(\.\d*?)0+$', '\1'), '\.$', '') || 'B' END AS short FROM o""", raw=True)
def compact_numbers(spark, sf):
    n = F.expr("o_orderkey * case o_orderkey % 3 when 0 then 1 when 1 then 1237 else 1000003 end").alias("n")
    return table(spark, sf, "orders").select("o_orderkey", n).select("o_orderkey", "n", T.compact_number(F.col("n")).alias("short"))


# Pages


@query(r"""SELECT page_id, len(list_filter(list_transform(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1),
  lambda x: length(trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g')))), lambda n: n >= 24)) AS long_paragraphs FROM pages""", raw=True)
def page_paragraphs(spark, sf):
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    plain = F.transform(blocks, lambda b: F.char_length(T.collapsed(F.regexp_replace(b, "<[^>]+>", " "))))
    return table(spark, sf, "pages").select("page_id", F.size(F.filter(plain, lambda n: n >= 24)).cast("long").alias("long_paragraphs"))


@query(long_sql.article_text(), raw=True)
def page_article_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.article_text(F.col("html")).alias("text"))


@query(long_sql.page_images(), raw=True)
def page_images(spark, sf):
    marked = F.concat("html", F.replace(F.lit(long_sql.IMAGES), F.lit("%s"), F.col("page_id").cast("string")))
    return table(spark, sf, "pages").select("page_id", F.array_join(H.images(marked, F.col("url"), limit=9), " ").alias("images"))


# Ingest and rules


def feed_items(spark, sf) -> DataFrame:
    at = F.expr("case when id % 29 = 0 then null when id % 31 = 0 then published_at + interval 40 days else published_at end")
    return articles(spark, sf).select("id", "source_id", F.col("id").alias("pos"), "title", "link", F.col("content_full").alias("content"), at.alias("published_at"))


ADMIT_SQL = """WITH f AS (SELECT id, source_id, CASE WHEN id % 29 = 0 THEN NULL WHEN id % 31 = 0 THEN published_at + INTERVAL 40 DAY ELSE published_at END AS p FROM a),
c AS (SELECT id, source_id, p IS NULL AS no_date, coalesce(p > timestamp '2024-01-31 06:00:00', false) AS future, CASE WHEN p > timestamp '2024-01-31 06:00:00' THEN timestamp '2024-01-31' ELSE p END AS p FROM f),
o AS (SELECT *, CASE WHEN coalesce(p < timestamp '2024-01-17', false) THEN 'stale' ELSE 'kept' END AS o1 FROM c),
r AS (SELECT *, CASE WHEN o1 = 'kept' AND row_number() OVER (PARTITION BY source_id, o1 ORDER BY id) > 10 THEN 'over_cap' ELSE o1 END AS outcome FROM o)
"""


@query(ADMIT_SQL + "SELECT id, outcome, no_date, future FROM r")
def admit_gates(spark, sf):
    return ingest.admit(feed_items(spark, sf), NOW, max_items=10).select("id", "outcome", "no_date", "future")


@query(ADMIT_SQL + """SELECT source_id, count(*) AS fetched, count_if(outcome = 'kept') AS kept, count_if(outcome = 'stale') AS stale, 0::bigint AS no_content, count_if(outcome = 'over_cap') AS over_cap,
  count_if(no_date) AS no_date, count_if(future) AS future FROM r GROUP BY source_id""")
def ingest_stats(spark, sf):
    return ingest.run_stats(ingest.admit(feed_items(spark, sf), NOW, max_items=10))


@query("""WITH f AS (SELECT id, title, CASE WHEN id % 3 = 0 THEN 'https://x.example.com/' || (id // 9)::varchar ELSE link END AS link FROM a),
k AS (SELECT link FROM a WHERE published_at < timestamp '2024-01-10'), g AS (SELECT link, min(id) AS id FROM f GROUP BY link) SELECT g.link, g.id FROM g WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.link = g.link)""")
def exact_dedup(spark, sf):
    a = articles(spark, sf)
    items = a.select("id", "title", F.col("id").alias("pos"), F.expr("case when id % 3 = 0 then concat('https://x.example.com/', cast(id div 9 as string)) else link end").alias("link"))
    return ingest.new_by_link(items, a.filter(F.col("published_at") < ts("2024-01-10")).select("link")).select("link", "id")


@query()
def title_fuzzy_dedup(spark, sf):
    """All articles against the 500 newest titles. SQL has no such ratio; a test compares with all pairs of rows."""
    a = articles(spark, sf).select("id", "title")
    return ingest.title_duplicates(a, a)


RUN_LINK = "CASE WHEN id % 11 = 0 THEN 'ftp://x' WHEN id % 3 = 0 THEN 'https://x.example.com/' || (id // 9)::varchar ELSE link END AS link"
RUN_SQL = ADMIT_SQL.rstrip() + f""", i AS (SELECT id, title, content_full, {RUN_LINK} FROM a),
u AS (SELECT i.id, i.link FROM i JOIN r ON r.id = i.id WHERE r.outcome = 'kept' AND regexp_matches(i.link, '(?i)^https?:') AND trim(i.title) <> ''),
known AS (SELECT link FROM a WHERE published_at < timestamp '2024-01-20'),
fr AS (SELECT min(id) AS id FROM u WHERE link NOT IN (SELECT link FROM known) GROUP BY link),
st AS (SELECT r.id, r.source_id, CASE WHEN outcome <> 'kept' THEN outcome WHEN u.id IS NULL THEN 'bad_link' WHEN fr.id IS NULL THEN 'duplicated' WHEN regexp_matches(i.title || chr(10) || i.content_full, '(?i)(^|[^A-Za-z0-9])license($|[^A-Za-z0-9])') THEN 'blocked' ELSE 'new' END AS outcome
  FROM r JOIN i ON i.id = r.id LEFT JOIN u ON u.id = r.id LEFT JOIN fr ON fr.id = r.id)
"""


def settled_run(spark, sf) -> DataFrame:
    a = articles(spark, sf)
    links = F.expr("case when id % 11 = 0 then 'ftp://x' when id % 3 = 0 then concat('https://x.example.com/', cast(id div 9 as string)) else link end")
    admitted = ingest.admit(feed_items(spark, sf).withColumn("link", links), NOW, max_items=10)
    return ingest.settle_kept(admitted, a.filter(F.col("published_at") < ts("2024-01-20")).select("id", "link", "title"), [(1, "license")], window=0)


@query(RUN_SQL + "SELECT id, outcome FROM st")
def run_outcomes(spark, sf):
    """Without the comparison of titles, which SQL has no ratio for."""
    return settled_run(spark, sf).select("id", "outcome")


@query(RUN_SQL + """SELECT q.id AS source_id, CASE WHEN count(st.id) = 0 THEN 'empty' ELSE 'ok' END AS status, count(st.id) AS fetched, coalesce(count_if(outcome = 'new'), 0) AS new, coalesce(count_if(outcome = 'duplicated'), 0) AS duplicated, coalesce(count_if(outcome = 'blocked'), 0) AS blocked,
  coalesce(count_if(outcome = 'bad_link'), 0) AS bad_link, coalesce(count_if(outcome = 'stale'), 0) AS stale, 0::bigint AS no_content, coalesce(count_if(outcome = 'over_cap'), 0) AS over_cap FROM (SELECT id FROM s UNION ALL SELECT 9999) q LEFT JOIN st ON st.source_id = q.id GROUP BY q.id""")
def run_report(spark, sf):
    extra = spark.createDataFrame([(9999, "silent")], "id int, name string")
    return ingest.run_report(settled_run(spark, sf), sources(spark, sf).unionByName(extra))


@query(ORACLES["run_report"], raw=True)
def run_report_observed(spark, sf):
    """The same report from what was observed while the rows were written."""
    from presswork.streaming import jobs

    extra = spark.createDataFrame([(9999, "silent")], "id int, name string")
    rows, seen = ingest.observed_outcomes(settled_run(spark, sf))
    rows.write.parquet(jobs.work_folder(spark))
    return ingest.observed_report(seen, sources(spark, sf).unionByName(extra))


@query("""SELECT id, url FROM (SELECT id, name AS url FROM s WHERE id % 2 = 0 UNION ALL SELECT id + 1000000, name FROM s WHERE id % 3 > 0 AND name NOT IN (SELECT name FROM s WHERE id % 2 = 0))""")
def seed_sources(spark, sf):
    s = sources(spark, sf).select("id", F.col("name").alias("url"))
    return ingest.seed(s.filter("id % 3 > 0").withColumn("id", F.col("id") + 1_000_000), s.filter("id % 2 = 0"))


BLOCK, STAR = [(1, "license"), (2, "moron"), (3, "第1")], [(10, "the"), (11, "tion"), (12, "and"), (13, "三件事")]


def _first_rule(rules_: list[tuple[int, str]]) -> str:
    latin = lambda w: f"'(?i)(^|[^A-Za-z0-9]){w}($|[^A-Za-z0-9])'" if w.isascii() else f"'(?i){w}'"
    return "CASE " + " ".join(f"WHEN regexp_matches(t, {latin(w)}) THEN {n}" for n, w in rules_) + " END"


RULES_SQL = f"""WITH x AS (SELECT *, deleted_at IS NULL AND starred = 0 AND content_full IS NOT NULL AS open, concat_ws(chr(10), {", ".join(f"nullif({c}, '')" for c in rules.SEARCHED if c != "title_en")}) AS t FROM a),
y AS (SELECT *, CASE WHEN open THEN {_first_rule(BLOCK)} END AS blocked_by FROM x),
z AS (SELECT *, CASE WHEN open AND blocked_by IS NULL THEN {_first_rule(STAR)} END AS starred_by FROM y)
"""


@query(RULES_SQL + "SELECT id, blocked_by, starred_by FROM z")
def keyword_rules(spark, sf):
    return rules.apply_rules(articles(spark, sf), BLOCK, STAR).select("id", "blocked_by", "starred_by")


@query(RULES_SQL + """SELECT id, CASE WHEN blocked_by IS NOT NULL THEN timestamp '2024-01-31' ELSE deleted_at END AS deleted_at, CASE blocked_by WHEN 1 THEN 'blocked: license' WHEN 2 THEN 'blocked: moron' WHEN 3 THEN 'blocked: 第1' END AS degraded_reason,
  CASE WHEN starred_by IS NOT NULL THEN 1 ELSE starred END AS starred FROM z""")
def rule_effects(spark, sf):
    applied = rules.apply_rules(articles(spark, sf), BLOCK, STAR)
    return rules.carried_out(applied, NOW).select("id", "deleted_at", "degraded_reason", "starred")


@query(RULES_SQL + "SELECT r AS rule_id, count(*) AS hits FROM (SELECT unnest([blocked_by, starred_by]) AS r FROM z) WHERE r IS NOT NULL GROUP BY r")
def rule_hits(spark, sf):
    return rules.hit_counts(rules.apply_rules(articles(spark, sf), BLOCK, STAR))


def rule_table(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("keyword"), F.expr("case when s_suppkey % 3 = 0 then 'block' else 'star' end").alias("kind"), F.expr("cast(s_suppkey % 4 <> 0 as int)").alias("enabled"), F.expr("case when s_suppkey % 7 <> 0 then s_suppkey * 17 % 101 end").alias("hits"))


RULE_TABLE_SQL = "WITH r AS (SELECT s_suppkey AS id, s_name AS keyword, CASE WHEN s_suppkey % 3 = 0 THEN 'block' ELSE 'star' END AS kind, (s_suppkey % 4 <> 0)::int AS enabled, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey * 17 % 101 END AS hits FROM supplier) "


@query(RULE_TABLE_SQL + "SELECT kind, count(*) AS rules, count_if(enabled = 1) AS enabled, coalesce(sum(hits), 0)::bigint AS hits FROM r GROUP BY kind", raw=True)
def rule_stats(spark, sf):
    return rules.rule_stats(rule_table(spark, sf))


@query(RULES_SQL + """, r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey * 17 % 101 END AS hits FROM supplier), h AS (SELECT r AS id, count(*) AS n FROM (SELECT unnest([blocked_by, starred_by]) AS r FROM z) WHERE r IS NOT NULL GROUP BY r)
SELECT r.id, coalesce(r.hits, 0) + coalesce(h.n, 0) AS hits FROM r LEFT JOIN h ON h.id = r.id""")
def rule_hits_added(spark, sf):
    return rules.counted(rule_table(spark, sf), rules.apply_rules(articles(spark, sf), BLOCK, STAR)).select("id", "hits")


@query("SELECT s_suppkey AS id, s_name AS keyword FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0", raw=True)
def loaded_rules(spark, sf):
    return rules.load_rules(rule_table(spark, sf), "star")


TABLE_RULES_SQL = """WITH r AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS keyword, CASE WHEN p_partkey % 5 = 0 THEN 'block' ELSE 'star' END AS kind FROM part
  UNION ALL SELECT 1000000 + d.doc_id, lower(split_part(text, ' ', 1)), 'star' FROM documents d WHERE doc_id % 9 = 0 AND regexp_matches(split_part(text, ' ', 1), '^[A-Za-z]+$')
  UNION ALL SELECT 2000000 + d.doc_id, split_part(split_part(text, chr(10), 1), ' ', 2), 'block' FROM documents d WHERE doc_id % 50 = 0 AND regexp_matches(split_part(split_part(text, chr(10), 1), ' ', 2), '^[A-Za-z]{9,}$')),
k AS (SELECT kind, lower(keyword) AS word, min(id) AS id FROM r GROUP BY 1, 2),
w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(concat_ws(chr(10), nullif(title, ''), nullif(title_zh, ''), nullif(summary, ''), nullif(digest, ''), nullif(digest_zh, ''), nullif(content_full, ''), nullif(content_zh, ''))), '[a-z0-9]+')) AS word FROM a WHERE deleted_at IS NULL AND starred = 0 AND content_full IS NOT NULL),
h AS (SELECT w.id, min(k.id) FILTER (WHERE kind = 'block') AS b, min(k.id) FILTER (WHERE kind = 'star') AS s FROM w JOIN k USING (word) GROUP BY w.id)
SELECT a.id, h.b AS blocked_by, CASE WHEN h.b IS NULL THEN h.s END AS starred_by FROM a LEFT JOIN h ON h.id = a.id"""


def many_rules(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Rules as data: words of part names and of the documents' own texts, more of them with more rows."""
    docs, word = table(spark, sf, "documents"), lambda k: F.split_part(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), F.lit(" "), F.lit(k))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("keyword"))
    own = docs.select("doc_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("keyword")).filter("doc_id % 9 = 0").filter(F.col("keyword").rlike("^[A-Za-z]+$"))
    second = docs.filter("doc_id % 50 = 0").select("doc_id", word(2).alias("keyword")).filter(F.col("keyword").rlike("^[A-Za-z]{9,}$"))
    block = parts.filter("id % 5 = 0").unionByName(second.select((F.col("doc_id") + 2_000_000).alias("id"), "keyword"))
    return block, parts.filter("id % 5 <> 0").unionByName(own.select((F.col("doc_id") + 1_000_000).alias("id"), F.lower("keyword").alias("keyword")))


@query(TABLE_RULES_SQL)
def keyword_rules_of_tables(spark, sf):
    """Some hundred rules and more from tables, in one pass over the texts."""
    return rules.apply_rules(articles(spark, sf), *many_rules(spark, sf)).select("id", "blocked_by", "starred_by")


@query(TABLE_RULES_SQL)
def keyword_rules_by_join(spark, sf):
    """The same where the rules are too many for a broadcast."""
    return rules.apply_rules(articles(spark, sf), *many_rules(spark, sf), broadcast_bytes=0).select("id", "blocked_by", "starred_by")


@query(RULE_TABLE_SQL.rstrip() + """, m AS (SELECT count_if(deleted_at IS NOT NULL) AS blocked_articles, count_if(starred = 1 AND deleted_at IS NULL) AS starred_articles FROM a)
SELECT (SELECT count_if(kind = 'block') FROM r) AS block_rules, (SELECT count_if(kind = 'star') FROM r) AS star_rules, (SELECT coalesce(sum(hits), 0)::bigint FROM r) AS total_hits, blocked_articles, starred_articles FROM m""")
def rule_totals(spark, sf):
    return rules.rule_totals(rule_table(spark, sf), articles(spark, sf))


@query(RULE_TABLE_SQL + "SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY hits DESC NULLS LAST, id DESC) AS place FROM r", raw=True)
def rule_lists(spark, sf):
    return rules.rule_lists(rule_table(spark, sf)).select("id", "kind", "place")


@query(RULE_TABLE_SQL + "SELECT id, CASE WHEN id IN (1, 4, 5) THEN 1 - enabled ELSE enabled END AS enabled FROM r WHERE id NOT IN (2, 3)", raw=True)
def managed_rules(spark, sf):
    return rules.delete_rules(rules.toggle_rules(rule_table(spark, sf), [1, 4, 5]), [2, 3]).select("id", "enabled")


@query(RULE_TABLE_SQL + "SELECT id, keyword, hits FROM r WHERE kind = 'star' AND enabled = 1 ORDER BY hits DESC NULLS LAST, id DESC LIMIT 8", raw=True)
def star_rules_top8(spark, sf):
    return rules.top_rules(rule_table(spark, sf)).select("id", "keyword", "hits")


# Stories


CLASSES_SQL = f"""WITH w AS (SELECT id, {long_sql.story_words(long_sql.STORY_TITLE)} AS ws FROM vis WHERE relevance = 1),
k AS (SELECT min(id) AS id, ws FROM w GROUP BY ws)
"""


@query(CLASSES_SQL + """, e AS (SELECT id, unnest(ws) AS word FROM k WHERE len(ws) >= 2), p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM e x JOIN e y ON x.word = y.word AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT p.a, p.b, shared::int AS shared, shared / least(len(x.ws), len(y.ws)) AS title_overlap FROM p JOIN k x ON x.id = p.a JOIN k y ON y.id = p.b WHERE shared / least(len(x.ws), len(y.ws)) >= 0.25""")
def dup_pairs(spark, sf):
    return stories.title_pairs(articles(spark, sf).filter(visible() & (F.col("relevance") == 1)))


@query(CLASSES_SQL + "SELECT w.id, k.id AS class_id FROM w JOIN k ON w.ws = k.ws")
def title_classes(spark, sf):
    return stories.title_classes(articles(spark, sf).filter(visible() & (F.col("relevance") == 1))).select("id", "class_id")


@query(long_sql.merge_candidates())
def merge_candidates(spark, sf):
    return stories.ranked_pairs(stories.candidates(articles(spark, sf), NOW, days=30))


@query()
def merge_stories(spark, sf):
    """Which article keeps a story depends on the pairs before it, so SQL can't say it; a test replays the rule in Python."""
    return stories.merge(stories.candidates(articles(spark, sf), NOW, days=30), lambda a, b: True)


@query("""SELECT c.id, CASE WHEN p.id IS NULL OR coalesce(p.relevance <> 1, false) THEN NULL ELSE c.duplicate_of END AS duplicate_of, p.id IS NULL OR coalesce(p.relevance <> 1, false) AS repaired
FROM a c LEFT JOIN a p ON c.duplicate_of = p.id WHERE c.duplicate_of IS NOT NULL""")
def repair_dup_links(spark, sf):
    return stories.repair_links(articles(spark, sf))


@query("""SELECT p.id AS primary_id, c.id, c.title FROM a c JOIN a p ON c.duplicate_of = p.id WHERE c.deleted_at IS NULL""")
def duplicates_of(spark, sf):
    return stories.duplicates_of(articles(spark, sf))


def chained(a: DataFrame) -> DataFrame:
    """Longer chains than the view has: every third article points back by three."""
    return a.withColumn("duplicate_of", F.expr("case when id % 12 <> 0 and id % 3 = 0 then id - 3 when id % 23 = 22 then 1000000 end"))


@query("""WITH RECURSIVE c AS (SELECT id, CASE WHEN id % 12 <> 0 AND id % 3 = 0 THEN id - 3 WHEN id % 23 = 22 THEN 1000000 END AS nxt, deleted_at IS NOT NULL AS gone FROM a),
w AS (SELECT id AS start, id AS at, 0 AS hops FROM c WHERE nxt IS NOT NULL UNION ALL SELECT w.start, n.id, w.hops + 1 FROM w JOIN c ON c.id = w.at JOIN c n ON n.id = c.nxt AND NOT n.gone WHERE w.hops < 16)
SELECT c.id, max(CASE WHEN e.nxt IS NULL AND w.hops > 0 THEN w.at END) AS primary_id FROM c JOIN w ON w.start = c.id JOIN c e ON e.id = w.at GROUP BY c.id""")
def primary_chain(spark, sf):
    return stories.primary_of(chained(articles(spark, sf)))


@query("""WITH h AS (SELECT source_id, trim(split_part(content_full, chr(10) || chr(10), 1)) AS head FROM a)
SELECT source_id, head, count(*) AS members FROM h WHERE length(head) >= 20 GROUP BY source_id, head HAVING count(*) >= 3""")
def shared_openings(spark, sf):
    return stories.shared_openings(articles(spark, sf))


@query(long_sql.strip_openings())
def strip_shared_openings(spark, sf):
    return stories.strip_shared_openings(articles(spark, sf)).filter("stripped > 0").select("id", "stripped", F.char_length("content_full").alias("chars"))


@query(long_sql.tail_trim())
def tail_trim(spark, sf):
    promo = F.expr(r"case when id % 3 = 0 then concat(content_full, '\n\nSign up for our letter\n\nFollow us on the net') else content_full end")
    return articles(spark, sf).select("id", F.char_length(promo).alias("before"), F.char_length(T.trim_tail(promo)).alias("after"))


# Lifecycle and usage


def stored(spark, sf) -> DataFrame:
    return articles(spark, sf).withColumns({"created_at": F.expr("published_at + make_dt_interval(cast(id % 5 as int) - 1)"), "process_attempts": F.expr("cast(id % 8 as int)"), "process_last_at": F.expr("case when id % 4 <> 0 then timestamp_ntz'2024-01-31 00:00:00' - make_dt_interval(0, 0, cast(id % 90 as int)) end")})


STORED_SQL = "WITH st AS (SELECT *, published_at + to_days((id % 5)::int - 1) AS created_at, (id % 8)::int AS process_attempts, CASE WHEN id % 4 <> 0 THEN timestamp '2024-01-31' - to_minutes(id % 90) END AS process_last_at FROM a)\n"


@query(STORED_SQL + """, k AS (SELECT * FROM st WHERE created_at >= timestamp '2024-01-31' - INTERVAL 10 DAY)
SELECT k.id, CASE WHEN EXISTS (SELECT 1 FROM k p WHERE p.id = k.duplicate_of) THEN k.duplicate_of END AS duplicate_of FROM k""")
def retention_cleanup(spark, sf):
    return lifecycle.retain(stored(spark, sf), NOW, 10).select("id", "duplicate_of")


@query(STORED_SQL + """, n AS (SELECT * FROM st WHERE status = 'failed' AND process_attempts < 6 ORDER BY published_at DESC, id DESC LIMIT 200)
SELECT id, process_attempts FROM n WHERE process_last_at IS NULL OR process_last_at <= timestamp '2024-01-31' - INTERVAL 30 MINUTE""")
def retry_queue(spark, sf):
    return lifecycle.retry_queue(stored(spark, sf), NOW).select("id", "process_attempts")


RETRY_SQL = STORED_SQL.rstrip() + """, n AS (SELECT * FROM st WHERE status = 'failed' AND process_attempts < 6 ORDER BY published_at DESC, id DESC LIMIT 200),
q AS (SELECT id FROM n WHERE process_last_at IS NULL OR process_last_at <= timestamp '2024-01-31' - INTERVAL 30 MINUTE)
"""


@query(RETRY_SQL + "SELECT id, CASE WHEN id IN (SELECT id FROM q) THEN 'pending' ELSE status END AS status FROM st")
def requeued(spark, sf):
    return lifecycle.requeue(stored(spark, sf), NOW).select("id", "status")


@query(RETRY_SQL + "SELECT (SELECT count(*) FROM n) AS candidates, (SELECT count(*) FROM q) AS requeued, count_if(status = 'failed' AND process_attempts >= 6) AS exhausted FROM st")
def retry_stats(spark, sf):
    return lifecycle.retry_stats(stored(spark, sf), NOW)


@query("SELECT strftime(published_at, '%Y-%m-%d') AS date, count(*) AS article_count FROM rep WHERE strftime(published_at, '%Y-%m-%d') >= '2024-01-21' GROUP BY 1")
def report_retention(spark, sf):
    reports = articles(spark, sf).filter(reportable()).groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("article_count"))
    return lifecycle.retain_reports(reports, NOW, 10)


@query("SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE deleted_at END AS deleted_at FROM a")
def restored(spark, sf):
    a = articles(spark, sf)
    return lifecycle.restore(a, a.filter("id % 4 = 0").select("id")).select("id", "deleted_at")


@query(STORED_SQL + "SELECT id, process_attempts FROM st WHERE status = 'pending' AND deleted_at IS NULL ORDER BY process_attempts, published_at DESC, id DESC LIMIT 20")
def work_queue(spark, sf):
    return lifecycle.work_queue(stored(spark, sf)).select("id", "process_attempts")


@query(STORED_SQL + "SELECT id, CASE WHEN relevance = 0 THEN NULL ELSE score END AS score, least(published_at, created_at, timestamp '2024-01-31') AS published_at FROM st")
def repair_rows(spark, sf):
    return lifecycle.repair_rows(stored(spark, sf), NOW).select("id", "score", "published_at")


@query("SELECT id, CASE WHEN deleted_at IS NULL AND id % 10 = 0 THEN timestamp '2024-01-31' ELSE deleted_at END AS deleted_at FROM a")
def soft_delete(spark, sf):
    a = articles(spark, sf)
    return lifecycle.soft_delete(a, a.filter("id % 10 = 0").select("id"), NOW).select("id", "deleted_at")


@query("SELECT id FROM a WHERE NOT (deleted_at IS NOT NULL AND id % 2 = 0)")
def purge_trash(spark, sf):
    a = articles(spark, sf)
    return lifecycle.purge(a, a.filter("id % 2 = 0").select("id")).select("id")


@query("""WITH l AS (SELECT strftime(published_at, '%Y-%m-%d') AS date, count(*) AS live FROM rep WHERE published_at >= timestamp '2024-01-18' GROUP BY 1),
p AS (SELECT date, live + (substr(date, 10, 1)::int % 2) AS article_count FROM l WHERE substr(date, 9, 2) <> '20')
SELECT l.date, live FROM l LEFT JOIN p ON l.date = p.date WHERE p.article_count IS NULL OR p.article_count <> live""")
def backfill_report_days(spark, sf):
    a = articles(spark, sf)
    live = a.filter(reportable()).groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("live"))
    reports = live.filter("substr(date, 9, 2) <> '20'").select("date", F.expr("live + cast(substr(date, 10, 1) as int) % 2").alias("article_count"))
    return lifecycle.reports_to_backfill(a, reports, NOW, 14)


def usage_log(spark, sf) -> DataFrame:
    """Events as a log of model calls."""
    k, v = F.get_json_object("props", "$.k").cast("long"), F.floor("value").cast("long")
    return table(spark, sf, "events").select(F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), (k * 10).alias("input_tokens"), v.alias("output_tokens"), (k * 3).alias("cached_tokens"), F.expr("cast(floor(value / 2) as bigint)").alias("reasoning_tokens"), (k * 10 + v).alias("total_tokens"))


USAGE_SQL = """WITH u AS (SELECT ts AS "at", event_id AS seq, event_type <> 'error' AS ok, k * 10 AS i, floor(value)::bigint AS o, k * 3 AS c, floor(value / 2)::bigint AS r, k * 10 + floor(value)::bigint AS t
  FROM (SELECT *, json_extract_string(props, '$.k')::bigint AS k FROM events))
"""


@query(USAGE_SQL + """SELECT strftime("at", '%Y-%m-%d') AS day, count(*) AS calls, count_if(ok) AS ok_calls, count_if(NOT ok) AS failed_calls, sum(i)::bigint AS input_tokens, sum(o)::bigint AS output_tokens, sum(c)::bigint AS cached_tokens,
  sum(r)::bigint AS reasoning_tokens, sum(t)::bigint AS total_tokens, sum(i - least(c, i) + o + greatest(0, r - o))::bigint AS charged, round_even(sum(c) / sum(i) * 100, 1) AS cache_pct FROM u GROUP BY 1 ORDER BY 1 DESC LIMIT 14""", raw=True)
def usage_by_day(spark, sf):
    return usage.by_day(usage_log(spark, sf))


@query(USAGE_SQL + """SELECT count(*) AS calls, count_if(ok) AS ok_calls, count_if(NOT ok) AS failed_calls, sum(i)::bigint AS input_tokens, sum(o)::bigint AS output_tokens, sum(c)::bigint AS cached_tokens, sum(r)::bigint AS reasoning_tokens,
  sum(t)::bigint AS total_tokens, sum(i - least(c, i) + o + greatest(0, r - o))::bigint AS charged, round_even(sum(c) / sum(i) * 100, 1) AS cache_pct FROM u""", raw=True)
def usage_totals(spark, sf):
    return usage.totals(usage_log(spark, sf))


@query(USAGE_SQL + "SELECT seq, \"at\", ok FROM u ORDER BY \"at\" DESC, seq DESC LIMIT 20", raw=True)
def usage_newest(spark, sf):
    return usage.newest(usage_log(spark, sf)).select("seq", "at", "ok")


# Model replies


#: What a model may answer, {n} being a number, and what that says: relevant, and whether the number is the score.
REPLIES = [
    ("yes {n}", True, True), ("Sure! Here it is: yes {n}.", True, False), ("no {n}", False, False), ("{n} yes", True, True), ("yes 2024 coverage {n}", True, True),
    ("Yes. Confidence: 0.9", True, False), ("irrelevant", False, False), ("nothing", False, False), ("yes 1,200 words {n}", True, True), ("是 {n}", True, True),
]


@query(f"""SELECT doc_id AS id, replace(reply, '{{n}}', (10 + doc_id % 90)::varchar) AS reply, relevant, CASE WHEN scored THEN (10 + doc_id % 90)::int END AS score FROM documents
JOIN (VALUES {", ".join(f"({k}, '{r}', {yes}, {scored})" for k, (r, yes, scored) in enumerate(REPLIES))}) v(k, reply, relevant, scored) ON k = doc_id % {len(REPLIES)}""", raw=True)
def parse_relevance_cases(spark, sf):
    """Every document gets one of the replies, with a number of its own; the SQL knows what each of them says."""
    patterns = F.broadcast(spark.createDataFrame([(k, r) for k, (r, _, _) in enumerate(REPLIES)], "k int, reply string"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % len(REPLIES)).alias("k")).join(patterns, "k")
    reply = F.replace("reply", F.lit("{n}"), (10 + F.col("id") % 90).cast("string"))
    return docs.select("id", reply.alias("reply")).withColumn("p", R.parse_relevance(F.col("reply"))).select("id", "reply", "p.relevant", "p.score")


@query(rf"""WITH x AS (SELECT id, content_full || CASE WHEN id % 2 = 0 THEN chr(10) || '  ' || chr(10) || chr(10) || ' end ' ELSE chr(10) || chr(10) || ' ' END AS t FROM a)
SELECT id, len(list_filter(string_split_regex(t, '\n\s*\n'), lambda v: {long_sql.trimmed('v')} <> '')) AS paragraphs FROM x""")
def paragraph_counts(spark, sf):
    """With blank blocks at the ends, which don't count."""
    t = F.concat("content_full", F.when(F.col("id") % 2 == 0, "\n  \n\n end ").otherwise("\n\n "))
    return articles(spark, sf).select("id", F.size(T.paragraphs(t)).cast("long").alias("paragraphs"))


@query(long_sql.chunk_plan())
def chunk_plan(spark, sf):
    c = R.chunks(T.paragraphs(F.col("content_full")))
    planned = articles(spark, sf).select("id", c.alias("c"))
    return planned.select("id", F.size("c").cast("long").alias("chunks"), F.array_join(R.batches(F.transform("c", F.char_length)).cast("array<string>"), " ").alias("batch_of"))


@query(long_sql.enrichment())
def enrichment_stub(spark, sf):
    return enrichment.judged(articles(spark, sf).filter("status = 'pending'"), lambda prompt: f"yes {len(prompt) % 101}" if len(prompt) % 3 else "no")


# Streams


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""", raw=True)
def stream_daily_counts(spark, sf):
    from presswork.streaming import jobs

    return jobs.daily_counts(spark, sf)


@query("""WITH d AS (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT strftime(d, '%Y-%m-%d') AS day, event_type, n FROM d WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""", raw=True)
def stream_final_days(spark, sf):
    from presswork.streaming import jobs

    return jobs.final_days(spark, sf)


@query("""SELECT link, min(id) AS id FROM (SELECT id, 'https://x.example.com/' || (id // 4)::varchar AS link FROM a) GROUP BY link""")
def stream_first_links(spark, sf):
    from presswork.streaming import jobs

    return jobs.first_links(spark, sf)

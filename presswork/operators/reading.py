"""Reading paths: reports, search, briefs, related articles, pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions import text as T
from presswork.operators.settling import settled
from presswork.operators.visibility import between, in_day, latest_first, reportable, ts, with_source


def ranked_in_day(day: DataFrame) -> DataFrame:
    """``day`` (rows of one day) with ``rank``, newest first. Rows are ranked in their minute and moved by the number of rows
    in later minutes, of which a day has 1,440 at most; so no task ranks a whole day."""
    minute = (F.hour("published_at") * 60 + F.minute("published_at")).alias("__minute")
    counts = day.groupBy(minute).agg(F.count("*").alias("n"))
    later = counts.select("__minute", (F.sum("n").over(Window.orderBy(F.desc("__minute"))) - F.col("n")).alias("__later"))
    own = F.row_number().over(Window.partitionBy("__minute").orderBy(*latest_first()))
    return day.withColumn("__minute", minute).withColumn("rank", own).join(F.broadcast(later), "__minute").withColumn("rank", F.col("rank") + F.col("__later")).drop("__minute", "__later")


def shown_title(unknown: str = "") -> Column:
    """The Chinese title where there is one, else the original."""
    return T.first_nonempty(F.col("title_zh"), F.col("title"), F.lit(unknown))


def report_items(articles: DataFrame, sources: DataFrame, date: str, until: str | None = None, no_summary: str = "(no summary)", no_tags: str = "(no tags)") -> DataFrame:
    """(rank, title, source, summary, tags, link, published_at, degraded) of a day, newest first."""
    day = with_source(ranked_in_day(articles.filter(reportable() & in_day(date, until))), sources)
    summary = T.first_nonempty(T.strip_markdown(F.col("summary")), F.lit(no_summary))
    tags = T.first_nonempty(F.array_join(T.split_tags(F.col("tags")), ", "), F.lit(no_tags))
    return day.select("rank", shown_title().alias("title"), "source", summary.alias("summary"), tags.alias("tags"), "link", "published_at", (F.col("status") == "failed").alias("degraded"))


def report_markdown(items: DataFrame, date: str, note: str = " (degraded)", empty: str = "no articles") -> DataFrame:
    """(date, article_count, content_md): a heading and four lines for each article; one document, so one row."""
    summary = F.concat("summary", F.when(F.col("degraded"), note).otherwise(""))
    entry = F.concat_ws("\n", F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), "title"), F.concat(F.lit("- source: "), "source"), F.concat(F.lit("- summary: "), summary), F.concat(F.lit("- tags: "), "tags"), F.concat(F.lit("- link: "), "link"))
    entries = F.sort_array(F.collect_list(F.struct("rank", entry.alias("entry"))))
    body = F.array_join(F.transform(entries, lambda x: x["entry"]), "\n\n")
    whole = items.agg(F.count("*").alias("article_count"), body.alias("body"))
    return whole.select(F.lit(date).alias("date"), "article_count", F.concat(F.lit(f"# {date}\n\n"), T.first_nonempty(F.col("body"), F.lit(empty))).alias("content_md"))


def escape_xml(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def rss_items(items: DataFrame, zone: str = "+0800") -> DataFrame:
    """(rank, xml): one RSS item for each article; its description is the summary, cut to 600 characters."""
    date = F.concat(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(f" {zone}"))
    xml = F.concat(F.lit("<item><title>"), escape_xml(F.col("title")), F.lit("</title><link>"), escape_xml(F.col("link")), F.lit('</link><guid isPermaLink="false">'), escape_xml(F.col("link")), F.lit("</guid><description>"), escape_xml(F.substring("summary", 1, 600)), F.lit("</description><pubDate>"), date, F.lit("</pubDate></item>"))
    return items.select("rank", xml.alias("xml"))


META = ("title", "title_zh", "summary", "digest", "digest_zh", "reason", "topics")
FULL = (*META, "content_full", "content_zh")


def matches(term: str, scope: str = "meta") -> Column:
    """The term as a plain substring of any searched column; LIKE's wildcards in it are letters like others."""
    escaped = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    hit = F.lit(False)
    for name in FULL if scope == "full" else META:
        hit = hit | F.coalesce(F.col(name).ilike(f"%{escaped}%"), F.lit(False))
    return hit


def search(articles: DataFrame, term: str, scope: str = "meta", category: str | None = None, tag: str | None = None, limit: int = 50) -> DataFrame:
    """The newest ``limit`` (1 to 500) hits; category and tag filter what the limit has left. A blank term finds nothing."""
    hits = articles.filter(reportable() & (matches(term.strip(), scope) if term.strip() else F.lit(False))).orderBy(*latest_first()).limit(max(1, min(500, limit)))
    if category:
        hits = hits.filter(F.col("category") == category)
    if tag:
        hits = hits.filter(F.exists(T.comma_tags(F.col("tags")), lambda t: F.lower(t) == tag.strip().lower()))
    return hits


def search_facets(articles: DataFrame, term: str, scope: str = "meta", category: str | None = None, tag: str | None = None) -> DataFrame:
    """(category, count) of all hits under the list's own filters, and their number as ``_all``."""
    hits = articles.filter(reportable() & (matches(term.strip(), scope) if term.strip() else F.lit(False)))
    if category:
        hits = hits.filter(F.col("category") == category)
    if tag:
        hits = hits.filter(F.exists(T.comma_tags(F.col("tags")), lambda t: F.lower(t) == tag.strip().lower()))
    rolled = hits.rollup("category").agg(F.count("*").alias("count"), F.grouping("category").alias("whole"))
    return rolled.filter("whole = 1 or (category is not null and category <> '')").select(F.when(F.col("whole") == 1, "_all").otherwise(F.col("category")).alias("category"), "count")


def listed(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """The newest ``limit`` rows behind ``offset``; a limit of 0 gives none."""
    return rows.orderBy(*latest_first()).offset(max(0, offset)).limit(max(0, limit))


def by_id(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One page of a management list: the newest ids first; numbers beyond the ends are clamped."""
    return _page(rows, ["id"], number, size)


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One page in canonical order; numbers beyond the ends are clamped."""
    return _page(rows, ["published_at", "id"], number, size)


def _page(rows: DataFrame, keys: list[str], number: int, size: int, near: int = 10_000) -> DataFrame:
    """One page of ``rows`` (``id`` is unique) by the greatest ``keys``, null ones last.

    Pages that end within the first ``near`` rows are the head of a partial sort. For a deeper one only the keys are sorted, over
    range partitions; the partitions' numbers of rows tell in which of them the page lies, and at which places. No task sorts
    or skips more than its partition, and whole rows are read for the page's ids alone.
    """
    order = [F.col(k).desc() for k in keys]
    if number * size <= near:
        total = rows.count()
        last = max(1, -(-total // size))
        return rows.orderBy(*order).offset((min(max(1, number), last) - 1) * size).limit(size)
    sorted_keys = settled(rows.select(*keys).orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = sorted(tuple(r) for r in sorted_keys.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    start = (min(number, max(1, -(-total // size))) - 1) * size
    inside, before = F.lit(False), 0
    for p, n in counts:
        first, end = max(start - before, 0), min(start + size - before, n)
        if first < end:
            inside = inside | F.col("__at").between((p << 33) + first, (p << 33) + end - 1)
        before += n
    return rows.join(F.broadcast(sorted_keys.filter(inside).select("id")), "id", "left_semi").orderBy(*order)  # a page of ids


def page_window(current: int, pages: int, near: int = 2) -> list[int | None]:
    """The page numbers to show: ends and neighbours, None for each gap."""
    out: list[int | None] = []
    for n in sorted({1, pages, *range(max(1, current - near), min(pages, current + near) + 1)}):
        if out and out[-1] is not None and n - out[-1] > 1:
            out.append(None)
        out.append(n)
    return out


def related(articles: DataFrame, article_id: int, recent: int = 120, top: int = 6) -> DataFrame:
    """Of the newest ``recent`` others: 2 for the same category and 1 for each common tag; the best ``top``."""
    one = articles.filter(F.col("id") == article_id).select(F.col("category").alias("own_category"), T.comma_tags(F.col("tags")).alias("own_tags"))
    others = articles.filter(reportable() & (F.col("id") != article_id)).orderBy(*latest_first()).limit(recent)
    # One article is one row.
    scored = others.join(F.broadcast(one)).withColumn("affinity", F.when(F.col("category") == F.col("own_category"), 2).otherwise(0) + F.size(F.array_intersect(T.comma_tags(F.col("tags")), "own_tags")))
    return scored.filter("affinity > 0").orderBy(F.desc("affinity"), *latest_first()).limit(top).select("id", "affinity", "category", "tags")


def homepage_date(articles: DataFrame, reports: DataFrame, now: str, newest: int = 14) -> DataFrame:
    """Today if it has reportable articles, else the newest of the ``newest`` last reports (date) whose day has some, else today.

    Reports count, not days: after a pause the last report with content may be weeks old.
    """
    today = ts(now).cast("date")
    days = reports.select(F.to_date("date").alias("day")).distinct().orderBy(F.desc("day")).limit(newest).unionByName(reports.sparkSession.range(1).select(today.alias("day"))).distinct()
    shown = articles.filter(reportable() & (F.col("published_at") < today + F.expr("INTERVAL 1 DAY"))).select(F.to_date("published_at").alias("day")).join(F.broadcast(days), "day")  # 15 days
    return shown.agg(F.max("day").alias("d")).select(F.date_format(F.coalesce("d", today), "yyyy-MM-dd").alias("date"))


def topic_list(topics: Column) -> Column:
    """The topics of a stored JSON list; none where it is no list."""
    return F.coalesce(F.filter(F.transform(F.from_json(topics, "array<string>"), T.trimmed), lambda t: F.coalesce(t != "", F.lit(False))), F.array().cast("array<string>"))


HAYSTACK = ("title", "title_zh", "summary", "digest", "digest_zh", "brief_zh", "reason")


def brief_filter(categories: list[str] = (), topics: list[str] = (), tags: list[str] = (), keywords: list[str] = (), exclude: list[str] = (), starred_only: bool = False) -> Column:
    """All conditions that are set must hold, each by any of its values. Keywords are looked for in titles, summary, digests, brief and reason."""
    low = F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in HAYSTACK]))
    test = F.lit(True)
    if categories:
        test = test & F.coalesce(F.col("category").isin(*categories), F.lit(False))
    if topics:
        test = test & F.arrays_overlap(topic_list(F.col("topics")), F.array(*map(F.lit, topics)))
    if tags:
        test = test & F.arrays_overlap(T.comma_tags(F.col("tags")), F.array(*map(F.lit, tags)))
    for words, wanted in ((keywords, True), (exclude, False)):
        if words:
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(low, F.lit(w.lower()))
            test = test & (hit if wanted else ~hit)
    return test & (F.col("starred") == 1) if starred_only else test


def brief_order(sort: str = "score") -> list[Column]:
    by_score = [F.coalesce("score", F.lit(0)).desc()] if sort == "score" else []
    return [F.col("starred").desc(), *by_score, *latest_first()]


def brief(articles: DataFrame, now: str, days: int = 3, top: int = 10, sort: str = "score", newest: int = 400, **conditions) -> DataFrame:
    """The best ``top`` of the window's ``newest`` rows that meet the conditions; the row bound comes before them on purpose."""
    pool = articles.filter(reportable() & between(now, days))
    if conditions.get("starred_only"):
        pool = pool.filter("starred = 1")
    pool = pool.orderBy(*latest_first()).limit(newest)
    return pool.filter(brief_filter(**conditions)).orderBy(*brief_order(sort)).limit(top)


BRIEF_COLUMNS = ("title", "title_zh", "brief_zh", "digest_zh", "digest", "reason", "summary", "content_zh", "content_full")


def brief_of_row(placeholder: str | None = None) -> Column:
    return T.brief_text(*map(F.col, BRIEF_COLUMNS), placeholder=placeholder)


def brief_items(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """What a brief shows of its rows, after their TOP-N; a row without readable text goes, so there may be fewer."""
    shown = with_source(rows, sources).withColumn("brief", brief_of_row()).filter("brief <> ''")
    return shown.withColumns({"title": T.trimmed(shown_title()), "category": F.coalesce("category", F.lit("")), "published": F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm"), F.lit(""))})


def brief_sections(articles: DataFrame, now: str, sections: list[dict], days: int = 3, newest: int = 400) -> DataFrame:
    """(no, section, rank, ...): every section's TOP-N in one job. An article may stand in several sections."""
    pool = articles.filter(reportable() & between(now, days)).orderBy(*latest_first()).limit(newest)
    wanted = F.array_compact(F.array(*[F.when(brief_filter(**s.get("where", {})), F.struct(F.lit(n).alias("no"), F.lit(s["name"]).alias("section"), F.lit(s["top"]).alias("top"))) for n, s in enumerate(sections)]))
    rows = pool.withColumn("s", F.explode(wanted))
    rank = F.row_number().over(Window.partitionBy("s.no").orderBy(*brief_order()))
    return rows.withColumn("rank", rank).filter("rank <= s.top").select("s.no", "s.section", "rank", *articles.columns)


def numbered(items: DataFrame) -> DataFrame:
    """``items`` of sections with ``place``, their number among those that are left of their section."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy("no").orderBy("rank")))


def _joined(items: DataFrame, entry: Column, title: str) -> DataFrame:
    """(text): one document of all sections in order; their names stand above them where there are several. A brief is bounded by its TOP-N."""
    entries = F.sort_array(F.collect_list(F.struct("place", entry.alias("entry"))))
    each = items.groupBy("no", "section").agg(F.array_join(F.transform(entries, lambda x: x["entry"]), "\n\n").alias("body"))
    sections = F.sort_array(F.collect_list(F.struct("no", "section", "body")))
    name = lambda x: F.when(F.size("all") > 1, F.concat(F.lit("## "), x["section"], F.lit("\n\n"))).otherwise("")
    text = F.concat(F.lit(f"# {title}\n\n" if title else ""), F.array_join(F.transform("all", lambda x: F.concat(name(x), x["body"])), "\n\n"), F.lit("\n"))
    return each.agg(sections.alias("all")).select(text.alias("text"))


def _mark() -> Column:
    return F.when(F.col("starred") == 1, "★ ").otherwise("")


def brief_text(items: DataFrame, title: str = "") -> DataFrame:
    """(text): the numbered items with a star before starred ones, their briefs, and a line of source, category and time."""
    head = F.concat(F.col("place").cast("string"), F.lit(". "), _mark(), "title")
    meta = F.concat(F.lit("—— "), F.concat_ws(" · ", "source", F.nullif("category", F.lit("")), F.nullif("published", F.lit(""))))
    return _joined(numbered(items), F.concat_ws("\n", head, "brief", meta), title)


def brief_markdown(items: DataFrame, title: str = "") -> DataFrame:
    """(text): the same as Markdown, each item under a heading of its own."""
    head = F.concat(F.lit("### "), F.col("place").cast("string"), F.lit(". "), _mark(), "title")
    meta = F.concat(F.lit("- "), F.concat_ws(" · ", "source", F.nullif("category", F.lit("")), F.nullif("published", F.lit("")), "link"))
    return _joined(numbered(items), F.concat_ws("\n\n", head, "brief", meta), title)


def cards(articles: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    """What a list shows of each visible article.

    A card is degraded where readers see English although a translation is due: not processed and an English lead, or
    processed without a Chinese body and an English one.
    """
    from presswork.operators.audits import reason_of

    rows = with_source(articles.filter(reportable()), sources)
    rows = rows.withColumns({"__zh": T.strip_markdown(F.col("digest_zh")), "__digest": T.strip_markdown(T.first_nonempty(F.col("digest_zh"), F.col("digest")))})
    untranslated = (F.col("status") == "processed") & (T.trimmed(F.coalesce("content_zh", F.lit(""))) == "") & T.looks_english(F.col("content_full"))
    unprocessed = (F.col("status") != "processed") & T.looks_english(T.first_nonempty(F.col("digest"), F.col("summary")))
    return rows.select(
        "id",
        shown_title("untitled").alias("title"),
        F.coalesce("title_zh", F.lit("")).alias("title_zh"),
        "source",
        T.url_host(F.col("link")).alias("host"),
        F.date_format("published_at", "HH:mm").alias("time"),
        F.date_format("published_at", "yyyy-MM-dd").alias("date_key"),
        T.relative_time(F.col("published_at"), ts(now)).alias("age"),
        T.first_nonempty(F.col("__digest"), T.strip_markdown(F.col("summary"))).alias("digest"),
        F.col("__zh").alias("digest_zh"),
        reason_of(T.strip_markdown(F.col("reason")), T.first_nonempty(F.col("__zh"), F.col("__digest"))).alias("reason"),
        T.truncate(F.col("content_full"), 120).alias("lead"),
        F.array_join(topic_list(F.col("topics")), "|").alias("topic_list"),
        F.array_join(T.split_tags(F.col("tags")), "|").alias("tag_list"),
        (F.coalesce(untranslated, F.lit(False)) | F.coalesce(unprocessed, F.lit(False))).alias("degraded"),
        ((F.col("status") == "failed") & (T.trimmed(F.coalesce("digest_zh", F.lit(""))) == "")).alias("pending"),
        F.coalesce("process_attempts", F.lit(0)).alias("attempts"),
        (F.col("starred") == 1).alias("starred"),
    )


API_FIELDS = ("id", "source_id", "title", "link", "published_at", "summary", "digest", "reason", "score", "category", "topics", "title_zh", "digest_zh", "content_zh", "tags", "relevance", "status")


def api_articles(articles: DataFrame) -> DataFrame:
    """The reportable rows with the fields that the interface gives out; those that ``articles`` lacks are null."""
    return articles.filter(reportable()).select(*[F.col(c) if c in articles.columns else F.lit(None).cast("string").alias(c) for c in (*API_FIELDS, "title_en", "digest_en")])


def article_details(articles: DataFrame, sources: DataFrame, placeholder: str = "(translation in preparation)", unknown: str = "unknown") -> DataFrame:
    """(id, source_name, digest_brief, topics_list): what the detail view of an article has beside the fields of the list. Hidden articles
    have one too. ``digest_brief`` is the brief as it would be sent, or the placeholder; the first three topics."""
    topics = F.coalesce(F.from_json("topics", "array<string>"), F.array().cast("array<string>"))
    rows = with_source(articles, sources, unknown)
    return rows.select("id", F.col("source").alias("source_name"), brief_of_row(placeholder).alias("digest_brief"), F.slice(topics, 1, 3).alias("topics_list"))


def by_date(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of rows of their day, the newest day first and the newest row in it."""
    counts = rows.groupBy("date_key").agg(F.count("*").alias("items"))
    return rows.join(counts, "date_key").orderBy(F.desc("date_key"), *latest_first()).select("id", "date_key", "items")


ENTRY = "array<struct<place: int, id: long, title: string, brief: string, source: string, category: string, published: string, link: string, starred: boolean>>"
ISSUE = f"struct<title: string, sections: array<struct<no: int, name: string, text: string, entries: {ENTRY}>>>"


def _entry_text() -> Column:
    head = F.concat(F.col("place").cast("string"), F.lit(". "), _mark(), "title")
    return F.concat_ws("\n", head, "brief", F.concat(F.lit("—— "), F.concat_ws(" · ", "source", F.nullif("category", F.lit("")), F.nullif("published", F.lit("")))))


def brief_issue(items: DataFrame, date: str, title: str) -> DataFrame:
    """(date, content_json, text, markdown, section_count, article_count): the issue of a day as it is now, one row, for ``write_by_date``.

    ``content_json`` holds the sections with their items and their own texts, so what is configured or edited later can't
    change an issue. Without items it is an issue without sections. A brief is bounded by its TOP-N.
    """
    items = settled(items)  # a few rows, which three documents are made of
    rows = numbered(items)
    entry = F.struct(F.col("place").cast("int").alias("place"), "id", "title", "brief", "source", "category", "published", "link", (F.col("starred") == 1).alias("starred"))
    in_order = F.sort_array(F.collect_list(F.struct("place", entry.alias("entry"), _entry_text().alias("text"))))
    each = rows.groupBy(F.col("no").cast("int").alias("no"), F.col("section").alias("name")).agg(in_order.alias("e"))
    each = each.select("no", "name", F.array_join(F.transform("e", lambda x: x["text"]), "\n\n").alias("text"), F.transform("e", lambda x: x["entry"]).alias("entries"))
    whole = each.agg(F.sort_array(F.collect_list(F.struct("no", "name", "text", "entries"))).alias("sections"), F.coalesce(F.sum(F.size("entries")), F.lit(0)).cast("long").alias("article_count"))
    made = whole.select(F.lit(date).alias("date"), F.to_json(F.struct(F.lit(title).alias("title"), "sections")).alias("content_json"), F.size("sections").cast("long").alias("section_count"), "article_count")
    return made.crossJoin(brief_text(items, title)).crossJoin(brief_markdown(items, title).withColumnRenamed("text", "markdown"))  # one row each


def issues_view(issues: DataFrame, default_title: str = "Brief") -> DataFrame:
    """(date, title, sections, text, markdown, section_count, article_count) of stored issues. What is no JSON has no sections; sections
    of old issues without a text get it from their items."""
    parsed = F.from_json("content_json", ISSUE)
    line = lambda e: F.concat_ws("\n", F.concat(e["place"].cast("string"), F.lit(". "), F.when(e["starred"], "★ ").otherwise(""), e["title"]), e["brief"], F.concat(F.lit("—— "), F.concat_ws(" · ", e["source"], F.nullif(e["category"], F.lit("")), F.nullif(e["published"], F.lit("")))))
    text = lambda s: T.first_nonempty(s["text"], F.array_join(F.transform(s["entries"], line), "\n\n"))
    sections = F.transform(F.coalesce("p.sections", F.array().cast(ISSUE[ISSUE.index("array") : -1])), lambda s: F.struct(s["no"].alias("no"), s["name"].alias("name"), text(s).alias("text"), s["entries"].alias("entries")))
    title = T.first_nonempty(F.col("p.title"), F.concat(F.lit(f"{default_title} · "), F.col("date").cast("string")))
    return issues.withColumn("p", parsed).select(F.col("date").cast("string").alias("date"), title.alias("title"), sections.alias("sections"), "text", "markdown", "section_count", "article_count")


def rss_channel(items: DataFrame, title: str, link: str, description: str, zone: str = "+0800", no_tags: str = "no tags", degraded: str = " (degraded)") -> DataFrame:
    """One row: a channel with the items of a day in their order, each titled with its tags, for ``write_rss``. Without items it is an empty channel."""
    date = F.concat(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(f" {zone}"))
    name = F.concat("title", F.lit(" ("), F.when(F.col("tags").isin("", "(no tags)"), no_tags).otherwise(F.col("tags")), F.lit(")"))
    summary = F.substring(F.concat("summary", F.when(F.col("degraded"), degraded).otherwise("")), 1, 600)
    guid = F.struct(F.lit("false").alias("_isPermaLink"), F.col("link").alias("_VALUE"))
    item = F.struct("rank", F.struct(name.alias("title"), "link", guid.alias("guid"), summary.alias("description"), date.alias("pubDate")).alias("item"))
    rows = items.agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias("item"))
    return rows.select(F.lit(title).alias("title"), F.lit(link).alias("link"), F.lit(description).alias("description"), "item")

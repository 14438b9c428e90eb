"""Audits of stored translations and images, and small read models of the management pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions import text as T
from presswork.operators.analytics import calendar
from presswork.operators.visibility import in_day, latest_first, reportable, ts


def half_translated(body: Column, translated: Column, min_words: int = 20) -> Column:
    """A foreign body whose translation still has more than ``min_words`` Latin words, and more of them than Han characters."""
    latin, han = F.regexp_count(translated, F.lit(r"[A-Za-z]{2,}")), F.regexp_count(translated, F.lit(T.HAN))
    return T.looks_english(body) & (latin > min_words) & (latin > han)


def telegraphic_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n), most frequent first: how many rows have telegraphic text in a field."""
    named = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    hits = rows.select(F.explode(F.filter(named, lambda x: T.looks_telegraphic(x["value"]))).alias("x"))
    return hits.groupBy("x.field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field")


def drop_foreign_side(rows: DataFrame, body: str, foreign: list[str], min_chars: int = 400) -> DataFrame:
    """On rows whose body is long and not English, the columns of the English side become null. A new snapshot; nothing is written."""
    native = (F.char_length(body) >= min_chars) & ~T.looks_english(F.col(body))
    return rows.withColumns({c: F.when(native, F.lit(None)).otherwise(F.col(c)) for c in foreign})


def image_counts(rows: DataFrame) -> DataFrame:
    """(source_id, url, n): how often a source shows an image; rows are (source_id, images array)."""
    return rows.select("source_id", F.explode("images").alias("url")).groupBy("source_id", "url").agg(F.count("*").alias("n"))


def site_defaults(rows: DataFrame, threshold: int = 3) -> DataFrame:
    """The images that a source shows so often that they say nothing about an article."""
    return image_counts(rows).filter(F.col("n") >= threshold)


def content_image(candidates: DataFrame, sizes: DataFrame, min_width: int = 400, min_height: int = 220) -> DataFrame:
    """(page_id, url): of each page's candidates (page_id, pos, url) the first of known sufficient size, else the first."""
    sized = candidates.join(sizes, "url", "left").withColumn("fits", (F.col("width") >= min_width) & (F.col("height") >= min_height))
    return sized.groupBy("page_id").agg(F.coalesce(F.min_by("url", F.when(F.coalesce("fits", F.lit(False)), F.col("pos"))), F.min_by("url", "pos")).alias("url"))


def orphans(files: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """File names that no row mentions."""
    used = rows.select(F.explode(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"[0-9a-f]{40}\.[a-z]+"), F.lit(0))).alias("name")).distinct()
    return files.join(used, "name", "left_anti")


def ordered_union(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """All of ``first``, then what of ``second`` has another key."""
    return first.withColumn("turn", F.lit(0)).unionByName(second.join(first.select(key), key, "left_anti").withColumn("turn", F.lit(1)))


def archive(articles: DataFrame, reports: DataFrame, newest: int = 120) -> DataFrame:
    """(date, article_count, live, total): the newest reports with their live counts and the number of all reports."""
    total = reports.agg(F.count("*").alias("total"))
    live = articles.filter(reportable()).groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("live"))
    top = reports.orderBy(F.desc("date")).limit(newest)
    return top.join(live, "date", "left").join(F.broadcast(total)).select("date", "article_count", F.coalesce("live", F.lit(0)).alias("live"), "total")


def reports_in_range(reports: DataFrame, since: str) -> DataFrame:
    """(date, article_count, weekday): Monday is 0; null for a date that is none."""
    return reports.filter(F.col("date") >= since).select("date", "article_count", F.weekday(F.col("date").try_cast("date")).alias("weekday"))


def tab_counts(sources: DataFrame) -> DataFrame:
    return sources.filter("deleted = 0").groupBy((F.col("enabled") == 1).alias("enabled")).agg(F.count("*").alias("n"))


def switch_sources(sources: DataFrame, ids: list[int], now: str, reason: str = "manual") -> DataFrame:
    """The named sources toggled; those that go off get a reason and a time, those that go on lose both."""
    hit, off = F.col("id").isin(ids), F.col("enabled") == 1
    return sources.withColumns(
        {
            "enabled": F.when(hit, F.when(off, 0).otherwise(1)).otherwise(F.col("enabled")),
            "disabled_reason": F.when(hit, F.when(off, reason)).otherwise(F.col("disabled_reason")),
            "disabled_at": F.when(hit, F.when(off, ts(now))).otherwise(F.col("disabled_at")),
        }
    )


def rename_sources(sources: DataFrame, names: dict[int, str], longest: int = 200) -> DataFrame:
    """New names for sources that are there; blank and too long ones change nothing."""
    out = F.col("name")
    for i, name in names.items():
        if 0 < len(name.strip()) <= longest:
            out = F.when((F.col("id") == i) & (F.col("deleted") == 0), name.strip()).otherwise(out)
    return sources.withColumn("name", out)


def drop_sources(sources: DataFrame, ids: list[int]) -> DataFrame:
    """Marked as deleted and switched off; the rows stay, so that articles keep their source's name."""
    hit = F.col("id").isin(ids) & (F.col("deleted") == 0)
    return sources.withColumns({"deleted": F.when(hit, 1).otherwise(F.col("deleted")), "enabled": F.when(hit, 0).otherwise(F.col("enabled"))})


def restore_sources(sources: DataFrame, ids: list[int]) -> DataFrame:
    hit = F.col("id").isin(ids) & (F.col("deleted") == 1)
    return sources.withColumns({"deleted": F.when(hit, 0).otherwise(F.col("deleted")), "enabled": F.when(hit, 1).otherwise(F.col("enabled"))})


def clean_source(name: Column, url: Column, lang: Column, longest_name: int = 200, longest_url: int = 1000) -> Column:
    """struct(name, url, lang, error) of what a user enters: an empty name is the address's host, an unknown language ``auto``;
    error says why the address or the name is not taken ('' if it is)."""
    u = T.trimmed(F.coalesce(url, F.lit("")))
    n = T.first_nonempty(T.trimmed(F.coalesce(name, F.lit(""))), T.url_host(u))
    error = F.when(u == "", "no address").when(F.char_length(u) > longest_url, "address too long").when(~u.rlike("^https?://"), "not http").when(F.char_length(n) > longest_name, "name too long").otherwise("")
    return F.struct(n.alias("name"), u.alias("url"), F.when(lang.isin("zh", "en"), lang).otherwise("auto").alias("lang"), error.alias("error"))


def clean_choice(value: Column, allowed: list[str], default: str) -> Column:
    """Tabs, kinds and node types: what is none of the choices is the default."""
    v = T.trimmed(F.coalesce(value, F.lit("")))
    return F.when(v.isin(allowed), v).otherwise(default)


def clean_page(value: Column) -> Column:
    """A page number of 1 or more; 1 for anything else."""
    return F.greatest(F.coalesce(T.trimmed(value).try_cast("int"), F.lit(1)), F.lit(1))


def clean_keyword(value: Column, longest: int = 100) -> Column:
    return F.substring(T.trimmed(F.coalesce(value, F.lit(""))), 1, longest)


def anchor_outcome(kept: Column, too_small: Column, failed: Column) -> Column:
    """What a round over an article's images comes to: saved if any is kept; retry if none is and calls failed, but for small
    ones; else empty, which is final."""
    return F.when(kept > 0, "saved").when((failed > 0) & (too_small == 0), "retry").otherwise("empty")


def newest_issues(issues: DataFrame, newest: int = 14) -> DataFrame:
    return issues.orderBy(F.desc("date")).limit(newest)


def create_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (keyword, kind) rules that are not there yet, keywords trimmed and case-blind, enabled and without hits."""
    clean = new.select(T.trimmed(F.col("keyword")).alias("keyword"), "kind").filter("keyword <> ''").withColumn("k", F.lower("keyword"))
    first = clean.groupBy("k", "kind").agg(F.min("keyword").alias("keyword"))
    added = first.join(rules.select(F.lower("keyword").alias("k"), "kind"), ["k", "kind"], "left_anti")
    return added.select("keyword", "kind", F.lit(1).alias("enabled"), F.lit(0).alias("hits"))


def backfill_queue(articles: DataFrame, missing: Column, batch: int = 50) -> DataFrame:
    """The newest visible, relevant rows for which ``missing`` holds (null and '' are told apart by the caller)."""
    return articles.filter(reportable() & missing).orderBy("process_attempts", *latest_first()).limit(batch)


def trimmed_tails(articles: DataFrame, newest: int = 500) -> DataFrame:
    """(id, content_full) of those of the ``newest`` rows with a body whose end is promotion, without it."""
    rows = articles.filter(F.coalesce("content_full", F.lit("")) != "").orderBy(*latest_first()).limit(newest)
    cut = rows.select("id", "content_full", T.trim_tail(F.col("content_full")).alias("cut"))
    return cut.filter((F.col("cut") != "") & (F.col("cut") != T.trimmed(F.col("content_full")))).select("id", F.col("cut").alias("content_full"))


def empty_hint(articles: DataFrame, now: str, days: int) -> DataFrame:
    """Why a section is empty: nothing in the window, or nothing that matched."""
    n = articles.filter(reportable() & (F.col("published_at") >= ts(now) - F.expr(f"INTERVAL {days} DAY"))).agg(F.count("*").alias("n"))
    return n.select("n", F.when(F.col("n") == 0, "no articles in the window").otherwise("no article matched").alias("hint"))


def pipeline_note(articles: DataFrame, date: str | None = None) -> DataFrame:
    """One line on what waits and what failed, of all articles or of a day."""
    c = (articles.filter(in_day(date)) if date else articles).filter("deleted_at is null").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"))
    note = F.when((F.col("pending") == 0) & (F.col("failed") == 0), "all processed").otherwise(F.concat(F.col("pending").cast("string"), F.lit(" pending, "), F.col("failed").cast("string"), F.lit(" failed")))
    return c.select("pending", "failed", note.alias("note"))


def date_labels(days: DataFrame) -> DataFrame:
    """(date, label, weekday, quote) of a frame of days (a calendar, say): month and day as read aloud, Monday = 0, and the place of the day's quote among seven."""
    quote = (F.date_diff("day", F.lit("0001-01-01").cast("date")) + 1) % 7
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("date"), F.concat(F.month("day").cast("string"), F.lit("/"), F.day("day").cast("string")).alias("label"), F.weekday("day").alias("weekday"), quote.alias("quote"))


def weather_advice(temperature: Column, rain: Column, wind: Column, code: Column) -> Column:
    """struct(clothing, umbrella, wind, storm) by thresholds; a missing temperature gives no clothing."""
    clothing = F.when(temperature >= 30, "hot").when(temperature >= 25, "warm").when(temperature >= 18, "mild").when(temperature >= 10, "cool").when(temperature >= 0, "cold").when(temperature.isNotNull(), "freezing")
    gale = F.when(wind >= 88, "typhoon").when(wind >= 62, "gale").when(wind >= 39, "windy")
    return F.struct(clothing.alias("clothing"), F.coalesce(rain >= 50, F.lit(False)).alias("umbrella"), gale.alias("wind"), F.coalesce(code.isin(95, 96, 99), F.lit(False)).alias("storm"))


def weather_text(rows: DataFrame) -> DataFrame:
    """(city, text) of weather rows (city, sky, low, high, rain, wind, code); a city without a forecast is said to have none."""
    advice = rows.withColumn("a", weather_advice(F.col("high"), F.col("rain"), F.col("wind"), F.col("code")))
    told = F.concat_ws(
        ", ",
        F.concat(F.col("city"), F.lit(": "), F.coalesce("sky", F.lit("?"))),
        F.concat(F.bround("low", 0).cast("int").cast("string"), F.lit(" to "), F.bround("high", 0).cast("int").cast("string"), F.lit(" °C")),
        F.concat(F.lit("dress for "), F.col("a.clothing"), F.lit(" weather")),
        F.when(F.col("a.umbrella"), "take an umbrella"),
        F.col("a.wind"),
        F.when(F.col("a.storm"), "thunderstorms"),
    )
    return advice.select("city", F.when(F.col("high").isNull(), F.concat(F.col("city"), F.lit(": no forecast"))).otherwise(told).alias("text"))


def reason_of(reason: Column, lead: Column) -> Column:
    """'' where the reason only repeats the lead."""
    return F.when(T.trimmed(F.coalesce(reason, F.lit(""))) == T.trimmed(F.coalesce(lead, F.lit(""))), "").otherwise(F.coalesce(reason, F.lit("")))


def section_subtitle(categories: Column, tags: Column, starred: Column) -> Column:
    """The conditions of a section in words."""
    return F.concat_ws(" · ", F.nullif(F.array_join(categories, "/"), F.lit("")), F.nullif(F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " "), F.lit("")), F.when(starred == 1, "★"))


def report_html(items: DataFrame, date: str) -> DataFrame:
    """(date, content_html): the day's list with all text escaped."""
    from presswork.operators.reading import escape_xml

    told = F.concat(F.lit("<p>"), escape_xml(F.col("summary")), F.lit("</p><p>"), escape_xml(F.col("tags")), F.lit("</p>"))
    line = F.concat(F.lit('<li><a href="'), escape_xml(F.col("link")), F.lit('">'), escape_xml(F.col("title")), F.lit("</a> "), escape_xml(F.col("source")), told, F.lit("</li>"))
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return items.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("body")).select(F.lit(date).alias("date"), F.concat(F.lit(f"<h1>{date}</h1><ol>"), "body", F.lit("</ol>")).alias("content_html"))


def newest_per_group(rows: DataFrame, group: str, keep: int = 1) -> DataFrame:
    """The newest rows of each group."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*latest_first()))).filter(F.col("__r") <= keep).drop("__r")

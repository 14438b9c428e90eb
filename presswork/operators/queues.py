"""What the backfills take next. In all their columns null means "not looked at yet" and an empty value "looked at, there is none"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions import text as T
from presswork.operators.visibility import latest_first


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _open(articles: DataFrame) -> DataFrame:
    """Rows whose link is no local fixture's. Hidden rows count: their pages can still be opened."""
    return articles.filter(~F.coalesce(F.lower("link").startswith("http://localhost"), F.lit(False)))


def to_translate(articles: DataFrame, limit: int = 20, with_content: bool = True, max_attempts: int = 5) -> DataFrame:
    """Rows that lack a title, a digest or (``with_content``) a body in the second language; irrelevant ones only for their title.
    Those tried less often come first, and ``max_attempts`` tries are the last."""
    lacks = F.col("digest_zh").isNull() | F.col("title_zh").isNull() | (F.col("content_zh").isNull() & F.lit(with_content))
    wanted = (F.col("relevance") == 1) | ((F.col("relevance") == 0) & F.col("title_zh").isNull())
    rows = _open(articles).filter(lacks & wanted & F.col("content_full").isNotNull() & (F.coalesce("i18n_attempts", F.lit(0)) < max_attempts))
    return rows.orderBy(F.coalesce("i18n_attempts", F.lit(0)), *latest_first()).limit(limit)


def without_sections(articles: DataFrame, limit: int = 5) -> DataFrame:
    """Relevant rows with a translated body that lack the sections of either side; three times ``limit``, as some can't be cut."""
    rows = _open(articles).filter((F.col("body_sections_zh").isNull() | F.col("body_sections").isNull()) & _filled("content_zh") & (F.col("relevance") == 1))
    return rows.orderBy(*latest_first()).limit(3 * limit)


def without_brief(articles: DataFrame, limit: int = 20) -> DataFrame:
    """Of the newest three times ``limit`` relevant rows without a brief those with a digest in Chinese, ``limit`` at most."""
    newest = _open(articles).filter(F.col("brief_zh").isNull() & (F.col("relevance") == 1)).orderBy(*latest_first()).limit(3 * limit)
    digest = T.strip_markdown(T.first_nonempty(F.col("digest_zh"), F.col("digest")))
    return newest.withColumn("__d", digest).filter((F.col("__d") != "") & T.is_chinese(F.col("__d"))).drop("__d").orderBy(*latest_first()).limit(limit)


def without_image(articles: DataFrame, limit: int = 20) -> DataFrame:
    """Relevant rows for which no image has been looked for."""
    return _open(articles).filter(F.col("image_urls").isNull() & (F.col("relevance") == 1)).orderBy(*latest_first()).limit(limit)


def covers_to_store(articles: DataFrame, limit: int = 50) -> DataFrame:
    """With ``cover``: of the newest three times ``limit`` rows with images those whose first full address is not stored here yet."""
    newest = _open(articles).filter(F.col("image_urls").isNotNull() & (F.col("image_urls") != "[]")).orderBy(*latest_first()).limit(3 * limit)
    first = F.get(F.filter(F.from_json("image_urls", "array<string>"), lambda u: F.startswith(u, F.lit("http"))), F.lit(0))
    stored = F.coalesce(F.map_contains_key(F.from_json("media_map", "map<string, string>"), F.col("cover")), F.lit(False))
    return newest.withColumn("cover", first).filter(F.col("cover").isNotNull()).filter(~stored).orderBy(*latest_first()).limit(limit)


def without_body_images(articles: DataFrame, limit: int = 20) -> DataFrame:
    """With ``fresh``: relevant rows with a body whose images were never placed, and rows of any relevance whose placed images are
    all at their sites yet; the newest ``limit`` of each."""
    rows = _open(articles)
    fresh = rows.filter(F.col("body_images").isNull() & _filled("content_full") & (F.col("relevance") == 1)).orderBy(*latest_first()).limit(limit)
    remote = rows.filter(F.col("body_images").isNotNull() & (F.col("body_images") != "[]") & ~F.contains("body_images", F.lit('"local"'))).orderBy(*latest_first()).limit(limit)
    return fresh.withColumn("fresh", F.lit(True)).unionByName(remote.withColumn("fresh", F.lit(False)))

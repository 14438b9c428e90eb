"""Reading feeds, usage logs and image heads with Spark's own readers; writers for reports, logs and image files."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.functions.html import document
from presswork.functions.pandas_text import blocked_address, decoded, image_size, is_internal_address

ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "link", "pubDate", "description", "content:encoded")])
ENTRY = T.StructType([*[T.StructField(n, T.StringType()) for n in ("title", "published", "updated", "summary", "content")], T.StructField("link", T.ArrayType(T.StructType([T.StructField("_href", T.StringType())])))])
USAGE = "at timestamp_ntz, kind string, model string, ok boolean, ms long, input_tokens long, output_tokens long, cached_tokens long, reasoning_tokens long, total_tokens long, error string, seq long"


def feed_time(raw: Column, zone: str = "+08:00") -> Column:
    """RFC 822 or ISO 8601 with a zone, as local time without one; null if it can't be read."""
    text = F.regexp_replace(F.regexp_replace(F.btrim(raw), r"^[A-Za-z]{3,9},\s*", ""), r"\b(?:GMT|UTC|Z)$", "+0000")
    at = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssZ")])
    return F.from_utc_timestamp(F.to_utc_timestamp(at, F.current_timezone()), zone).cast("timestamp_ntz")


def read_feeds(spark: SparkSession, path: str, kind: str = "rss") -> DataFrame:
    """(title, link, content, published_at) of the items of all feed files under ``path``; items without title or link are left out."""
    reader = spark.read.format("xml")
    if kind == "rss":
        raw = reader.schema(ITEM).option("rowTag", "item").load(path)
        rows = raw.select("title", "link", F.coalesce("`content:encoded`", "description", F.lit("")).alias("content"), feed_time(F.col("pubDate")).alias("published_at"))
    else:
        raw = reader.schema(ENTRY).option("rowTag", "entry").load(path)
        rows = raw.select("title", F.get("link", F.lit(0))["_href"].alias("link"), F.coalesce("content", "summary", F.lit("")).alias("content"), feed_time(F.coalesce("published", "updated")).alias("published_at"))
    rows = rows.withColumns({"title": F.btrim("title"), "link": F.btrim("link")})
    return rows.filter("coalesce(title, '') <> '' and coalesce(link, '') <> ''")


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The usage log; lines that are no JSON are skipped."""
    return spark.read.schema(USAGE).option("mode", "DROPMALFORMED").json(path)


def append_usage(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled = 1 and deleted = 0").orderBy("id")


def write_by_date(rows: DataFrame, path: str) -> None:
    """Replaces the dates that ``rows`` has, and no others (daily reports, brief issues)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def write_rss(channel: DataFrame, path: str) -> None:
    """A channel (one row of ``rss_channel``) as an RSS 2.0 document; ``read_feeds`` reads it."""
    channel.coalesce(1).write.mode("overwrite").format("xml").option("rootTag", 'rss version="2.0"').option("rowTag", "channel").option("declaration", 'version="1.0" encoding="UTF-8"').save(path)


def image_name(url: Column, head: Column) -> Column:
    """sha1 of the address and an extension by the file's first bytes."""
    h = F.hex(F.substring(head, 1, 12))
    ext = F.when(h.startswith("89504E47"), ".png").when(h.startswith("47494638"), ".gif").when(h.startswith("FFD8FF"), ".jpg").when(h.startswith("52494646") & h.endswith("57454250"), ".webp").otherwise(".img")
    return F.concat(F.sha1(url.cast("binary")), ext)


def safe_image_name(name: Column) -> Column:
    return name.rlike(r"^[0-9a-f]{40}\.(?:png|gif|jpg|webp|img)$")


class NotFetched(Exception):
    """Raised by a ``fetch`` for an address that must not be tried again."""


def fetched(rows: DataFrame, fetch: Callable[[str], bytes | None], url: str = "url", retries: int = 0, pause: float = 1.0, most_bytes: int | None = None, blocked: bool = False) -> DataFrame:
    """``rows`` with ``body``, ``tries`` and ``error``: what the injected ``fetch`` returns for the address, on the executors.

    An address is tried ``retries`` times more, with a pause that doubles up to four times ``pause``. The body is null where all
    tries fail, and where it has more than ``most_bytes``; with ``blocked`` addresses of local networks are not tried at all.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("body", T.BinaryType()), T.StructField("tries", T.IntegerType()), T.StructField("error", T.StringType())])

    def one(address: str | None) -> tuple[bytes | None, int, str | None]:
        why = (blocked_address(address) or ("not public" if is_internal_address(address) else "")) if blocked else ""
        if why:
            return None, 0, why
        error = None
        for n in range(retries + 1):
            try:
                body = fetch(address)
            except NotFetched as e:
                return None, n + 1, str(e)[:200]
            except Exception as e:  # noqa: BLE001 - an address that fails is data, not an error of the job
                error = f"{type(e).__name__}: {e}"[:200]
                if pause and n < retries:
                    time.sleep(pause * min(2**n, 4))
                continue
            if body is not None and most_bytes is not None and len(body) > most_bytes:
                return None, n + 1, "too large"
            return body, n + 1, None
        return None, retries + 1, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [one(u) for u in b[url]]
            yield b.assign(body=[d[0] for d in done], tries=[d[1] for d in done], error=[d[2] for d in done])

    return rows.mapInPandas(run, schema)


def fetched_pages(rows: DataFrame, fetch: Callable[[str], bytes | None], url: str = "url", most_bytes: int = 1_500_000, **how) -> DataFrame:
    """``rows`` with ``html``: pages up to 1.5 MB, decoded as UTF-8, GB18030 or Latin-1."""
    return fetched(rows, fetch, url, most_bytes=most_bytes, **how).withColumn("html", decoded(F.col("body"))).drop("body")


def refilled(queue: DataFrame, fetch: Callable[[str], bytes | None], **how) -> DataFrame:
    """(id, content_full, body_images, outcome) of queued rows (id, link): filled; empty where the page has no article, which is
    final; retry where it could not be fetched."""
    pages = fetched_pages(queue.select("id", "link"), fetch, "link", **how).withColumn("d", document(F.col("html")))
    outcome = F.when(F.col("html").isNull(), "retry").when(F.col("d.text") == "", "empty").otherwise("filled")
    return pages.select("id", F.nullif(F.col("d.text"), F.lit("")).alias("content_full"), F.col("d.anchors").alias("body_images"), outcome.alias("outcome"))


def fetched_images(rows: DataFrame, fetch: Callable[[str], bytes | None], url: str = "url", most_bytes: int = 8_000_000, min_width: int = 200, min_height: int = 120, **how) -> DataFrame:
    """``rows`` with body, width, height, name and ``outcome``: kept, too_small or failed (what is no image counts as failed)."""
    got = fetched(rows, fetch, url, most_bytes=most_bytes, **how).withColumn("s", image_size(F.col("body")))
    outcome = F.when(F.col("s.width").isNull(), "failed").when((F.col("s.width") < min_width) | (F.col("s.height") < min_height), "too_small").otherwise("kept")
    return got.select(*[c for c in got.columns if c != "s"], F.col("s.width").alias("width"), F.col("s.height").alias("height"), outcome.alias("outcome")).withColumn("name", F.when(F.col("outcome") == "kept", image_name(F.col(url), F.col("body"))))


def stored_images(images: DataFrame, path: str) -> None:
    """Keeps the images of ``fetched_images`` under their names as a table of files; names that are there already are left alone."""
    spark = images.sparkSession
    kept = images.filter("outcome = 'kept'").select("name", "body").dropDuplicates(["name"])
    try:
        kept = kept.join(spark.read.parquet(path).select("name"), "name", "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    kept.write.mode("append").parquet(path)


def localized(anchors: DataFrame, images: DataFrame) -> DataFrame:
    """(id, anchors, kept, too_small, failed): the anchors (id, i, url) whose image was kept, in order, with its local address."""
    rows = anchors.join(images.select("url", "outcome", "name"), "url", "left").withColumn("outcome", F.coalesce("outcome", F.lit("failed")))
    kept = F.when(F.col("outcome") == "kept", F.struct("i", "url", F.concat(F.lit("/img/"), "name").alias("local")))
    counts = [F.count_if(F.col("outcome") == n).alias(n) for n in ("kept", "too_small", "failed")]
    return rows.groupBy("id").agg(F.sort_array(F.collect_list(kept)).alias("anchors"), *counts)

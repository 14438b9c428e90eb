"""Feeds as a streaming data source with an offset for each source, and a trial of a feed's address."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from presswork.functions import text as T
from presswork.functions.pandas_text import blocked_address

FEED_SCHEMA = "source string, title string, link string, content string, published_at timestamp, error string"
#: What an injected fetcher returns for an address: the body and its declared content type ('' if there is none).
Fetch = Callable[[str], tuple[bytes, str]]


def _time(raw: str | None) -> datetime | None:
    for read in (parsedate_to_datetime, datetime.fromisoformat):
        try:
            at = read((raw or "").strip())
            return at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        except (TypeError, ValueError):
            continue
    return None


def feed_items(body: bytes) -> list[tuple[str, str, str, datetime | None]]:
    """(title, link, content, published_at) of an RSS or Atom document; items without title or link are left out."""
    out = []
    for item in ElementTree.fromstring(body).iter():
        if item.tag.rpartition("}")[2] not in ("item", "entry"):
            continue
        found: dict[str, str] = {}
        for x in item:
            name = x.tag.rpartition("}")[2]
            found.setdefault(name, (x.text or x.get("href") or "").strip())
        content = found.get("encoded") or found.get("content") or found.get("description") or found.get("summary") or ""
        if found.get("title") and found.get("link"):
            out.append((found["title"], found["link"], content, _time(found.get("pubDate") or found.get("published") or found.get("updated"))))
    return out


def checked(address: str, fetch: Fetch, most_bytes: int) -> list[tuple]:
    """The items at an address. ValueError for an address that may not be fetched, too many bytes, or a type that is no feed's."""
    if why := blocked_address(address):
        raise ValueError(why)
    body, kind = fetch(address)
    if len(body) > most_bytes:
        raise ValueError("too large")
    if kind and not any(word in kind.lower() for word in ("xml", "rss", "atom", "text/plain")):
        raise ValueError(f"no feed: {kind}")
    return feed_items(body)


def _mark(link: str) -> str:
    return hashlib.blake2b(link.encode(), digest_size=8).hexdigest()


def feed_source(fetch: Fetch, name: str = "feed", most_bytes: int = 2_000_000) -> type[DataSource]:
    """A data source to register: ``spark.readStream.format(name).option("sources", json list of addresses)``.

    A batch has the new items of up to ``per_batch`` (option, 50) sources, so what the driver holds is bounded by that many feeds of
    ``most_bytes``. The offset keeps for each source the marks of the links of its last reading, and which sources failed: a
    restart from the checkpoint goes on with what is new. A source that fails gives one row with its error, keeps its
    offset, and is tried again in the next round; the others go on. A batch that was planned but not done before a restart
    is fetched again, and has those of its items that the feed still shows.
    """

    class FeedReader(SimpleDataSourceStreamReader):
        def __init__(self, options: dict) -> None:
            self.sources = json.loads(options["sources"])
            self.per_batch = int(options.get("per_batch", 50))

        def initialOffset(self) -> dict:
            return {"next": 0, "seen": {}, "failed": []}

        def _fetched(self, address: str, seen: dict, failed: list) -> tuple[list[tuple], dict, list]:
            try:
                items = checked(address, fetch, most_bytes)
            except Exception as e:  # noqa: BLE001 - a source that fails is data, and doesn't stop the others
                new = [] if address in failed else [(address, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                return new, seen, sorted({*failed, address})
            known = set(seen.get(address, ()))
            rows = [(address, *item, None) for item in dict((i[1], i) for i in items).values() if _mark(item[1]) not in known]
            return rows, seen | {address: sorted(_mark(i[1]) for i in items)}, [f for f in failed if f != address]

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            at, seen, failed = start["next"], start["seen"], start["failed"]
            n, tried = len(self.sources), 0
            while tried < n:
                rows: list[tuple] = []
                for _ in range(min(self.per_batch, n - tried)):
                    more, seen, failed = self._fetched(self.sources[at % n], seen, failed)
                    rows += more
                    at, tried = (at + 1) % n, tried + 1
                if rows:
                    return iter(rows), {"next": at, "seen": seen, "failed": failed}
            return iter(()), start

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            for address in self.sources:
                had, has = set(start["seen"].get(address, ())), set(end["seen"].get(address, ()))
                if has - had:
                    rows, _, _ = self._fetched(address, {address: sorted(had)}, [address])
                    yield from (r for r in rows if r[1] is not None and _mark(r[2]) in has)
                elif address in end["failed"] and address not in start["failed"]:
                    yield (address, None, None, None, None, "failed")

        def commit(self, end: dict) -> None:
            pass

    class Feeds(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return FEED_SCHEMA

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return FeedReader(dict(self.options))

    return Feeds


def trial_fetch(addresses: DataFrame, fetch: Fetch, url: str = "url", most_bytes: int = 2_000_000, sample_items: int = 8, threshold: float = 0.12) -> DataFrame:
    """(url, ok, count, error, sample, lang): what a feed's address gives, before it becomes a source. ``sample`` is the first title among
    the first items, ``lang`` zh or en by the Han share of what the items say; '' where there are none. Addresses are tried on the executors."""

    def one(batches):
        import pandas as pd

        for b in batches:
            out = []
            for address in b[url]:
                try:
                    items, error = checked(address or "", fetch, most_bytes), ""
                except Exception as e:  # noqa: BLE001 - why it failed is the result
                    items, error = [], f"{type(e).__name__}: {e}"[:200]
                out.append((address, not error, len(items), error, next((i[0][:80] for i in items[:sample_items]), ""), " ".join(f"{i[0]} {i[2][:500]}" for i in items[:sample_items])))
            yield pd.DataFrame(out, columns=["url", "ok", "count", "error", "sample", "words"])

    tried = addresses.select(F.col(url).alias(url)).mapInPandas(one, "url string, ok boolean, count long, error string, sample string, words string")
    words = T.strip_html(F.col("words"))
    han, latin = T.han_chars(words, 20_000), T.latin_letters(words, 20_000)
    lang = F.when(F.col("count") == 0, "").when(F.coalesce(F.try_divide(han, han + latin), F.lit(0.0)) >= threshold, "zh").otherwise("en")
    return tried.select("url", "ok", "count", "error", "sample", lang.alias("lang"))

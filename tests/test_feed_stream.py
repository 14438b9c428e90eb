"""Feeds as a stream: new items, restarts, failing sources; trial fetches."""

from __future__ import annotations

import json

from presswork.sources import feed_stream
from presswork.streaming import ingest

PAGE = '<rss><channel>{}</channel></rss>'
ITEM = "<item><title>{0}</title><link>https://x/{0}</link><description>text of {0}</description><pubDate>Mon, 15 Jan 2024 01:00:00 GMT</pubDate></item>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>一条新的消息</title><link href="https://z/1"/><summary>它用中文说了一件事情</summary><updated>2024-01-15T09:00:00+08:00</updated></entry><entry><title>no link</title></entry></feed>'


def stub(folder):
    """A fetcher of files: <folder>/<host>; a missing file is an error."""

    def fetch(address):
        path = f"{folder}/{address.split('/')[2]}"
        return open(path, "rb").read(), "text/html" if address.endswith("page") else "application/rss+xml"

    return fetch


def put(folder, host, *titles):
    (folder / host).write_text(PAGE.format("".join(ITEM.format(t) for t in titles)), encoding="utf-8")


def test_items_restarts_and_failures(spark, tmp_path):
    site = tmp_path / "site"
    site.mkdir()
    put(site, "a", "a1", "a2")
    put(site, "c", "c1")
    (site / "z").write_text(ATOM, encoding="utf-8")
    spark.dataSource.register(feed_stream.feed_source(stub(str(site)), "stub_feed"))
    addresses = json.dumps(["https://a/rss", "https://b/rss", "https://c/rss", "https://z/atom", "https://c/page", "http://169.254.169.254/x"])

    def run():
        stream = spark.readStream.format("stub_feed").option("sources", addresses).option("per_batch", 6).load()
        rows = []
        ingest.run_available(stream, lambda b, n: rows.extend(b.collect()), str(tmp_path / "checkpoint"))
        return sorted((r["source"].split("/")[2], r["title"] or "", (r["error"] or "").split(":")[0]) for r in rows)

    assert run() == [("169.254.169.254", "", "ValueError"), ("a", "a1", ""), ("a", "a2", ""), ("b", "", "FileNotFoundError"), ("c", "", "ValueError"), ("c", "c1", ""), ("z", "一条新的消息", "")]
    assert run() == []
    put(site, "a", "a2", "a3")
    put(site, "b", "b1")
    assert run() == [("a", "a3", ""), ("b", "b1", "")]


def test_slices_of_sources_and_replays(tmp_path):
    put(tmp_path, "a", "a1")
    put(tmp_path, "b", "b1", "b2")
    source = feed_stream.feed_source(stub(str(tmp_path)))(options={"sources": json.dumps(["https://a/", "https://b/"]), "per_batch": "1"})
    reader = source.simpleStreamReader(None)
    zero = reader.initialOffset()
    first, one = reader.read(zero)
    second, two = reader.read(one)
    assert [r[1] for r in first] == ["a1"] and [r[1] for r in second] == ["b1", "b2"]
    assert reader.read(two)[1] == two
    put(tmp_path, "b", "b2", "b3")
    assert [r[1] for r in reader.readBetweenOffsets(one, two)] == ["b2"]  # b3 belongs to a later batch
    assert [r[1] for r in reader.read(two)[0]] == ["b3"]


def test_trial_fetch(spark, tmp_path):
    put(tmp_path, "a", "A first title", "second")
    (tmp_path / "z").write_text(ATOM, encoding="utf-8")
    (tmp_path / "bad").write_text("<rss", encoding="utf-8")
    (tmp_path / "big").write_text("x" * 3000, encoding="utf-8")
    rows = spark.createDataFrame([(f"https://{h}/",) for h in ("a", "z", "bad", "big", "gone")] + [("https://a/page",), (None,)], "url string")
    got = {r["url"]: tuple(r)[1:] for r in feed_stream.trial_fetch(rows, stub(str(tmp_path)), most_bytes=2000).collect()}
    assert got["https://a/"] == (True, 2, "", "A first title", "en") and got["https://z/"] == (True, 1, "", "一条新的消息", "zh")
    assert all(not got[u][0] and got[u][1] == 0 and got[u][4] == "" for u in got if u not in ("https://a/", "https://z/"))
    assert got["https://big/"][2] == "ValueError: too large" and got["https://a/page"][2].startswith("ValueError: no feed") and got[None][2] == "ValueError: no host"

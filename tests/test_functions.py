"""Expressions on literal rows, with the cases the tables do not have (CJK, markup, broken input)."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from presswork.functions import html as H
from presswork.functions import pandas_text as P
from presswork.functions import replies as R
from presswork.functions import text as T
from presswork.operators import rules
from presswork.sources import feeds


def one(spark, value, body, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(body(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("body", "value", "expected"),
    [
        (T.strip_html, "<p>A &amp; B</p>\n <b>c&nbsp;</b>", "A & B c"),
        (T.strip_html, None, ""),
        (lambda c: T.truncate(c, 4), "ab  cd", "ab…"),
        (T.normalize_title, "Café — Déjà_Vu!! 新", "café déjà_vu 新"),
        (T.split_tags, "a，b、;c;d,e,f,g", ["a", "b", "c", "d", "e"]),
        (T.comma_tags, " a , b；c,,d", ["a", "b；c", "d"]),
        (T.strip_markdown, "# Title\n- **bold** text\n1. item", "Title bold text item"),
        (T.paragraphs, "a\n \nb\n\n\nc", ["a", "b", "c"]),
        (T.without_head, "a\n\nb", "b"),
        (T.without_head, "a", None),
        (T.looks_english, "word " * 20, True),
        (T.looks_english, "短标题 with few letters", False),
        (T.is_chinese, "abc 中", True),
        (T.chinese_ratio, "中文ab", 0.5),
        (T.chinese_ratio, "123", 0.0),
        (T.has_untranslated_sentence, "这是中文句子而且很长。Just 40 cents above the older edition of it!", True),
        (T.has_untranslated_sentence, "这是中文句子而且很长很长。", False),
        (T.looks_telegraphic, "厂商推出平台。本地处理数据。语音识别准确。团队明年开放测试。费用尚无消息。", True),
        (T.looks_telegraphic, "这家公司介绍了它的新平台，数据可以在本地处理，识别的结果也比以前更准确，所以用户会愿意在明年试用。", False),
        (T.is_real_body, "submitted by /u/someone [link] [comments]", False),
        (T.is_real_body, "A body that is long enough to be read.", True),
        (T.is_junk, "Please SUBSCRIBE today", True),
        (T.trim_tail, "A.\n\nB.\n\nSign up for more", "A.\n\nB."),
        (T.trim_tail, "Sign up for more", "Sign up for more"),
        (T.trim_tail, "A.\n\nsubscribe to our list\n\nEnd.", "A.\n\nsubscribe to our list\n\nEnd."),
        (lambda c: T.brief_digest(c, 20), "One sentence here. Another that is far too long for it.", "One sentence here."),
        (lambda c: T.brief_digest(c, 10), "No end", "No end。"),
        (T.story_words, "The Apple About neural networks", ["apple", "neural", "networks"]),
        (T.story_words, "中文a", ["中文", "文a"]),
        (T.url_host, "https://A.example.com:80/x", "A.example.com:80"),
        (T.url_host, "junk", ""),
        (T.safe_link, " HTTPS://x.y ", "HTTPS://x.y"),
        (T.safe_link, "javascript:x", ""),
        (T.redacted, "key sk-abcdefgh12 Bearer abc.def", "key *** ***"),
        (T.reading_minutes, "中" * 1000, 2),
        (P.unescape, "&eacute;&#8217;", "é’"),
        (P.casefolded, "Straße", "strasse"),
        (P.blocked_reason, "http://169.254.169.254/x", "link-local"),
        (P.blocked_reason, "http://0.0.0.0/", "link-local"),
        (P.blocked_reason, "http://[fe80::1]/", "link-local"),
        (P.blocked_reason, "http://[oops/", "malformed"),
        (P.blocked_reason, "http://127.0.0.1:8080/feed", ""),
        (P.blocked_reason, "http://10.0.0.1/feed", ""),
        (P.blocked_reason, "http://bridge.local/feed", ""),
        (P.is_internal_host, "http://10.0.0.1/feed", True),
        (P.is_internal_host, "http://localhost/", True),
        (P.is_internal_host, "https://example.com/", False),
        (H.images, "<img srcset='/a.jpg, /b.jpg'>", ["/a.jpg"]),
        (H.images, "<img srcset='/w.jpg 300w, /x.jpg 2x'><img data-srcset='/d.jpg 1x'><img src='/q.jpg?a=1&amp;b=2'>", ["/x.jpg", "/d.jpg", "/q.jpg?a=1&b=2"]),
        (lambda c: H.images(c, F.lit("https://x.org/a/b.html")), "<img src='../c.jpg'><img src='//y.org/d.jpg'>", ["https://x.org/c.jpg", "https://y.org/d.jpg"]),
        (P.blocked_reason, "https://example.com", ""),
        (P.blocked_reason, "http:///x", "no host"),
        (H.images, "<img src=/a.jpg><img data-src='/b.jpg'><img src='/logo.png'><img src='/a.jpg'><img srcset='/s.jpg 1x, /l.jpg 2x'>", ["/a.jpg", "/b.jpg", "/l.jpg"]),
        (R.same_story, "- Yes, the same", True),
        (R.same_story, "no", False),
        (R.halves, "One. Two. Three.", ["One. Two.", "Three."]),
        (R.halves, "One", ["One"]),
        (lambda c: R.chunks(T.paragraphs(c), 5, 4), "aaa\n\nbbb\n\nc", ["aaa", "bbb\n\nc"]),
        (lambda c: R.parse_translations(c, F.lit(2)), 'x {"t": ["a", "b"]} y', ["a", "b"]),
        (lambda c: R.parse_translations(c, F.lit(3)), '{"t": ["a", "b"]}', None),
        (lambda c: R.parse_translations(c, F.lit(1)), "broken", None),
        (R.reply_text, 'data: {"choices":[{"delta":{"content":"Hel"}}]}\ndata: {"choices":[{"delta":{"content":"lo"}}]}\ndata: [DONE]', "Hello"),
        (R.reply_text, '{"choices":[{"message":{"content":"Hi"}}]}', "Hi"),
    ],
)
def test_expressions(spark, body, value, expected):
    got = one(spark, value, body)
    assert got == expected if not isinstance(expected, float) else abs(got - expected) < 1e-9


def test_translation_gate(spark):
    rows = spark.createDataFrame([("x" * 1000, "y" * 300, True), ("x" * 1000, "y" * 100, False), ("x", "y", True), ("x", " ", False)], "s string, t string, ok boolean")
    assert all(r[0] == r[1] for r in rows.select(T.translation_usable(F.col("s"), F.col("t")), "ok").collect())


def test_relevance_and_classification(spark):
    assert tuple(one(spark, "Sure: yes 0.9 then 70", R.parse_relevance)) == (True, 70)
    assert tuple(one(spark, "不相关 95", R.parse_relevance)) == (False, None)
    got = one(spark, "- Models\nLLM、Agents，LLM\nsomething far too long to be a topic", lambda c: R.parse_classify(c, ["Models"]))
    assert (got["category"], got["topics"]) == ("Models", ["LLM", "Agents"])
    assert tuple(one(spark, "Title\nFirst\nsecond", R.parse_translate)) == ("Title", "First second")
    assert tuple(one(spark, "导读\nEN: Lead", R.split_digest)) == ("导读", "Lead")
    use = one(spark, '{"prompt_tokens": 5, "completion_tokens": 3, "completion_tokens_details": {"reasoning_tokens": 4}}', R.parse_usage)
    assert tuple(use) == (5, 3, 0, 4, 9)


def test_batches(spark):
    assert one(spark, [3, 3, 9, 1], lambda c: R.batches(c, 6), "array<int>") == [0, 0, 1, 2]


def test_article_text(spark):
    page = "<html><nav><p>navigation that is long enough to count</p></nav><article><p>%s</p><p>%s</p><p>short</p></article></html>" % ("First paragraph of text. " * 6, "Second paragraph of text. " * 6)
    text = one(spark, page, H.article_text)
    assert text.startswith("First") and "\n\nSecond" in text and "navigation" not in text and "short" not in text
    assert one(spark, "plain words", H.article_text) == ""


def test_junk_images_and_blocks(spark):
    rows = spark.createDataFrame([("/x/head-phones.jpg", "", "", "", False), ("/x/head.jpg", "", "", "", True), ("/p.jpg", "avatar200", "", "", True), ("/p.jpg", "", "", "120", True), ("data:x", "", "", "", True)], "u string, c string, i string, w string, junk boolean")
    assert all(r[0] == r[1] for r in rows.select(H.junk_image(F.col("u"), F.col("c"), F.col("i"), F.col("w")), "junk").collect())
    assert one(spark, ["Intro", "A long sentence that ends.", "1 digit"], H.contents, "array<string>") == ["Intro"]
    pairs = one(spark, ["Intro", "Body text ends."], lambda c: H.section_pairs(c, F.array(F.lit("Kopf"), F.lit("Text endet."))), "array<string>")
    assert [tuple(p) for p in pairs] == [("Intro", "Kopf"), ("Body text ends.", "Text endet.")]
    moved = one(spark, [0, 2, 5], lambda c: H.shift_anchors(F.transform(c, lambda i: F.struct(i.alias("i"), F.lit("u").alias("url"))), F.array(F.lit(1), F.lit(3))), "array<int>")
    assert [m["i"] for m in moved] == [0, 1, 3]


def test_image_sizes():
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (480).to_bytes(2, "big") + (640).to_bytes(2, "big") + b"\x00" * 8
    webp = b"RIFF\x00\x00\x00\x00WEBPVP8X" + b"\x00" * 8 + (639).to_bytes(3, "little") + (479).to_bytes(3, "little")
    assert {P.size_of(x) for x in (png, jpeg, webp, b"GIF89a" + b"\x80\x02\xe0\x01")} == {(640, 480)}
    assert P.size_of(b"junk") is None and P.size_of(None) is None


def test_relative_time_and_numbers(spark):
    now = datetime.datetime(2024, 1, 31)
    ages = [(-5, ""), (30, "just now"), (120, "2 min ago"), (7200, "2 h ago"), (3 * 86400, "3 d ago"), (8 * 86400, "2024-01-23")]
    rows = spark.createDataFrame([(now - datetime.timedelta(seconds=s), e) for s, e in ages], "t timestamp_ntz, e string")
    assert all(r[0] == r[1] for r in rows.select(T.relative_time(F.col("t"), F.lit(now).cast("timestamp_ntz")), "e").collect())
    assert [one(spark, n, T.compact_number, "long") for n in (999, 1234, 4_720_000, 3_000_000_000)] == ["999", "1.2K", "4.72M", "3B"]


def test_rule_patterns(spark):
    rows = spark.createDataFrame([("muse_2 is out", 1), ("a museum", None), ("穆斯新闻", 2)], "t string, e int")
    assert all(r[0] == r[1] for r in rows.select(rules.first_match(F.col("t"), [(1, "Muse"), (2, "穆斯")]), "e").collect())
    table = spark.createDataFrame([("muse",), ("穆斯",)], "k string").select("k", rules.rule_pattern(F.col("k")).alias("p"))
    hits = rows.crossJoin(table).filter(F.expr("rlike(t, p)")).select("t", "k").collect()
    assert {tuple(h) for h in hits} == {("muse_2 is out", "muse"), ("穆斯新闻", "穆斯")}


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<rss><channel><item><title>One</title><link>https://x/1</link><description>d</description><pubDate>Mon, 15 Jan 2024 01:00:00 GMT</pubDate></item>
<item><title>No link</title></item></channel></rss>""")
    rows = feeds.read_feeds(spark, str(tmp_path)).collect()
    assert [(r["title"], r["content"], str(r["published_at"])) for r in rows] == [("One", "d", "2024-01-15 09:00:00")]
    (tmp_path / "u.jsonl").write_text('{"at": "2024-01-01T00:00:00", "ok": true, "input_tokens": 4}\nbroken\n')
    assert feeds.read_usage(spark, str(tmp_path / "u.jsonl")).count() == 1
    assert feeds.fetched(spark.createDataFrame([("u",), ("bad",)], "url string"), lambda u: b"x" if u == "u" else 1 / 0).filter("body is null").count() == 1
    names = spark.createDataFrame([("u", bytearray(b"\x89PNG...."))], "u string, h binary").select(feeds.image_name(F.col("u"), F.col("h")).alias("n"))
    assert names.select("n", feeds.safe_image_name(F.col("n"))).first()[1]


def test_decoded(spark):
    rows = spark.createDataFrame([(bytearray("中文".encode("gb18030")),), (bytearray("é".encode()),), (bytearray(b"\xff\xfe\x81"),)], "b binary")
    assert [r[0] for r in rows.select(P.decoded("b")).collect()][:2] == ["中文", "é"]


def test_story_words_of_long_texts(spark):
    """pairs of neighbouring characters are those of the definition, and a text ten times as long takes no hundred times as long."""
    import time

    for text in ("中", "中😀文", "😀中😀", "中\n文", "x中 中x", "İ中"):
        low = spark.sql("select lower(:t) as l", args={"t": text}).first()["l"]
        assert one(spark, text, lambda c: F.sort_array(T.story_words(c))) == sorted({low[i : i + 2] for i in range(max(1, len(low) - 1))}, key=str.encode)
    long = spark.range(1000).select(F.concat(F.col("id").cast("string"), F.lit("word 中文" * 500)).alias("v")).select(F.size(T.story_words(F.col("v"))).alias("n"))
    began = time.perf_counter()
    assert long.agg(F.min("n")).first()[0] > 5
    assert time.perf_counter() - began < 10

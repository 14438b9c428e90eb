"""Rows that the tables don't have: Chinese texts, replies, pages with images, failing calls, files written and read again."""

from __future__ import annotations

import datetime as dt
import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from presswork.functions import html as H
from presswork.functions import keywords
from presswork.functions import pandas_text as P
from presswork.functions import replies as R
from presswork.functions import text as T
from presswork.operators import audits, enrichment, ingest, lifecycle, reading, rules, stories
from presswork.operators.settling import settled
from presswork.sources import feeds


def one(spark, body, *values):
    names = [f"c{n}" for n in range(len(values))]
    row = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return row.select(body(*map(F.col, names)).alias("r")).first()["r"]


def plain(value):
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


# Texts


LONG = "苹果公司在发布会上介绍了新款电脑的设计思路，说明了它的性能来自哪里，也解释了为什么这一次的价格没有变化，并且承认这样做会减少利润，但是可以留住用户，让他们在以后继续购买。"
SHORT = "新款电脑发布了。"


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        # title, title_zh, brief_zh, digest_zh, digest, reason, summary, content_zh, content_full
        (("T", "", "这是写好的早报，一句完整的话。", LONG, "", "", "", "", ""), "这是写好的早报，一句完整的话。"),
        (("T", "", "前半句中文。Just 40 cents above the older edition of it!", LONG, "", "", "", "", ""), LONG),
        (("T", "", None, SHORT, "", "价格没有变化，所以值得一读。", "", "", ""), SHORT + "价格没有变化，所以值得一读。"),
        (("T", "", None, SHORT, "", SHORT, "", "", ""), SHORT),
        (("T", "", None, None, "An English digest only.", SHORT, "摘要里另有一句话", "", ""), SHORT + "摘要里另有一句话。"),
        (("T", "", None, None, None, None, None, LONG, ""), LONG),
        (("T", "中文标题在这里", None, None, None, "short", None, "太短。", "English body " * 30), "中文标题在这里。"),
        (("Only English", "", None, None, None, None, None, None, "English body " * 30), ""),
    ],
)
def test_brief_text(spark, row, expected):
    assert one(spark, T.brief_text, *row) == expected


def test_brief_text_placeholder(spark):
    body = lambda *c: T.brief_text(*c, placeholder="({title}) is being translated")
    assert one(spark, body, "English", *[None] * 8) == "(English) is being translated"
    assert one(spark, body, *[None] * 9) == ""


def test_digest_keeps_whole_sentences(spark):
    clause = "一二三四五六七八九十" * 12 + "，" + "一二三四五六七八九十" * 12
    assert one(spark, T.brief_digest, clause) == "一二三四五六七八九十" * 12 + "，。"
    assert one(spark, T.brief_digest, "没有任何标点" * 60) == "没有任何标点" * 60 + "。"
    assert one(spark, T.brief_digest, "　全角空格　在两端。　") == "全角空格 在两端。"


def test_fallback_body(spark):
    body = lambda t, a, b: T.fallback_body(t, a, b)
    assert one(spark, body, "Title", "<p>submitted by /u/x [link] [comments]</p>", "<p>A body that is long enough to be read.</p>") == "A body that is long enough to be read."
    assert one(spark, body, "Title", "Comments", None) == "Title"
    straddle = "submitted by " * 31 + "x submitted   by someone who says quite enough here"
    assert one(spark, T.is_real_body, straddle) is True and one(spark, T.is_real_body, "submitted by " * 60 + "little") is False


def test_language_predicates(spark):
    assert one(spark, T.is_foreign, "Title", "word " * 40) is True and one(spark, T.is_foreign, "标题", "中文正文" * 40) is False
    assert one(spark, T.chinese_usable, "整句都是中文，而且没有别的语言。") is True
    assert one(spark, T.chinese_usable, "中文在前面而且够长够长够长。Then a sentence in English follows here.") is False
    loose = lambda c: T.chinese_usable(c, strict=False)
    assert one(spark, loose, "中文在前面而且够长够长够长够长够长。Then English follows.") is True and one(spark, loose, "English only") is False


def test_absolute_url(spark):
    assert one(spark, P.absolute_url, "https://a.b/c/d.html", "../x.png") == "https://a.b/x.png"
    assert one(spark, P.absolute_url, "https://a.b/c/", "//cdn.d/e.png") == "https://cdn.d/e.png" and one(spark, P.absolute_url, None, "x") == "x"


# Replies


def test_titles_and_digests(spark):
    assert one(spark, R.parse_title, "「新的标题」\n解释") == "新的标题" and one(spark, R.parse_title, "# - 标题") == "标题" and one(spark, R.parse_title, " \n ") is None
    assert plain(one(spark, R.split_digest, "**中文导读**第一句。\nEN: An English line.")) == {"zh": "中文导读第一句。", "en": "An English line."}
    assert plain(one(spark, R.split_digest, "只有中文。")) == {"zh": "只有中文。", "en": ""}


@pytest.mark.parametrize(
    ("reply", "expected"),
    [
        ('```json\n[{"h_zh": "一", "h_en": "One", "paras": ["a **b**", " "]}, {"h_zh": "二", "h_en": "Two", "paras": "c"}]\n```', [("一", "One", "a b"), ("二", "Two", "c")]),
        ("intro line\n## 第一节：\n- text one\n\ntext two\n### 第二节\nmore", [("", "", "intro line"), ("第一节", "", "text one\n\ntext two"), ("第二节", "", "more")]),
        ("## only a heading", None),
        ("plain text without headings", None),
        ("[not json]\n## A\nx\n## B\ny", [("", "", "[not json]"), ("A", "", "x"), ("B", "", "y")]),
        ("\n".join(f"## {n}\ntext" for n in range(9)), None),
        (None, None),
    ],
)
def test_sections(spark, reply, expected):
    got = one(spark, R.parse_sections, reply)
    assert (None if got is None else [tuple(s) for s in got]) == expected


def test_section_sides(spark):
    both = '[{"h_zh": "一", "h_en": "One", "paras": ["a"]}, {"h_zh": "二", "h_en": "", "paras": ["b"]}]'
    assert [tuple(s) for s in one(spark, lambda c: R.section_side(R.parse_sections(c), True), both)] == [("一", "a"), ("二", "b")]
    assert one(spark, lambda c: R.section_side(R.parse_sections(c), False), both) is None
    assert [tuple(s) for s in one(spark, lambda c: R.section_side(R.parse_sections(c), False), both.replace('"h_en": ""', '"h_en": "Two"'))] == [("One", "a"), ("Two", "b")]


# Pages


P1, P2, P3, P4 = (f"Paragraph number {n} is long enough to be part of the article, as it has so many words in it." for n in range(4))


def page(*parts):
    return "<html><body><article>" + "".join(parts) + "</article></body></html>"


def test_document_places_images_between_paragraphs(spark):
    html = page("<img src='/a.jpg'>", f"<p>{P1}</p>", "<p>short</p>", "<img src='/b.jpg'>", f"<p>{P2}</p>", f"<p>{P2}</p>", "<img src='/b.jpg'><img src='/logo.png'>", f"<p>{P3}<img data-src='/c.jpg?x=1&amp;y=2'></p>", f"<p>{P4}</p>", "<img src='/d.jpg'>")
    got = one(spark, H.document, html)
    assert got["text"] == "\n\n".join((P1, P2, P3, P4))
    assert [tuple(a) for a in got["anchors"]] == [(0, "/a.jpg"), (1, "/b.jpg"), (2, "/c.jpg?x=1&y=2")]


def test_document_cuts_images_of_the_tail(spark):
    html = page(f"<p>{P1}</p><p>{P2}</p><img src='/a.jpg'><p>{P3}</p><p>Sign up for our newsletter today, please do.</p>", "<img src='/promo.jpg'>")
    got = one(spark, H.document, html)
    assert "Sign up" not in got["text"] and [tuple(a) for a in got["anchors"]] == [(2, "/a.jpg")]
    assert plain(one(spark, H.document, page("<p>short</p>"))) == {"text": "", "anchors": []}
    assert plain(one(spark, H.document, "no tags at all")) == {"text": "", "anchors": []}


def test_pages_without_paragraphs_use_the_densest_part(spark):
    text = "A block of text that stands in a division and is long enough to count, with more words to follow it. " * 3
    html = f"<html><div>menu entry one of the long menu here</div><div>{text}<br>{text}</div></html>"
    assert one(spark, H.article_text, html) == text.strip()
    inside = f"<html><div>{text} outside</div><main>{text} inside<br>second block of the main part, long enough</main></html>"
    assert one(spark, H.article_text, inside).startswith(text.strip() + " inside\n\nsecond block")


def test_image_candidates(spark):
    html = """<meta property="og:image" content="https://x/og.jpg?a=1&amp;b=2"><meta name='twitter:image' content='/t.jpg'><link rel="image_src" href="/l.jpg">
      <img src="/icon.png"><img src="/photo.jpg" width="640"><img src="/small.jpg" width="80"><img class="avatar" src="/me.jpg"><img src="/photo.jpg">"""
    assert one(spark, H.image_candidates, html) == ["/photo.jpg", "https://x/og.jpg?a=1&b=2", "/t.jpg", "/l.jpg"]
    assert one(spark, H.image_candidates, None) == []
    meta = """<meta property="og:image:width" content="1200"><meta property="og:image:alt" content="A dog"><meta property="og:image:secure_url" content="/s.jpg"><meta name="twitter:image:src" content="/t.jpg">
      <link rel="nofollow image_src" href="/l.jpg"><img data-echo="" data-original="/first.jpg" src="/second.jpg"><img data-width="20" src="/tiny.jpg">"""
    assert one(spark, lambda c: H.image_candidates(c, F.lit("https://x.org/a")), meta) == ["https://x.org/first.jpg", "https://x.org/s.jpg", "https://x.org/t.jpg", "https://x.org/l.jpg"]


def test_joined_urls(spark):
    from urllib.parse import urljoin

    bases = ["https://x.org/a/b.html", "http://x.org", "https://x.org/a/b/?q=1#f", "https://x.org:8080/a//c"]
    urls = ["", "c.jpg", "/c.jpg", "//y.org/d", "../c.jpg", "../../../c", "./c/./d/../e", "?p=2", "#top", "https://z.org/../q", "mailto:a@b", "a/b/", "..", ".", "c?x=/../y", "中.jpg"]
    rows = spark.createDataFrame([(b, u) for b in bases for u in urls], "b string, u string")
    got = {(r["b"], r["u"]): r["j"] for r in rows.select("b", "u", T.joined_url(F.col("b"), F.col("u")).alias("j")).collect()}
    assert got == {k: urljoin(*k) for k in got}


def test_content_image(spark):
    found = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, "d")], "page_id long, pos int, url string")
    sizes = spark.createDataFrame([("a", 100, 100), ("b", 800, 600), ("c", 10, 10)], "url string, width int, height int")
    assert {r["page_id"]: r["url"] for r in audits.content_image(found, sizes).collect()} == {1: "b", 2: "c"}


def test_slots_and_moved_anchors(spark):
    anchors = [(0, "a"), (1, "b"), (3, "c"), (9, "d")]
    df = spark.createDataFrame([(anchors, [("H", True), ("p1", False), ("p2", False), ("H2", True), ("p3", False)])], "a array<struct<i:int,url:string>>, b array<struct<text:string,heading:boolean>>")
    assert df.select(H.image_slots(F.col("a"), F.col("b")).alias("r")).first()["r"] == [["a"], [], ["b"], [], [], ["c"]]
    moved = lambda s, t: [tuple(x) for x in df.select(H.moved_anchors(F.col("a"), F.lit(s), F.lit(t)).alias("r")).first()["r"]]
    assert moved(9, 3) == [(0, "a"), (0, "b"), (1, "c"), (3, "d")] and moved(4, 4) == anchors and moved(0, 3) == []


def test_image_sizes_of_odd_files():
    size = (480).to_bytes(2, "big") + (640).to_bytes(2, "big")
    frame = b"\xff\xc2\x00\x11\x08" + size + b"\x03" + bytes(9)
    filled = b"\xff\xd8\xff\xff\xff\xe1\x00\x04ab" + b"\xff\xc4\x00\x05\xff\xc0\x00" + b"\xff\xff" + frame
    assert P.size_of(filled) == (640, 480)
    assert P.size_of(b"\xff\xd8\xff\xda\x00\x04ab" + frame) is None and P.size_of(b"\xff\xd8\xff\xe1\xff") is None and P.size_of(b"\xff\xd8") is None
    head = b"RIFF\x00\x00\x00\x00WEBP"
    assert P.size_of(head + b"VP8 " + bytes(7) + b"\x9d\x01\x2a" + (640).to_bytes(2, "little") + (480 | 0x4000).to_bytes(2, "little")) == (640, 480)
    assert P.size_of(head + b"VP8L" + bytes(4) + b"\x2f" + (639 | 479 << 14).to_bytes(4, "little")) == (640, 480)
    assert P.size_of(head + b"VP8X" + bytes(8) + b"\x00" * 3) is None


# Stories and titles


def test_fuzzy_titles_equal_brute_force(spark):
    import random

    draw = random.Random(3)
    words = "苹果公司发布新款电脑性能提升价格不变用户可以购买今天上海人工智能模型开源研究论文产品".strip()
    titles = []
    for n in range(60):
        base = "".join(draw.choice(words) for _ in range(draw.randint(8, 40))) if n % 2 else " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 9))) for _ in range(draw.randint(3, 9)))
        titles.append(base)
        for _ in range(3):
            t = list(base)
            for _ in range(draw.randint(1, 4)):
                at = draw.randrange(len(t))
                t[at : at + draw.randint(0, 1)] = draw.choice(["", "x", "新"])
            titles.append("".join(t))
    known = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    window = 150
    low = {i: one_title for i, one_title in known.select("id", T.normalize_title(F.col("title"))).collect()}
    newest = sorted(low)[-window:]
    expected = {}
    for i, a in low.items():
        like = [k for k in newest if k != i and a and low[k] and (a == low[k] or SequenceMatcher(None, a, low[k]).ratio() > 0.9)]
        if like:
            expected[i] = min(like)
    got = {r["id"]: r["known_id"] for r in ingest.title_duplicates(known, known, window=window).collect()}
    assert got == expected and len(got) > 60
    assert ingest.title_duplicates(known.limit(0), known).count() == 0 and ingest.title_duplicates(known, known.limit(0)).count() == 0
    whole = spark.createDataFrame([(900, "中文标题没有空格所以只有一个词")], "id long, title string")
    more = spark.createDataFrame([(901, "中文标题没有空格所以只有一个词啊"), (902, None), (903, "!!")], "id long, title string")
    assert [tuple(r) for r in ingest.title_duplicates(more, whole).collect()] == [(901, 900)]


def test_title_fuzzy_query_equals_brute_force(spark, sf):
    from presswork.plans.articles import articles
    from presswork.plans.catalog import QUERIES

    low = dict(articles(spark, sf).select("id", T.normalize_title(F.col("title"))).collect())
    newest = sorted(low)[-500:]
    expected = {}
    for i, a in low.items():
        like = [k for k in newest if k != i and a and low[k] and (a == low[k] or (len(a) - len(low[k])) ** 2 < (0.1 * (len(a) + len(low[k]))) ** 2 + 1 and SequenceMatcher(None, a, low[k]).ratio() > 0.9)]
        if like:
            expected[i] = min(like)
    assert {r["id"]: r["known_id"] for r in QUERIES["title_fuzzy_dedup"](spark, sf).collect()} == expected


WORDS = ["muse", "Muse 2", "c++", "GPT-4o", ".net", "#ai", "a.b", "模型", "第1", "GPT模型", "x型", "é", "Straße", "K", "σας", "s", "ı", "the", "新", "a b", "&", "1", "_x"]


def random_rules(rng):
    return [(i, "".join([rng.choice(["", " "]), rng.choice(WORDS), rng.choice(["", " ", "", " " + rng.choice(WORDS)])])) for i in rng.sample(range(1000), rng.randint(0, 12))]


def test_keywords_equal_the_expression(spark):
    """The automaton and the join give what one pattern a rule gives: Latin, Chinese, punctuation, case and its odd letters."""
    rng = random.Random(8)
    text = lambda: "".join(rng.choice([*WORDS, " ", "\n", "museum", "MUSE", "Gpt-4O", "É", "\u212a", "ſ", "x", ".NET", "ΣΑΣ"]) + rng.choice(["", " ", "-", "2"]) for _ in range(rng.randint(0, 12)))
    texts = [(i, text()) for i in range(300)] + [(300, None), (301, "")]
    df = settled(spark.createDataFrame(texts, "id long, content_full string").withColumns({"deleted_at": F.lit(None).cast("string"), "starred": F.lit(0)}))
    for _ in range(6):
        block, star = sorted(random_rules(rng)), sorted(random_rules(rng))
        b = rules.first_match(F.col("content_full"), block)
        expected = {r["id"]: (r["b"], r["s"]) for r in df.select("id", b.alias("b"), F.when(b.isNull(), rules.first_match(F.col("content_full"), star)).alias("s")).collect()}
        for limit in (1 << 20, 0):
            got = rules.apply_rules(df, block[::-1], star, broadcast_bytes=limit).collect()
            assert {r["id"]: (r["blocked_by"], r["starred_by"]) for r in got} == expected
            assert all(r["blocked_word"] == dict(block).get(r["blocked_by"]) for r in got)


def test_many_rules_cost_no_more():
    import time

    text = "some words of a text that is searched " * 500
    few, many = (keywords.Matcher(tuple((i, "block", f"keyword{i}x") for i in range(n)), ("block", "star")) for n in (10, 200_000))

    def took(m):
        began = time.perf_counter()
        for _ in range(20):
            assert m.first(text) == [None, None]
        return time.perf_counter() - began

    took(few)
    assert took(many) < 20 * took(few)
    assert keywords.Matcher(((1, "block", " "),), ("block", "star")).first("a b") == [None, None]


def test_merge_equals_replay(spark, sf):
    """The rule over plain rows: candidates, pairs, order and links are all made here again."""
    from presswork.plans.articles import NOW, articles

    all_rows = articles(spark, sf).withColumns({"t": T.story_words(stories.story_title()), "w": T.story_words(F.substring(T.strip_html(F.col("content_full")), 1, 4000))}).collect()
    since = dt.datetime.fromisoformat(NOW) - dt.timedelta(days=30)
    rows = [r for r in all_rows if r["duplicate_of"] is None and r["deleted_at"] is None and r["relevance"] == 1 and r["status"] in ("processed", "failed") and r["published_at"] >= since]
    rows = sorted(rows, key=lambda r: (r["published_at"], r["id"]), reverse=True)[:40]
    over = lambda x, y: len(set(x) & set(y)) / min(len(x), len(y)) if x and y else 0.0
    pairs = []
    for n, a in enumerate(rows):
        for b in rows[n + 1 :]:
            if len(set(a["t"]) & set(b["t"])) >= 2 and over(a["t"], b["t"]) >= 0.25:
                pairs.append((over(a["t"], b["t"]) + over(a["w"], b["w"]) / 10, a, b))
    pairs.sort(key=lambda p: -p[0])
    links: dict = {}
    rank = lambda r: (bool((r["content_zh"] or "").strip()), len(r["content_full"] or ""), -r["published_at"].timestamp())
    for _, a, b in pairs[:8]:
        if a["id"] not in links and b["id"] not in links:
            keep, lose = (a, b) if rank(a) >= rank(b) else (b, a)
            links[lose["id"]] = keep["id"]
    frame = stories.candidates(articles(spark, sf), NOW, days=30)
    assert {r["id"]: r["duplicate_of"] for r in stories.merge(frame, lambda a, b: True).collect()} == links


def test_drafts_take_no_part_in_merging(spark):
    from presswork.plans.articles import NOW

    at = dt.datetime.fromisoformat(NOW)
    row = lambda i, status, body: (i, "Rocket engine reaches orbit again today", None, None, body, at - dt.timedelta(hours=i), 1, status, None, None, "https://x.org")
    schema = "id long, title string, title_zh string, content_zh string, content_full string, published_at timestamp_ntz, relevance int, status string, duplicate_of long, deleted_at timestamp_ntz, link string"
    df = spark.createDataFrame([row(1, "processed", "short body"), row(2, "draft", "a much longer body than the other"), row(3, "failed", "x"), row(4, "pending", "longest of all the bodies in this table")], schema)
    assert {tuple(r) for r in stories.merge(stories.candidates(df, NOW), lambda a, b: True).collect()} == {(3, 1)}
    chain = spark.createDataFrame([row(1, "processed", "xx"), row(2, "processed", "xxx"), row(3, "processed", "x")], schema)
    asked = []
    links = {tuple(r) for r in stories.merge(chain, lambda a, b: not asked.append((a, b)) and (a, b) != (1, 3)).collect()}
    assert links == {(1, 2), (3, 2)} and asked[0] == (1, 2)


def test_title_pairs_equal_all_pairs(spark, sf):
    from presswork.plans.articles import articles

    rows = articles(spark, sf)
    sets = [(r["id"], set(r["words"])) for r in rows.select("id", T.story_words(stories.story_title()).alias("words")).collect()]
    least = {}
    for i, w in sorted(sets, key=lambda x: x[0]):
        least.setdefault(frozenset(w), i)
    expected = set()
    for x, a in least.items():
        for y, b in least.items():
            if a < b and len(x & y) >= 2 and len(x & y) / min(len(x), len(y)) >= 0.25:
                expected.add((a, b, len(x & y), round(len(x & y) / min(len(x), len(y)), 9)))
    assert {(r["a"], r["b"], r["shared"], round(r["title_overlap"], 9)) for r in stories.title_pairs(rows).collect()} == expected
    with pytest.raises(ValueError):
        stories.article_pairs(rows, most=10)


@pytest.mark.parametrize(("frequent", "most_ranked", "min_overlap"), [(1000, 100_000, 0.25), (3, 100_000, 0.25), (0, 5, 0.4), (8, 20, 0.6)])
def test_title_pairs_of_all_kinds(spark, frequent, most_ranked, min_overlap):
    """Short and long titles of few words, Latin and Chinese, against all pairs; every word may be a frequent one."""
    rng = random.Random(7)
    latin = [f"word{chr(97 + i)}" for i in range(26)]
    titles = [" ".join(rng.choices(latin, weights=range(1, 27), k=rng.randint(1, 14))) for _ in range(120)]
    titles += ["".join(rng.choice("新模型发布研究产品用户数据") for _ in range(rng.randint(2, 40))) for _ in range(60)]
    titles += [rng.choice(latin) + " " + "".join(rng.choice("新模型发布") for _ in range(rng.randint(2, 9))) for _ in range(30)]
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(titles)], "id long, title string, title_zh string")
    sets = {}
    for r in df.select("id", T.story_words(stories.story_title()).alias("w")).collect():
        sets.setdefault(frozenset(r["w"]), r["id"])
    expected = {(min(a, b), max(a, b), len(x & y)) for x, a in sets.items() for y, b in sets.items() if a < b and len(x & y) >= 2 and len(x & y) / min(len(x), len(y)) >= min_overlap}
    got = stories.title_pairs(df, min_overlap, frequent, most_ranked).collect()
    assert {(r["a"], r["b"], r["shared"]) for r in got} == expected and len(got) == len(expected)


def test_a_shared_phrase_brings_no_pairs_together(spark):
    """Long titles that share one phrase: rows grow with the words, and nothing meets."""
    ids = spark.range(20_000)
    chars = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(53)), lambda k: F.decode(F.unhex(F.hex(F.pmod(F.xxhash64("id", k), F.lit(20000)) + 0x4E00)), "UTF-16BE")))
    df = settled(ids.select("id", F.lit(None).cast("string").alias("title_zh"), F.concat(F.lit("发布全新模型"), chars).alias("title")))
    assert stories.title_pairs(df).count() == 0


def test_openings_behind_empty_blocks_and_anchors(spark):
    shared = "The same first paragraph of all."
    rows = [(n, 1, "\n\n" * 25 + shared + "\n\n" * 30 + f"Own text number {n} of it.", [(0, "a"), (2, "b")]) for n in range(3)] + [(9, 2, f"{shared}\n\nother source", [])]
    df = spark.createDataFrame(rows, "id long, source_id int, content_full string, body_images array<struct<i:int,url:string>>")
    got = {r["id"]: r for r in stories.strip_shared_openings(df).collect()}
    assert got[9]["stripped"] == 0 and got[9]["content_full"] == rows[3][2]
    plain_ = spark.createDataFrame([(n, 1, f"{shared}\n\n\n\nOwn text number {n}.", [(0, "a"), (2, "b")]) for n in range(3)], df.schema)
    moved = {r["id"]: r for r in stories.strip_shared_openings(plain_).collect()}
    assert all(moved[n]["content_full"] == f"Own text number {n}." and [tuple(a) for a in moved[n]["body_images"]] == [(0, "a"), (1, "b")] for n in range(3))


# Management


def test_cleaners(spark):
    clean = lambda n, u, lang: plain(one(spark, audits.clean_source, n, u, lang))
    assert clean("", " https://a.b/feed ", "zh") == {"name": "a.b", "url": "https://a.b/feed", "lang": "zh", "error": ""}
    assert clean("x" * 300, "https://a.b", None)["error"] == "name too long" and clean("n", "ftp://a", "xx") == {"name": "n", "url": "ftp://a", "lang": "auto", "error": "not http"}
    assert clean("n", None, "en")["error"] == "no address" and clean("n", "https://" + "a" * 1001, "en")["error"] == "address too long"
    assert [one(spark, audits.clean_page, v) for v in ("3", "0", "-1", "x", None)] == [3, 1, 1, 1, 1]
    assert one(spark, audits.clean_keyword, " " + "k" * 120) == "k" * 100 and one(spark, lambda c: audits.clean_choice(c, ["a", "b"], "a"), " b ") == "b" and one(spark, lambda c: audits.clean_choice(c, ["a", "b"], "a"), None) == "a"


def test_reasons_of_deletion(spark):
    row = spark.createDataFrame([("blocked: x",), ("LLM",), (None,)], "degraded_reason string")
    assert [r[0] for r in row.select(lifecycle.delete_reason()).collect()] == ["blocked: x", "manual", "manual"]


def test_weather_text(spark):
    rows = spark.createDataFrame([("A", "clear", 10.4, 19.5, 60.0, 70.0, 95), ("B", None, None, None, None, None, None)], "city string, sky string, low double, high double, rain double, wind double, code int")
    assert {r["city"]: r["text"] for r in audits.weather_text(rows).collect()} == {"A": "A: clear, 10 to 20 °C, dress for mild weather, take an umbrella, gale, thunderstorms", "B": "B: no forecast"}


def test_anchor_outcomes(spark):
    rows = spark.createDataFrame([(2, 0, 1), (0, 0, 3), (0, 1, 3), (0, 0, 0)], "k int, s int, f int")
    assert [r[0] for r in rows.select(audits.anchor_outcome(F.col("k"), F.col("s"), F.col("f"))).collect()] == ["saved", "retry", "empty", "empty"]


def test_api_list_has_all_fields(spark, sf):
    from presswork.plans.articles import articles

    assert len(reading.api_articles(articles(spark, sf)).columns) == 19


# Calls


def test_ask_rotates_models_and_records_calls(spark):
    def bad(prompt):
        raise enrichment.FormatError("html")

    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, p string")
    got = {r["id"]: r for r in enrichment.ask(rows, "p", [bad, lambda p: p.upper()], attempts=3, calls="calls").collect()}
    assert got[1]["reply"] == "A" and [c["ok"] for c in got[1]["calls"]] == [False, True] and got[2]["reply"] is None and got[2]["calls"] == []
    once = enrichment.ask(rows, "p", bad, attempts=3, calls="calls")
    assert enrichment.usage_of(once, "calls").count() == 1  # a single model is not asked again for the same format
    log = enrichment.usage_of(enrichment.ask(rows, "p", [bad, lambda p: p], calls="calls"), "calls").orderBy("model").collect()
    assert [(r["ok"], r["prompt_chars"], r["reply_chars"]) for r in log] == [(False, 1, 0), (True, 1, 1)]


def test_translation_of_spans():
    calls = []
    chunks = ["a" * 1000, "b" * 1000, "c" * 1000, "d d.\n\nd e."]
    good = lambda c: c.upper()

    def together(span):
        calls.append(len(span))
        return [good(c) for c in span] if len(span) == 1 and span[0][0] != "d" else None

    def alone(chunk):
        calls.append(0)
        return good(chunk) if "\n" not in chunk else "x" * 500

    assert enrichment.translate("", together, alone, chunks) == "\n\n".join(map(good, ["a" * 1000, "b" * 1000, "c" * 1000, "d d.", "d e."]))
    assert calls == [4, 2, 1, 1, 2, 1, 1, 0, 0, 0, 0]
    assert enrichment.translate("", together, alone, chunks, calls=6) is None
    assert enrichment.translate("", lambda s: None, lambda c: "", ["one sentence only"]) is None


def test_translations_of_bodies(spark):
    body = "\n\n".join("An English paragraph that goes on for a while, as they do here." for _ in range(6))
    zh = "这是一个中文的段落，它和原来的段落说的是同样的事情。"

    def model(prompt):
        if "{" in prompt:
            return json.dumps({"t": [zh * 6 for _ in json.loads(prompt[prompt.rindex("\n") + 1 :])]}, ensure_ascii=False)
        return zh

    rows = spark.createDataFrame([(1, body), (2, "中文正文" * 100)], "id long, content_full string")
    assert [tuple(r) for r in enrichment.translations(rows, model).collect()] == [(1, zh * 6)]
    assert [tuple(r) for r in enrichment.translations(rows, lambda p: 1 / 0).collect()] == [(1, None)]


def test_processing_of_articles(spark):
    answers = {
        "Is this": "yes 88", "Summarise": "这是一份摘要，它说明了这件事情的经过。", "Write a digest": "这是导读的第一句话，说得很清楚。\nEN: A digest.", "Why": "因为它给出了新的数据。",
        "Choose": "model\n推理, 开源", "Translate the title": "「中文标题」", "Give tags": "a，b", "Write a brief": "早报的一句话，它是完整的。",
    }
    model = lambda prompt: next(a for k, a in answers.items() if prompt.startswith(k))
    rows = spark.createDataFrame([(1, "An English title", "<p>" + "A body in English that is long enough. " * 20 + "</p>")], "id long, title string, content_full string")
    got = plain(enrichment.processed(rows, model, ["model", "paper"]).first())
    assert got == {
        "id": 1, "relevance": 1, "score": 88, "summary": answers["Summarise"], "digest": "这是导读的第一句话，说得很清楚。", "digest_en": "A digest.", "reason": answers["Why"], "category": "model",
        "topics": '["推理","开源"]', "title_zh": "中文标题", "digest_zh": "", "tags": "a,b", "brief_zh": answers["Write a brief"], "status": "processed", "degraded_reason": None,
    }
    no = plain(enrichment.processed(rows, lambda p: "no 95" if p.startswith("Is this") else 1 / 0, ["model"]).first())
    assert (no["relevance"], no["score"], no["summary"], no["digest"], no["tags"], no["status"]) == (0, None, None, None, None, "processed")
    down = plain(enrichment.processed(rows, lambda p: 1 / 0, ["model"]).first())
    assert (down["relevance"], down["status"], down["tags"]) == (1, "failed", None) and down["summary"].startswith("A body in English") and down["reason"] and down["digest"]
    part = plain(enrichment.processed(rows, lambda p: 1 / 0 if p.startswith(("Write", "Why", "Choose")) else model(p), ["model"]).first())
    assert part["status"] == "processed" and part["category"] is None and part["brief_zh"] is None and part["digest"].startswith("A body") and part["reason"].startswith("A body")


def test_refetched_rows_lose_what_was_derived(spark):
    rows = spark.createDataFrame([(1, "old", "processed", "t", "z"), (2, "old", "processed", "t", "z")], "id long, content_full string, status string, tags string, content_zh string")
    fresh = spark.createDataFrame([(1, "new"), (2, "")], "id long, content_full string")
    assert {tuple(r) for r in enrichment.refetched(rows, fresh).collect()} == {(1, "new", "pending", None, None), (2, "old", "processed", "t", "z")}


def test_good_replies(spark):
    assert one(spark, enrichment.good_brief, "一句完整的中文话，可以推送。") == "一句完整的中文话，可以推送。"
    assert [one(spark, enrichment.good_brief, x) for x in ("没有句号的话", "English only.", "长" * 210 + "。", "中文一句话在这里。But this one is in English!")] == [None] * 4
    assert one(spark, enrichment.good_digest, "小标题\n译文的第一句，说清了事情。") == "译文的第一句，说清了事情。" and one(spark, enrichment.good_digest, "word " * 20) is None


def test_fetching_tries_again_and_keeps_limits(spark):
    seen = {}

    def fetch(url):
        seen[url] = n = seen.get(url, 0) + 1
        if url.endswith("gone"):
            raise feeds.NotFetched("410")
        if url.endswith("flaky") and n < 3:
            raise OSError("reset")
        if url.endswith("down"):
            raise OSError("refused")
        return b"x" * (50 if url.endswith("large") else 5)

    names = ("flaky", "down", "gone", "large", "fine")
    rows = spark.createDataFrame([(f"https://a.b/{n}",) for n in names] + [("http://127.0.0.1/x",), (None,)], "url string").coalesce(1)
    got = {r["url"]: (r["body"] and len(r["body"]), r["tries"], r["error"]) for r in feeds.fetched(rows, fetch, retries=2, pause=0, most_bytes=10, blocked=True).collect()}
    at = lambda n: got[f"https://a.b/{n}"]
    assert at("flaky") == (5, 3, None) and at("down") == (None, 3, "OSError: refused") and at("gone") == (None, 1, "410") and at("large") == (None, 1, "too large") and at("fine") == (5, 1, None)
    assert got["http://127.0.0.1/x"] == (None, 0, "not public") and got[None] == (None, 0, "no host")
    pages = feeds.fetched_pages(rows.filter("url like '%fine'"), lambda u: "中".encode("gb18030")).first()
    assert pages["html"] == "中"


def test_images_are_measured_kept_and_placed(spark, tmp_path):
    png = lambda w, h: b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    store = {"https://a.b/1": png(800, 600), "https://a.b/2": png(20, 20), "https://a.b/3": b"<html>"}
    rows = spark.createDataFrame([(u,) for u in store], "url string")
    images = feeds.fetched_images(rows, lambda u: store[u])
    assert {r["url"][-1]: r["outcome"] for r in images.collect()} == {"1": "kept", "2": "too_small", "3": "failed"}
    for _ in range(2):
        feeds.stored_images(images, str(tmp_path / "img"))
    assert spark.read.parquet(str(tmp_path / "img")).count() == 1
    anchors = spark.createDataFrame([(7, 2, "https://a.b/1"), (7, 0, "https://a.b/2"), (8, 0, "https://a.b/9")], "id long, i int, url string")
    got = {r["id"]: r for r in feeds.localized(anchors, images).collect()}
    assert [(a["i"], a["url"]) for a in got[7]["anchors"]] == [(2, "https://a.b/1")] and got[7]["anchors"][0]["local"].startswith("/img/") and (got[7]["kept"], got[7]["too_small"], got[7]["failed"]) == (1, 1, 0)
    assert got[8]["anchors"] == [] and got[8]["failed"] == 1


def test_refilled_bodies(spark):
    pages = {"https://a.b/1": page(f"<p>{P1}</p><img src='/x.jpg'><p>{P2}</p><p>{P3}</p>").encode(), "https://a.b/2": b"<html><p>nothing here</p></html>"}
    queue = spark.createDataFrame([(1, "https://a.b/1"), (2, "https://a.b/2"), (3, "https://a.b/3")], "id long, link string")
    got = {r["id"]: r for r in feeds.refilled(queue, lambda u: pages[u], pause=0).collect()}
    assert [got[n]["outcome"] for n in (1, 2, 3)] == ["filled", "empty", "retry"] and [tuple(a) for a in got[1]["body_images"]] == [(1, "/x.jpg")] and got[2]["content_full"] is None


def test_forecasts_are_asked_for_once_an_hour(spark, tmp_path):
    from presswork.sources import weather

    log = tmp_path / "calls"

    def fetch(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        if "nowhere" in url:
            return b'{"results": []}'
        if url.startswith("https://geo"):
            return b'{"results": [{"name": "Town", "latitude": 1.5, "longitude": 2.5}]}'
        return b'{"current": {"temperature_2m": 20.5, "weather_code": 95, "wind_speed_10m": 40}, "daily": {"temperature_2m_max": [25], "temperature_2m_min": [15], "precipitation_probability_max": [60]}}'

    cities = spark.createDataFrame([(" A ",), ("A",), ("nowhere",), ("",)], "city string").coalesce(1)
    ask = lambda now: {r["city"]: r for r in weather.forecasts(cities, fetch, "https://geo", "https://sky", now, str(tmp_path / "cache")).collect()}
    got = ask("2024-01-31 10:05:00")
    assert set(got) == {"A", "nowhere"} and (got["A"]["resolved"], got["A"]["now"], got["A"]["rain"], got["A"]["code"]) == ("Town", 20.5, 60.0, 95) and got["nowhere"]["now"] is None
    first = sum("name=A" in line for line in log.read_text().splitlines())
    assert ask("2024-01-31 10:59:00")["A"]["now"] == 20.5 and sum("name=A" in line for line in log.read_text().splitlines()) == first
    ask("2024-01-31 11:00:00")
    assert sum("name=A" in line for line in log.read_text().splitlines()) > first
    assert weather.forecasts(cities, lambda u: b"[]", "https://geo", "https://sky", "2024-01-31 10:00:00").filter("now is null").count() == 2


# Files


def test_dates_are_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "reports")
    rows = lambda *r: spark.createDataFrame(list(r), "date string, n int")
    feeds.write_by_date(rows(("2024-01-01", 1), ("2024-01-02", 2)), path)
    before = spark.read.parquet(path).filter("n = 1").collect()
    feeds.write_by_date(rows(("2024-01-02", 20), ("2024-01-02", 21), ("2024-01-03", 3)), path)
    feeds.write_by_date(rows(("2024-01-02", 20), ("2024-01-02", 21), ("2024-01-03", 3)), path)  # again: the same table
    assert sorted((str(r["date"]), r["n"]) for r in spark.read.parquet(path).collect()) == [("2024-01-01", 1), ("2024-01-02", 20), ("2024-01-02", 21), ("2024-01-03", 3)]
    assert spark.read.parquet(path).filter("n = 1").collect() == before


def test_usage_log_grows_and_skips_broken_lines(spark, tmp_path):
    path = str(tmp_path / "usage")
    rows = spark.createDataFrame([(1, True), (2, False)], "seq long, ok boolean")
    feeds.append_usage(rows, path)
    feeds.append_usage(rows.limit(1), path)
    (tmp_path / "usage" / "extra.json").write_text('{"seq": 9, "ok": true}\nnot json\n')
    assert sorted(r["seq"] for r in feeds.read_usage(spark, path).collect()) == [1, 1, 2, 9]


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from presswork.operators.settling import shared_folder

    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError):
        shared_folder(cluster)


def test_issues_keep_what_they_were(spark, tmp_path):
    """An issue is read as it was written, whatever comes later; old and broken ones get what they lack."""
    schema = "no int, section string, rank int, id long, title string, brief string, source string, category string, starred int, link string, published string"
    rows = [(0, "First", 1, 7, "A <b> & \"q\"", "Text。", "src", "model", 1, "https://x/7", "2024-01-01 10:00"), (0, "First", 3, 8, "B", "Other.", "src", "", 0, "https://x/8", ""), (2, "Third", 1, 7, "A", "Text。", "src", None, 1, "https://x/7", "")]
    path = str(tmp_path / "issues")
    for date, kept in (("2024-01-01", rows), ("2024-01-02", rows[:1]), ("2024-01-03", [])):
        feeds.write_by_date(reading.brief_issue(spark.createDataFrame(kept, schema), date, f"Today {date}"), path)
    feeds.write_by_date(reading.brief_issue(spark.createDataFrame(rows[1:2], schema), "2024-01-02", "Again"), path)  # the same day is replaced
    got = {r["date"]: r for r in reading.issues_view(spark.read.parquet(path)).collect()}
    assert [len(got[d]["sections"]) for d in sorted(got)] == [2, 1, 0] and got["2024-01-03"]["article_count"] == 0
    one_, third = got["2024-01-01"]["sections"]
    assert (one_["name"], [e["id"] for e in one_["entries"]], [e["place"] for e in one_["entries"]], third["entries"][0]["category"]) == ("First", [7, 8], [1, 2], None)
    assert one_["entries"][0]["title"] == 'A <b> & "q"' and one_["text"].startswith("1. ★ A <b>") and got["2024-01-02"]["title"] == "Again"
    old = spark.createDataFrame([("2023-01-01", "{not json"), ("2023-01-02", '{"sections": [{"no": 0, "name": "n", "entries": [{"place": 1, "title": "T", "brief": "b", "source": "s", "category": "", "published": "", "starred": false}]}]}')], "date string, content_json string")
    seen = reading.issues_view(old.selectExpr("*", "'' as text", "'' as markdown", "0L as section_count", "0L as article_count")).orderBy("date").collect()
    assert seen[0]["title"] == "Brief · 2023-01-01" and seen[0]["sections"] == [] and seen[1]["sections"][0]["text"] == "1. T\nb\n—— s"


def test_rss_document(spark, tmp_path):
    items = spark.createDataFrame([(1, "A & <b>", "https://x/1?a=1&b=2", "sum", "t1, t2", True), (2, "B", "https://x/2", "x" * 700, "(no tags)", False)], "rank int, title string, link string, summary string, tags string, degraded boolean")
    rows = items.withColumn("published_at", F.lit("2024-01-15 08:00:00").cast("timestamp_ntz"))
    feeds.write_rss(reading.rss_channel(rows, "Daily & more", "https://news/", "d"), str(tmp_path / "rss"))
    text = next((tmp_path / "rss").glob("part-*")).read_text(encoding="utf-8")
    assert text.startswith('<?xml version="1.0" encoding="UTF-8"?>') and '<rss version="2.0">' in text and "Daily &amp; more" in text and '<guid isPermaLink="false">https://x/2</guid>' in text
    back = feeds.read_feeds(spark, str(tmp_path / "rss")).orderBy("link").collect()
    assert [(r["title"], r["link"], len(r["content"])) for r in back] == [("A & <b> (t1, t2)", "https://x/1?a=1&b=2", 14), ("B (no tags)", "https://x/2", 600)]
    feeds.write_rss(reading.rss_channel(rows.limit(0), "Empty", "https://news/", "d"), str(tmp_path / "none"))
    assert feeds.read_feeds(spark, str(tmp_path / "none")).count() == 0


def test_deep_pages_equal_plain_ones(spark):
    rows = settled(spark.range(5000).select("id", F.when(F.col("id") % 50 != 0, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, (id * 37) % 900)")).alias("published_at")))
    plain_ = [r["id"] for r in rows.orderBy(F.desc("published_at"), F.desc("id")).collect()]
    for number in (1, 2, 333, 499, 500, 501, 9999):
        at = (min(number, 500) - 1) * 10
        assert [r["id"] for r in reading._page(rows, ["published_at", "id"], number, 10, near=0).collect()] == plain_[at : at + 10]
    assert reading._page(rows.limit(0), ["id"], 3, 10, near=0).count() == 0
    assert [r["id"] for r in reading.by_id(rows, 3, 4).collect()] == [4991, 4990, 4989, 4988]


def test_paired_sections(spark):
    """Sections pair where they begin at the same blocks; else all is one pair; image slots are cut along."""
    block = "array<struct<text: string, heading: boolean>>"
    b = lambda *xs: [(x, x.isupper()) for x in xs]
    slots = lambda blocks, name: [[f"{name}{k}"] for k in range(len(blocks) + 1)]
    cases = [(b("a", "H", "b", "c", "K", "d"), b("x", "I", "y", "z", "L", "w")), (b("H", "b", "c"), b("I", "y")), (b("a", "H", "b"), b("I", "y", "z")), (b("H", "b"), []), ([], []), (b("a"), b("x")), (b("H", "K"), b("I", "L"))]
    rows = spark.createDataFrame([(n, x, y, slots(x, "l"), slots(y, "r")) for n, (x, y) in enumerate(cases)], f"n int, l {block}, r {block}, ls array<array<string>>, rs array<array<string>>")
    got = {r["n"]: r["p"] for r in rows.select("n", H.paired_sections(F.col("l"), F.col("r"), F.col("ls"), F.col("rs")).alias("p")).collect()}
    texts = lambda p: [("".join(x["text"] for x in s["left"]), "".join(x["text"] for x in s["right"])) for s in p]
    assert [texts(got[n]) for n in range(7)] == [[("a", "x"), ("Hbc", "Iyz"), ("Kd", "Lw")], [("Hbc", "Iy")], [("aHb", "Iyz")], [], [], [("a", "x")], [("H", "I"), ("K", "L")]]
    assert [[x[0] for x in s["left_slots"]] for s in got[0]] == [["l0"], ["l1", "l2", "l3"], ["l4", "l5", "l6"]]
    assert [x[0] for x in got[1][0]["right_slots"]] == ["r0", "r1", "r2"] and [x[0] for x in got[6][1]["left_slots"]] == ["l1", "l2"]
    bare = rows.select(H.paired_sections(F.col("l"), F.col("r")).alias("p")).first()["p"]
    assert len(bare) == 3 and "left_slots" not in bare[0].asDict()


def test_rules_of_one_keyword_are_one(spark, monkeypatch):
    """many rules of few keywords reach neither the driver nor an automaton; rules whose automaton is large go by the join. Results stay."""
    texts = spark.createDataFrame([(1, "a Muse here"), (2, "c++ only"), (3, "none")], "id long, content_full string").withColumns({"deleted_at": F.lit(None).cast("string"), "starred": F.lit(0)})
    block = spark.range(5, 20_000).select("id", F.when(F.col("id") % 2 == 0, " muse").otherwise("MUSE ").alias("keyword"))
    star = spark.range(100, 20_000).select("id", F.concat(F.lit("c"), F.repeat(F.lit("+"), (F.col("id") % 40).cast("int"))).alias("keyword"))
    sent = []
    real = rules.first_rules
    monkeypatch.setattr(rules, "first_rules", lambda spark, text, found, kinds: sent.append(len(found)) or real(spark, text, found, kinds))
    for limit in (64 << 20, 10_000, 0):
        got = {r["id"]: (r["blocked_by"], r["starred_by"], r["blocked_word"]) for r in rules.apply_rules(texts, block, star, broadcast_bytes=limit).collect()}
        assert got == {1: (5, None, "MUSE "), 2: (None, 120, None), 3: (None, None, None)}
    assert sent == [42]


def test_title_pairs_are_not_shuffled(spark, sf):
    """behind the join of titles under their keys no pair goes through an exchange."""
    from presswork.plans.articles import articles

    plan = stories.title_pairs(articles(spark, sf))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Exchange" not in above and "Aggregate" not in above and plan.count("Join") == 1


@pytest.mark.parametrize(("frequent", "most_ranked", "min_overlap"), [(1000, 100_000, 0.25), (12, 100_000, 0.25), (0, 100_000, 0.25), (0, 90, 0.4), (5, 30, 0.6)])
def test_title_pairs_by_bits_and_codes(spark, monkeypatch, frequent, most_ranked, min_overlap):
    """more words than bits and marks, keys of both kinds of words, against all pairs; rarest common words among both."""
    monkeypatch.setattr(stories, "HOT_LONGS", 1)
    monkeypatch.setattr(stories, "SIGNATURE_LONGS", 1)
    rng = random.Random(11)
    vocabulary = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    titles = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 3) for i in range(300)], k=rng.randint(2, 24))) for _ in range(350)]
    titles += [" ".join(t.split()[: rng.randint(2, 9)] + rng.sample(vocabulary, 3)) for t in titles[:80]]
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(titles)], "id long, title string, title_zh string")
    sets = {}
    for i, t in enumerate(titles):
        sets.setdefault(frozenset(t.split()), i)
    expected = {(min(a, b), max(a, b), len(x & y)) for x, a in sets.items() for y, b in sets.items() if a < b and len(x & y) >= 2 and len(x & y) / min(len(x), len(y)) >= min_overlap}
    got = stories.title_pairs(df, min_overlap, frequent, most_ranked).collect()
    assert {(r["a"], r["b"], r["shared"]) for r in got} == expected and len(got) == len(expected) > 100


def test_title_pairs_look_at_words_once(spark, sf):
    """a pair's words are intersected once, behind a join on whole numbers that bounds them by bits first; no method is too long to be compiled."""
    from presswork.plans.articles import articles

    df = stories.title_pairs(articles(spark, sf))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "bit_count" in join and "array_intersect" not in join
    assert dict(df.dtypes) == {"a": "bigint", "b": "bigint", "shared": "int", "title_overlap": "double"}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = spark.sparkContext._jvm.PythonSQLUtils.explainString(stories.title_pairs(articles(spark, sf))._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(part.split(";")[0]) for part in code.split("maxMethodCodeSize:")[1:]]
    assert sizes and max(sizes) < 8000


def test_titles_are_cut_before_the_join(spark, sf):
    """a query over titles takes no texts through the join with the labels."""
    from presswork.plans.articles import articles

    plan = articles(spark, sf).select("id", "title", "title_zh", "relevance")._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" in plan[plan.index("Join") :] and "text#" not in plan[: plan.index("Join")]

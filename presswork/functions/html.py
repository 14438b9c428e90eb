"""Expressions over raw HTML: dropping page furniture, paragraphs, main text, images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.functions import text as T

#: Elements whose text is never part of an article, and containers that are most likely to hold it.
DROPPED = ("script", "style", "noscript", "iframe", "form", "svg", "button", "nav", "aside", "footer", "header")
CONTAINERS = ("article", "main")


def without_furniture(html: Column) -> Column:
    """Comments, dropped elements with their content, and their stray tags become spaces."""
    names = "|".join(DROPPED)
    h = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    h = F.regexp_replace(h, rf"(?is)<({names})\b[^>]*>.*?</\1>", " ")
    return F.regexp_replace(h, rf"(?i)</?(?:{names})\b[^>]*>", " ")


def paragraph_texts(html: Column, min_chars: int = 24) -> Column:
    """The texts of ``<p>`` elements in order, without short and junk ones."""
    blocks = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), T.strip_html)
    return F.filter(blocks, lambda p: (F.char_length(p) >= min_chars) & ~T.is_junk(p))


#: The tags that end a block of text.
BLOCK_TAGS = ("p", "div", "section", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "tr", "br")


def block_texts(html: Column, min_chars: int = 24) -> Column:
    """Texts between block-level tags, for pages without paragraphs."""
    parts = F.split(html, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>")
    return F.filter(F.transform(parts, T.strip_html), lambda p: (F.char_length(p) >= min_chars) & ~T.is_junk(p))


def containers(html: Column) -> Column:
    """The inner HTML of every likely container."""
    found = [F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>(.*?)</{name}>"), F.lit(1)) for name in CONTAINERS]
    return F.concat(*found)


def text_length(paragraphs: Column) -> Column:
    return F.aggregate(paragraphs, F.lit(0), lambda n, p: n + F.char_length(p))


def _measured(html: Column) -> Column:
    return T.bound(paragraph_texts(html), lambda p: F.struct(text_length(p).alias("n"), p.alias("p")))


def densest_block(html: Column) -> Column:
    """For pages without paragraphs: of the containers the one with most blocks of text, else the ``<div>`` with the longest
    text, else the whole page."""

    def best(parts: Column, weight) -> Column:
        # Of equal ones the first, so its place counts backwards.
        ranked = F.filter(F.transform(parts, lambda h, i: F.struct(weight(block_texts(h)).alias("n"), (-i).alias("at"), h.alias("h"))), lambda x: x["n"] > 0)
        return F.array_max(ranked)["h"]

    likely = [F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>(.*?)</{name}>"), F.lit(1)) for name in CONTAINERS]
    divs = F.regexp_extract_all(html, F.lit(r"(?is)<div\b[^>]*>(.*?)</div>"), F.lit(1))
    return F.coalesce(*[best(x, F.size) for x in likely], best(divs, text_length), html)


def best_paragraphs(html: Column, min_chars: int = 200) -> Column:
    """The paragraphs of the container with the longest text, or of the whole page if that has more and no container has enough;
    where there are none, the blocks of the densest part."""

    def choose(best: Column) -> Column:
        enough = best.isNotNull() & (best["n"] >= min_chars)
        better = lambda whole: F.when(best.isNotNull() & (best["n"] >= whole["n"]), best["p"]).otherwise(whole["p"])
        return F.when(enough, best["p"]).otherwise(T.bound(_measured(html), better))

    chosen = T.bound(F.array_max(F.transform(containers(html), _measured)), choose)
    return T.bound(chosen, lambda p: F.when(F.size(p) > 0, p).otherwise(block_texts(densest_block(html))))


def without_repeats(items: Column) -> Column:
    """Neighbouring equal items once."""
    return T.bound(items, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def article_text(html: Column, min_chars: int = 200, max_chars: int = 40_000) -> Column:
    """The article's plain text, paragraphs apart by empty lines; '' where there is too little of it."""
    joined = lambda page: F.array_join(without_repeats(best_paragraphs(page, min_chars)), "\n\n")
    body = T.bound(T.bound(without_furniture(html), joined), T.trim_tail)
    looks = F.substring(html, 1, 200).rlike(r"(?i)<\s*/?\s*[a-z]")
    return T.bound(body, lambda t: F.when(looks & (F.char_length(t) >= min_chars), F.substring(t, 1, max_chars)).otherwise(""))


#: Attributes that hold an image's address, in order, and addresses of images that are no content.
SOURCES = ("src", "data-src", "data-original", "data-lazy-src")
LAZY_SOURCES = (*SOURCES, "data-echo")
NOISE = r"(?i)(pixel|spacer|blank|placeholder|emoji|gravatar|avatar|badge|logo|icon|ads?[-_/]|doubleclick|scorecardresearch)"
#: Words in an address, a class or an id, and whole names of files, by which icons and furniture are known.
ICON_TOKENS = (
    "logo", "favicon", "qrcode", "qr", "gravatar", "spacer", "placeholder", "sprite", "blank", "pixel", "icon", "avatar", "emoji", "spinner",
    "loader", "watermark", "badge", "button", "ads", "advert",
)
ICON_STEMS = (
    "head", "header", "banner", "bg", "background", "share", "shared", "social", "author", "profile", "signature", "arrow", "default", "generic",
    "logo",
)


def attribute(tag: Column, name: str) -> Column:
    """The attribute's value in either kind of quotes, or bare; '' if there is none."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
    return T.trimmed(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]))


def widest_of(srcset: Column) -> Column:
    """The candidate of greatest weight of a srcset: its width, or a thousand times its density; without either 0. Of equals the first."""
    parts = F.filter(F.transform(F.split(srcset, ","), T.trimmed), lambda p: p != "")

    def weighed(p: Column, i: Column) -> Column:
        second = F.lower(F.get(F.split(p, T.BLANK + "+"), F.lit(1)))
        width = F.regexp_extract(second, "^([0-9]+)w$", 1).try_cast("double")
        density = F.floor(F.regexp_extract(second, r"^([0-9]*\.?[0-9]+|[0-9]+\.)x$", 1).try_cast("double") * 1000).cast("double")
        return F.struct(F.coalesce(width, density, F.lit(0.0)).alias("w"), (-i).alias("at"), F.get(F.split(p, T.BLANK + "+"), F.lit(0)).alias("url"))

    return F.coalesce(F.array_max(F.transform(parts, weighed))["url"], F.lit(""))


def images(html: Column, base_url: Column | None = None, limit: int = 6) -> Column:
    """Addresses of a page's images in order: first filled source attribute, else the widest of srcset or data-srcset, entities
    decoded, made absolute where there is a base; without data addresses, repeats and noise."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    srcset = lambda tag: T.first_nonempty(attribute(tag, "srcset"), attribute(tag, "data-srcset"))
    url = lambda tag: T.trimmed(T.unescape_common(T.first_nonempty(*[attribute(tag, a) for a in SOURCES], widest_of(srcset(tag)))))
    found = F.filter(F.transform(tags, url), lambda u: (u != "") & ~F.startswith(u, F.lit("data:")))
    if base_url is not None:
        found = F.transform(found, lambda u: T.joined_url(base_url, u))
    return F.slice(F.filter(F.array_distinct(found), lambda u: ~u.rlike(NOISE)), 1, limit)


def junk_image(url: Column, css_class: Column, css_id: Column, width: Column) -> Column:
    """Icons, avatars and placeholders by tokens of address, class and id, by file stem, or by a declared width below 300. Alternative texts don't count."""
    joined = F.lower(F.concat_ws(" ", url, css_class, css_id))
    tokens = F.filter(F.split(joined, "[^a-z0-9]+"), lambda t: t != "")
    tokens = F.array_union(tokens, F.transform(tokens, lambda t: F.regexp_replace(t, "[0-9]+$", "")))
    tail = F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "([^/]*)/*$", 1)
    stem = F.lower(F.regexp_replace(tail, r"\.[^.]*$", ""))
    small = F.coalesce(width.try_cast("int") < 300, F.lit(False))
    return (F.coalesce(url, F.lit("")) == "") | url.rlike("(?i)^data:") | F.arrays_overlap(tokens, F.array(*map(F.lit, ICON_TOKENS))) | stem.isin(*ICON_STEMS) | small


def image_address(tag: Column) -> Column:
    """The first filled address of an ``<img>`` tag, in the tag's own order, with its entities decoded; null for icons, placeholders and tags without one."""
    pattern = rf"""(?is)\b(?:{"|".join(LAZY_SOURCES)})\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""
    values = F.transform(F.regexp_extract_all(tag, F.lit(pattern), F.lit(0)), lambda a: T.trimmed(F.regexp_replace(a, r"""(?is)^[\w-]+\s*=\s*["']?|["']$""", "")))
    url = T.unescape_common(F.coalesce(F.get(F.filter(values, lambda v: v != ""), F.lit(0)), F.lit("")))
    declared = F.least(*[F.when(w.rlike("^[0-9]+$"), w.try_cast("long")) for w in (attribute(tag, "width"), attribute(tag, "data-width"))])
    return T.bound(url, lambda u: F.when(~junk_image(u, attribute(tag, "class"), attribute(tag, "id"), declared.cast("string")), u))


def document(html: Column, min_chars: int = 200, max_chars: int = 40_000, most: int = 12) -> Column:
    """struct(text, anchors array<struct<i, url>>): the article's paragraphs, and its images with the number of paragraphs before each.

    Paragraphs and images are read off one list of elements in document order, so their places agree. Paragraphs that repeat
    the one before, and promotion at the end, go with what hangs on them: later images move up, images in the cut tail go.
    Pages without paragraphs, or with too little text, give '' and no images.
    """
    elements = F.regexp_extract_all(best_part(without_furniture(html), min_chars), F.lit(r"(?is)<img\b[^>]*>|<p\b[^>]*>.*?</p>"), F.lit(0))
    inner = lambda e: F.regexp_extract_all(e, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))

    def parse(e: Column) -> Column:
        words = T.bound(T.strip_html(F.regexp_replace(e, r"(?is)<img\b[^>]*>", " ")), lambda t: F.when(e.rlike("(?i)^<p") & (F.char_length(t) >= 24) & ~T.is_junk(t), t))
        return F.struct(words.alias("p"), F.array_compact(F.transform(inner(e), image_address)).alias("urls"))

    start = F.struct(F.array().cast("array<string>").alias("ps"), F.array().cast("array<struct<i:int,url:string>>").alias("anchors"))

    def add(acc: Column, x: Column) -> Column:
        # A paragraph's own images stand before it, as it is counted when it ends.
        new = F.filter(x["urls"], lambda u: ~F.exists(acc["anchors"], lambda a: a["url"] == u))
        anchors = F.concat(acc["anchors"], F.transform(F.array_distinct(new), lambda u: F.struct(F.size(acc["ps"]).alias("i"), u.alias("url"))))
        fresh = x["p"].isNotNull() & ~F.coalesce(F.element_at(F.when(F.size(acc["ps"]) > 0, acc["ps"]), -1) == x["p"], F.lit(False))
        return F.struct(F.when(fresh, F.array_append(acc["ps"], x["p"])).otherwise(acc["ps"]).alias("ps"), anchors.alias("anchors"))

    def close(acc: Column) -> Column:
        body = T.bound(F.array_join(acc["ps"], "\n\n"), lambda t: F.struct(F.char_length(t).alias("n"), T.trim_tail(t).alias("text")))
        return T.bound(F.struct(body.alias("body"), acc["anchors"].alias("anchors")), cut)

    def cut(x: Column) -> Column:
        looks = F.substring(html, 1, 200).rlike(r"(?i)<\s*/?\s*[a-z]") & (x["body"]["n"] >= min_chars)
        left = F.size(F.split(x["body"]["text"], r"\n\s*\n"))
        kept = F.slice(F.filter(x["anchors"], lambda a: a["i"] <= left - 1), 1, most)
        return F.struct(F.when(looks, F.substring(x["body"]["text"], 1, max_chars)).otherwise("").alias("text"), F.when(looks, kept).otherwise(F.slice(x["anchors"], 1, 0)).alias("anchors"))

    return T.bound(F.transform(elements, parse), lambda xs: F.aggregate(xs, start, add, close))


def best_part(html: Column, min_chars: int = 200) -> Column:
    """The HTML that most likely holds the article: the container with the longest paragraphs, or the page if that has more and no container has enough."""
    ranked = F.array_max(F.transform(containers(html), lambda h, i: F.struct(text_length(paragraph_texts(h)).alias("n"), (-i).alias("at"), h.alias("h"))))
    return T.bound(ranked, lambda b: F.when(F.coalesce(b["n"] >= min_chars, F.lit(False)), b["h"]).when(text_length(paragraph_texts(html)) > F.coalesce(b["n"], F.lit(0)), html).otherwise(F.coalesce(b["h"], html)))


def image_candidates(html: Column, base_url: Column | None = None) -> Column:
    """Addresses of images by their order: those of the body first, then the ones that meta and link tags name, absolute where
    there is a base; each once. Of the meta tags only those that hold an address count, not an image's width, height or text."""
    html = F.coalesce(html, F.lit(""))
    own = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0)), image_address)
    named = F.concat(
        F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b[^>]*(?:property|name)\s*=\s*["'](?:og:image(?::secure_url|:url)?|twitter:image(?::src)?)["'][^>]*>"""), F.lit(0)),
        F.regexp_extract_all(html, F.lit(r"""(?is)<link\b[^>]*rel\s*=\s*["'][^"']*image_src[^"']*["'][^>]*>"""), F.lit(0)),
    )
    nothing = F.lit(None).cast("string")
    url = lambda tag: T.bound(T.unescape_common(T.first_nonempty(attribute(tag, "content"), attribute(tag, "href"))), lambda u: F.when(~junk_image(u, nothing, nothing, nothing), u))
    found = F.array_compact(F.concat(own, F.transform(named, url)))
    return F.array_distinct(found if base_url is None else F.transform(found, lambda u: T.joined_url(base_url, u)))


def headings(blocks: Column) -> Column:
    """Each block with whether it reads as a heading: 2 to 30 characters, no sentence end, no leading digit."""
    return F.transform(blocks, lambda b: F.struct(b.alias("text"), (F.char_length(b).between(2, 30) & ~b.rlike(r"[。！？.!?,，;；:：]$") & ~b.rlike(r"^[0-9]")).alias("heading")))


def contents(blocks: Column, most: int = 12) -> Column:
    """The first headings of a text."""
    return F.slice(F.transform(F.filter(headings(blocks), lambda b: b["heading"]), lambda b: b["text"]), 1, most)


def sections_of(blocks: Column) -> Column:
    """Blocks (text, heading) folded into sections, array<struct<start, blocks>>: a section is a heading with what follows it, and
    what stands before the first heading. ``start`` is the number of its first block."""
    starts = F.filter(F.transform(blocks, lambda b, i: F.when(b["heading"] | (i == 0), i)), lambda i: i.isNotNull())
    ends = lambda s: F.transform(s, lambda _, k: F.coalesce(F.get(s, k + 1), F.size(blocks)))
    return T.bound(starts, lambda s: F.zip_with(s, ends(s), lambda x, y: F.struct(x.alias("start"), F.slice(blocks, x + 1, y - x).alias("blocks"))))


def paired_sections(left: Column, right: Column, left_slots: Column | None = None, right_slots: Column | None = None) -> Column:
    """Sections of two versions side by side: array<struct<left, right[, left_slots, right_slots]>> of blocks (text, heading).

    The versions pair by section where these begin at the same blocks in both; else all is one pair, so that nothing of either
    is lost. Without blocks on a side there are no pairs. Slots (``image_slots``: one more than there are blocks) are cut at the
    same places, the last section taking the one behind the text.
    """
    slots = left_slots is not None and right_slots is not None

    def side(s: Column, k: Column, own: Column, blocks: Column) -> Column:
        after = F.coalesce(F.get(s, k + 1)["start"], F.size(blocks) + 1)
        return F.slice(own, F.get(s, k)["start"] + 1, after - F.get(s, k)["start"])

    def fields(a: Column, b: Column, x: Column | None, y: Column | None) -> Column:
        return F.struct(a.alias("left"), b.alias("right"), *([x.alias("left_slots"), y.alias("right_slots")] if slots else []))

    def paired(p: Column) -> Column:
        same = F.transform(p["a"], lambda s: s["start"]) == F.transform(p["b"], lambda s: s["start"])
        each = F.transform(F.sequence(F.lit(0), F.size(p["a"]) - 1), lambda k: fields(F.get(p["a"], k)["blocks"], F.get(p["b"], k)["blocks"], side(p["a"], k, left_slots, left) if slots else None, side(p["b"], k, right_slots, right) if slots else None))
        return F.when(same, each).otherwise(F.array(fields(left, right, left_slots, right_slots)))

    some = (F.size(left) > 0) & (F.size(right) > 0)
    both = T.bound(F.struct(sections_of(left).alias("a"), sections_of(right).alias("b")), paired)
    return F.when(some, both).otherwise(F.slice(F.array(fields(left, right, left_slots, right_slots)), 1, 0))


def section_pairs(left: Column, right: Column) -> Column:
    """Blocks of text of two versions side by side where they agree block by block on what is a heading, else by sections (``paired_sections``) as texts."""
    agree = F.transform(headings(left), lambda b: b["heading"]) == F.transform(headings(right), lambda b: b["heading"])
    text = lambda blocks: F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")
    zipped = F.zip_with(left, right, lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return F.when(agree, zipped).otherwise(F.transform(paired_sections(headings(left), headings(right)), lambda p: F.struct(text(p["left"]).alias("left"), text(p["right"]).alias("right"))))


def shift_anchors(anchors: Column, removed: Column) -> Column:
    """Image anchors {i, url} after the paragraphs of the sorted array ``removed`` went."""
    return F.transform(anchors, lambda a: F.struct((a["i"] - F.size(F.filter(removed, lambda r: r < a["i"]))).alias("i"), a["url"].alias("url")))


def moved_anchors(anchors: Column, source: Column, target: Column) -> Column:
    """Anchors of a text of ``source`` paragraphs for its version of ``target`` paragraphs, by their relative place; none if either has none."""
    place = lambda a: F.least(target, F.bround(a["i"] / source * target, 0).cast("int"))
    shifted = F.transform(anchors, lambda a: F.struct(place(a).alias("i"), a["url"].alias("url")))
    return F.when((source <= 0) | (target <= 0), F.slice(anchors, 1, 0)).when(source == target, anchors).otherwise(shifted)


def image_slots(anchors: Column, blocks: Column) -> Column:
    """For a text's blocks (text, heading) the addresses before the first and behind each: an array with one place more than there
    are blocks. Headings take no number of their own; anchors outside the text are left out."""
    plain = F.transform(F.filter(F.transform(blocks, lambda b, i: F.struct(i.alias("at"), b["heading"].alias("h"))), lambda x: ~x["h"]), lambda x: x["at"] + 1)
    place = lambda a: F.when(a["i"] == 0, 0).otherwise(F.get(plain, a["i"] - 1))
    placed = F.transform(anchors, lambda a: F.struct(place(a).alias("slot"), a["url"].alias("url")))
    return T.bound(placed, lambda p: F.transform(F.sequence(F.lit(0), F.size(blocks)), lambda k: F.transform(F.filter(p, lambda x: x["slot"] == k), lambda x: x["url"])))

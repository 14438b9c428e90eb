"""Text expressions: cleaning, tags, language and quality predicates.

All take and return Columns. ASCII white space and Unicode letters are spelled
out in the patterns, so that results do not depend on an engine's defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[一-鿿]"
LATIN = "[A-Za-z]"
#: White space as the text functions see it: all of Unicode's, as texts in Chinese use the wide space.
BLANK_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = f"[{BLANK_CHARS}]"


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable stands for it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARS))


def collapsed(text: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.btrim(F.regexp_replace(text, BLANK + "+", " "), F.lit(" "))


def first_nonempty(*values: Column) -> Column:
    """The first value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


#: The entities that feeds leave in plain text most often.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}


def unescape_common(text: Column) -> Column:
    """The common entities decoded in the JVM, ``&amp;`` last; ``functions.pandas_text.unescape`` knows all of them."""
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_html(text: Column) -> Column:
    """Tags become spaces, entities are decoded, white space is collapsed; null gives ''."""
    return collapsed(unescape_common(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")))


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` code points, then an ellipsis."""
    t = trimmed(F.coalesce(text, F.lit("")))
    return F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), BLANK + "+$", ""), F.lit("…")))


def normalize_title(title: Column) -> Column:
    """Lower case, everything but letters, digits and underscore as one space."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))


def split_tags(raw: Column, limit: int = 5) -> Column:
    """Tags between commas and semicolons of either width, trimmed, without empty ones, ``limit`` at most."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), "[,，、;；]"), trimmed)
    return F.slice(F.filter(parts, lambda t: t != ""), 1, limit)


def comma_tags(raw: Column) -> Column:
    """Tags between ASCII commas only, without a limit, as search and briefs read them."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), trimmed), lambda t: t != "")


#: What Markdown puts before a line.
LINE_MARKS = r"(?m)^\s*(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s*)"


def strip_markdown(text: Column) -> Column:
    """Without line marks (headings, bullets, numbers) and bold marks, on one line."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), LINE_MARKS, "")
    return collapsed(F.regexp_replace(t, r"\*\*|__", ""))


def paragraphs(text: Column) -> Column:
    """The non-empty blocks between blank lines."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), trimmed), lambda p: p != "")


def head_paragraph(text: Column) -> Column:
    """What stands before the first empty line."""
    return F.split_part(text, F.lit("\n\n"), F.lit(1))


def without_head(text: Column) -> Column:
    """What follows the first empty line; null if nothing does."""
    at = F.locate("\n\n", text)
    return F.nullif(F.when(at > 0, trimmed(F.substr(text, at + 2))), F.lit(""))


def latin_letters(text: Column, first: int) -> Column:
    return F.regexp_count(F.substring(F.coalesce(text, F.lit("")), 1, first), F.lit(LATIN))


def han_chars(text: Column, first: int) -> Column:
    return F.regexp_count(F.substring(F.coalesce(text, F.lit("")), 1, first), F.lit(HAN))


def looks_english(text: Column) -> Column:
    """More than 40 ASCII letters, and more than twice as many as Han characters, in the first 400 characters."""
    latin = latin_letters(text, 400)
    return (latin > 2 * han_chars(text, 400)) & (latin > 40)


def is_chinese(text: Column) -> Column:
    return han_chars(text, 400) > 0


def chinese_ratio(text: Column, first: int = 400) -> Column:
    """Han characters among Han and ASCII letters; 0 where there is neither."""
    han = han_chars(text, first)
    return F.coalesce(F.try_divide(han, han + latin_letters(text, first)), F.lit(0.0))


def is_foreign(title: Column, body: Column) -> Column:
    """Whether an article needs a translation, by its first 1500 characters."""
    sample = F.substring(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))), 1, 1500)
    return looks_english(sample)


def sentences(text: Column) -> Column:
    """Cut behind sentence ends and at line ends."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[。！？!?])|\n"), trimmed)


def has_untranslated_sentence(text: Column, min_chars: int = 10) -> Column:
    return F.exists(sentences(text), lambda p: (F.char_length(p) >= min_chars) & (chinese_ratio(p) < 0.3))


#: Function words whose absence marks telegraphic Chinese.
FUNCTION_WORDS = "的了吗呢吧是在和与及或而并以为对把被将能会可这那着过等从向给让使由所之其就都还也很更最"


def looks_telegraphic(text: Column) -> Column:
    """At least 25 Han characters, fewer than 6.5 function words in 100 and fewer than 14 Han characters in a piece."""
    t = F.coalesce(text, F.lit(""))
    han, words = F.regexp_count(t, F.lit(HAN)), F.regexp_count(t, F.lit(f"[{FUNCTION_WORDS}]"))
    pieces = F.size(F.filter(F.split(t, r"[。！？!?；;\n]"), lambda p: p.rlike(HAN)))
    return (han >= 25) & (words * 100 < han * 6.5) & (pieces > 0) & (han < pieces * 14)


def translation_usable(source: Column, translated: Column) -> Column:
    """Not empty, not telegraphic, and for sources of 400 characters or more between 0.25 and 1.3 times as long."""
    s, t = F.char_length(trimmed(F.coalesce(source, F.lit("")))), trimmed(F.coalesce(translated, F.lit("")))
    n = F.char_length(t)
    return (n > 0) & ~looks_telegraphic(t) & ((s < 400) | ((n >= s * 0.25) & (n <= s * 1.3)))


def chinese_usable(text: Column, strict: bool = True) -> Column:
    """Chinese enough to be read: strictly 0.4 of the letters and no sentence in another language, else 0.3 of the letters."""
    t = trimmed(F.coalesce(text, F.lit("")))
    ratio = chinese_ratio(t)
    return (ratio >= 0.4) & ~has_untranslated_sentence(t) if strict else ratio >= 0.3


#: What is left of a post that has no body.
BOILERPLATE = r"(?i)(?:submitted\s+by|\[link\]|\[comments\]|comments|level\s*\d+|/u/[A-Za-z0-9_-]+|\b\d+\s*(?:mo|yr|day|hour|min)s?\s*ago\b|\bupvote\b|\bpermalink\b|\breport\b)"


def is_real_body(text: Column, min_chars: int = 30) -> Column:
    def judge(t: Column) -> Column:
        # A beginning of the text suffices in nearly all cases: what is left of it is left of the whole. Its last three words
        # don't count, as a phrase that goes on behind them may take them with it.
        left = lambda x: F.char_length(trimmed(F.regexp_replace(x, BOILERPLATE, " "))) >= min_chars
        head = F.regexp_replace(F.substring(t, 1, 400), r"(?:\S+\s+){0,2}\S*$", "")
        return F.when(F.char_length(t) < min_chars, False).when((F.char_length(t) > 400) & left(head), True).otherwise(left(t))

    return bound(trimmed(F.coalesce(text, F.lit(""))), judge)


#: Phrases of paragraphs that are navigation or rights notices.
JUNK_PHRASES = ("阅读全文", "查看全文", "更多精彩", "关注我们", "扫码关注", "版权声明", "转载请注明", "点击查看", "相关阅读", "推荐阅读", "Share this", "Read more", "Subscribe", "Sign up", "All rights reserved", "Cookie", "submitted by", "[link]", "[comments]", "Comments", "level 1", "ago")


def is_junk(text: Column) -> Column:
    """Whether any of the phrases is in the text, whatever its case: one pass of one pattern."""
    return text.rlike("(?i)" + "|".join(rf"\Q{phrase}\E" for phrase in JUNK_PHRASES))


#: Promotion at the end of newsletters.
TAIL_PROMOTION = (
    r"(?i)get\s+\d+%\s*off|is meant to be shared|bring a (?:colleague|partner|peer)|cover more ground|building momentum|can'?t beat em|great,\s*just like"
    r"|originally (?:published|appeared)|all rights reserved|subscribe to our|sign ?up (?:for|to)|unsubscribe|\bviral\b.{0,60}\braises?\s+\$|\bat a \$[\d.]+[BM]\s+valuation\b"
    r"|^\s*(?:image|photo|credit|source|via)\s*:|\bfollow us (?:on|at)\b|\bshare this\b"
)


def trim_tail(text: Column, max_chars: int = 400) -> Column:
    """Without the promotional blocks at the end: from the last block back to the first that is none. Never empties a text."""
    goes = lambda b: (b == "") | ((F.char_length(b) <= max_chars) & b.rlike(TAIL_PROMOTION))

    def cut(blocks: Column) -> Column:
        # From the end; behind the first block that stays no pattern is tried any more.
        step = lambda acc, b: F.when(acc["stop"], acc).when(goes(trimmed(b)), F.struct((acc["n"] - 1).alias("n"), F.lit(False).alias("stop"))).otherwise(F.struct(acc["n"].alias("n"), F.lit(True).alias("stop")))
        start = F.struct(F.size(blocks).alias("n"), F.lit(False).alias("stop"))
        kept = lambda n: F.array_join(F.when(n == 0, blocks).otherwise(F.slice(blocks, 1, F.greatest(n, F.lit(1)))), "\n\n")
        return F.element_at(F.transform(F.array(F.aggregate(F.reverse(blocks), start, step, lambda acc: acc["n"])), kept), 1)

    # A lambda variable stands for the blocks, so that they are made once.
    return trimmed(F.element_at(F.transform(F.array(F.split(trimmed(F.coalesce(text, F.lit(""))), r"\n\s*\n")), cut), 1))


def brief_digest(text: Column, limit: int = 108, longest: int = 216) -> Column:
    """Whole sentences up to ``limit`` characters, the first one if none fits; only what is longer than ``longest`` is cut, at its last clause."""
    clean = collapsed(F.coalesce(text, F.lit("")))
    pieces = F.filter(F.transform(F.split(clean, r"(?<=[。！？.!?])"), trimmed), lambda p: p != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def take(acc: Column, p: Column) -> Column:
        fits = ~acc["full"] & (acc["used"] + F.char_length(p) <= limit)
        used = F.when(fits, acc["used"] + F.char_length(p)).otherwise(acc["used"])
        return F.struct(F.when(fits, F.concat(acc["out"], p)).otherwise(acc["out"]).alias("out"), used.alias("used"), (acc["full"] | ~fits | (used >= limit - 20)).alias("full"))

    def finish(whole: Column) -> Column:
        cut = F.regexp_extract(whole, r"(?s)^(.{20,}[，、；：,;:])", 1)
        short = trimmed(F.when((F.char_length(whole) > longest) & (cut != ""), cut).otherwise(whole))
        return bound(short, lambda t: F.when((t == "") | t.rlike(r"[。！？.!?]$"), t).otherwise(F.concat(t, F.lit("。"))))

    return bound(pieces, lambda p: bound(first_nonempty(F.aggregate(p, start, take, lambda acc: acc["out"]), F.get(p, F.lit(0))), finish))


def fallback_body(title: Column, *bodies: Column) -> Column:
    """The first of the bodies, without markup, that says something; else the title. What is shown where no model has answered."""
    texts = [bound(strip_html(b), lambda t: F.when(is_real_body(t), t)) for b in bodies]
    return F.coalesce(*texts, title, F.lit(""))


def fallback_digest(title: Column, *bodies: Column, chars: int = 200) -> Column:
    return truncate(fallback_body(title, *bodies), chars)


def _brief_of(material: Column, more: Column, least: int, limit: int) -> Column:
    """A brief from one column that is mostly Chinese, with a sentence of ``more`` where it is short; null where it isn't Chinese."""
    ends = r"[。！？.!?]$"

    def joined(x: Column) -> Column:
        tail = F.regexp_replace(x["extra"], "[，、；：,;: ]+$", "")
        apart = F.when(x["brief"].rlike(ends), "").otherwise("。")
        merged = F.when(tail.rlike(ends), F.concat(x["brief"], tail)).otherwise(F.concat(x["brief"], apart, tail, F.lit("。")))
        useful = chinese_usable(x["extra"], strict=False) & ~F.contains(x["brief"], x["extra"]) & (tail != "")
        return F.when((F.char_length(x["brief"]) < least) & useful & (F.char_length(merged) <= limit + 20), merged).otherwise(x["brief"])

    both = F.struct(brief_digest(material, limit).alias("brief"), brief_digest(more, limit).alias("extra"))
    return F.when(chinese_usable(material, strict=False), bound(both, joined))


def brief_text(title: Column, title_zh: Column, brief_zh: Column, digest_zh: Column, digest: Column, reason: Column, summary: Column, *bodies: Column, placeholder: str | None = None, least: int = 70, limit: int = 108) -> Column:
    """A paragraph in whole Chinese sentences: the stored brief, else the first usable of the digests, the reason and the summary,
    else the beginning of a body, else the title. '' where there is none, or ``placeholder`` with the title for ``{title}``."""
    stored = trimmed(F.coalesce(brief_zh, F.lit("")))
    ladder = [_brief_of(m, summary if m is reason else reason, least, limit) for m in (digest_zh, digest, reason, summary)]
    excerpts = [bound(strip_markdown(b), lambda t: F.when(chinese_usable(t, strict=False), F.substring(t, 1, 400))) for b in bodies]
    body = bound(brief_digest(F.coalesce(*excerpts, F.lit("")), 2 * limit), lambda b: F.when(F.char_length(b) >= 30, b))
    name = trimmed(first_nonempty(title_zh, title))
    said = F.when(chinese_ratio(name) >= 0.4, brief_digest(name, limit))
    rest = F.lit("") if placeholder is None else F.when(name == "", "").otherwise(F.replace(F.lit(placeholder), F.lit("{title}"), name))
    return F.when(chinese_usable(stored), stored).otherwise(F.coalesce(*ladder, body, said, rest))


#: Words that say nothing about a story.
STOPWORDS = (
    "about", "above", "after", "again", "against", "also", "among", "because", "been", "before", "being", "between", "both", "could", "does",
    "doing", "down", "during", "each", "from", "further", "have", "having", "here", "into", "itself", "more", "most", "only", "other", "over",
    "same", "should", "some", "such", "than", "that", "their", "them", "then", "there", "these", "they", "this", "those", "through", "under",
    "until", "very", "were", "what", "when", "where", "which", "while", "with", "would", "your", "said", "says", "say", "new", "now", "will", "can",
    "may", "might", "via", "using", "used", "use",
)


#: A Latin word of a story, and the characters of Chinese, Japanese and compatibility forms.
STORY_WORD, CJK = r"[a-z][a-z0-9']{3,}", r"[぀-ヿ㐀-䶿一-鿿豈-﫿]"


def story_words(text: Column) -> Column:
    """Latin words of four characters or more without stop words; where there is CJK, also every pair of neighbouring characters."""

    def words(low: Column) -> Column:
        latin = F.array_except(F.array_distinct(F.regexp_extract_all(low, F.lit(STORY_WORD), F.lit(0))), F.array(*map(F.lit, STOPWORDS)))
        # One pass over the text: substrings by their number would each be counted from its beginning.
        pairs = F.when(F.char_length(low) < 2, F.array(low)).otherwise(F.regexp_extract_all(low, F.lit("(?s)(?=(..))."), F.lit(1)))
        return F.when(low.rlike(CJK), F.array_union(latin, pairs)).otherwise(latin)

    return bound(F.lower(F.coalesce(text, F.lit(""))), words)


def overlap(a: Column, b: Column) -> Column:
    """Common members as a share of the smaller set; 0 where a set is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def reading_minutes(text: Column) -> Column:
    """Han characters at 400 a minute and Latin words at 230, half to even, 1 at least."""
    t = F.coalesce(text, F.lit(""))
    minutes = F.regexp_count(t, F.lit(HAN)) / 400 + F.regexp_count(t, F.lit(r"[A-Za-z]+")) / 230
    return F.greatest(F.lit(1), F.bround(minutes, 0).cast("int"))


def url_host(url: Column) -> Column:
    """Between ``://`` and the next slash, port included and case kept; '' where there is no scheme."""
    return F.when(F.contains(url, F.lit("://")), F.substring_index(F.substr(url, F.locate("://", url) + 3), "/", 1)).otherwise("")


def joined_url(base: Column, url: Column) -> Column:
    """``url`` as a page at ``base`` (an address with a host) means it: absolute, of the same scheme, host or folder; dot segments are resolved."""
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*):(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda k: F.regexp_extract(base, whole, k)
    path, rest = F.regexp_extract(url, "^[^?#]*", 0), F.regexp_extract(url, "[?#].*$", 0)

    def step(done: Column, x: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(x == "..", up).when(x == ".", done).otherwise(F.array_append(done, x))

    def resolved(p: Column) -> Column:
        pieces = F.split(p, "/", -1)
        last = F.element_at(pieces, -1)
        # Empty pieces inside the path go, the one before the first slash and the one behind the last stay.
        inner = F.filter(pieces, lambda x, i: (i == 0) | (x != "") | (i == F.size(pieces) - 1))
        done = F.aggregate(inner, F.array().cast("array<string>"), step)
        return F.array_join(F.when(last.isin(".", ".."), F.array_append(done, F.lit(""))).otherwise(done), "/")

    folder = F.concat(F.when(part(3) == "", "/").otherwise(F.regexp_replace(part(3), "[^/]*$", "")), path)
    inside = F.concat(part(1), F.lit(":"), part(2), bound(F.when(F.startswith(path, F.lit("/")), path).otherwise(folder), resolved), rest)
    return (
        F.when((url == "") | (F.coalesce(base, F.lit("")) == ""), F.when(url == "", base).otherwise(url))
        .when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(F.startswith(url, F.lit("//")), F.concat(part(1), F.lit(":"), url))
        .when(path == "", F.concat(part(1), F.lit(":"), part(2), part(3), F.when(F.startswith(url, F.lit("#")), part(4)).otherwise(""), url))
        .otherwise(inside)
    )


def safe_link(raw: Column) -> Column:
    """The trimmed link if its scheme is http or https, else ''."""
    t = trimmed(F.coalesce(raw, F.lit("")))
    return F.when(t.rlike("(?i)^https?:"), t).otherwise("")


def compact_number(n: Column) -> Column:
    """1234 as 1.2K, millions and billions with two places, without trailing zeros."""
    def short(unit: int, places: int, name: str) -> Column:
        # Whole steps of the last place shown, half up, so that no binary fraction is rounded.
        step = unit // 10**places
        shown = F.format_string(f"%.{places}f", F.floor((n + step // 2) / step).cast("double") / 10**places)
        return F.concat(F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit(name))

    return F.when(n >= 10**9, short(10**9, 2, "B")).when(n >= 10**6, short(10**6, 2, "M")).when(n >= 1000, short(1000, 1, "K")).otherwise(n.cast("string"))


def redacted(text: Column) -> Column:
    """Keys and bearer tokens masked."""
    return F.regexp_replace(text, r"(sk-[A-Za-z0-9_-]{6,}|(?i:bearer)\s+[A-Za-z0-9._-]+)", "***")


def relative_time(at: Column, now: Column) -> Column:
    """'' for the future, then seconds, minutes, hours, days, and the date from a week on."""
    s = F.timestamp_diff("SECOND", at, now)
    return (
        F.when(at.isNull() | (s < 0), "")
        .when(s < 60, "just now")
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" h ago")))
        .when(s < 7 * 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit(" d ago")))
        .otherwise(F.date_format(at, "yyyy-MM-dd"))
    )

"""Reading and checking what a language model replies, and planning what it is asked. All are deterministic expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.functions import text as T

#: The words by which a reply says yes or no, those that say no, a number that may be the score, and one before the word.
VERDICT = r"\b(?:yes|no|y|n|true|false|relevant|irrelevant)\b|不相关|是|否|相关"
NEGATIVE = ("no", "n", "false", "irrelevant", "否", "不相关")
SCORE = r"(?<![\d.,])(\d{1,4})(?![\d.,])"
SCORE_AHEAD = r"(?i)^\s*(\d{1,3})\s*(?:yes|no|y|n|是|否)\b"
#: The names that services give their counts of tokens.
INPUT, OUTPUT, TOTAL = ("$.input_tokens", "$.prompt_tokens"), ("$.output_tokens", "$.completion_tokens"), ("$.total_tokens",)
CACHED = ("$.input_tokens_details.cached_tokens", "$.prompt_tokens_details.cached_tokens", "$.cache_read_input_tokens")
REASONING = ("$.output_tokens_details.reasoning_tokens", "$.completion_tokens_details.reasoning_tokens")


def parse_relevance(reply: Column) -> Column:
    """struct(relevant, score): the first verdict anywhere decides; the score is the first whole number of 0 to 100 behind it
    that is no part of a decimal, a grouped number or a year, else one right before it ("85 yes"). Not relevant: no score."""
    t = T.trimmed(F.coalesce(reply, F.lit("")))
    low = F.lower(t)
    word = F.regexp_extract(low, VERDICT, 0)
    found = word != ""
    relevant = F.when(found, ~word.isin(*NEGATIVE)).otherwise(low.rlike("^(yes|y|是|相关|true)"))
    rest = F.substr(t, F.regexp_instr(low, F.lit(VERDICT)) + F.char_length(word))
    numbers = F.transform(F.regexp_extract_all(rest, F.lit(SCORE), F.lit(1)), lambda n: n.cast("int"))
    behind = F.get(F.filter(numbers, lambda n: n <= 100), F.lit(0))
    ahead = F.regexp_extract(t, SCORE_AHEAD, 1).try_cast("int")
    score = F.coalesce(F.when(found, behind), F.when(ahead <= 100, ahead))
    return F.struct(relevant.alias("relevant"), F.when(relevant | ~found, score).alias("score"))


def lines_of(reply: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), r"\r?\n"), T.trimmed), lambda s: s != "")


def parse_classify(reply: Column, valid: list[str]) -> Column:
    """struct(category, topics): the first line that is a category; up to three different pieces of other lines, 20 characters at most."""
    heads = F.transform(lines_of(reply), lambda s: T.trimmed(F.regexp_replace(s, r"^[ \-•*#]+", "")))
    first = F.array_position(F.transform(heads, lambda h: h.isin(valid)), True)
    others = F.filter(heads, lambda h, i: i != first - 1)
    pieces = F.flatten(F.transform(others, lambda h: F.transform(F.split(h, "[,，、;；]"), lambda p: F.btrim(T.trimmed(p), F.lit("「」【】")))))
    topics = F.array_distinct(F.filter(pieces, lambda p: (p != "") & ~p.isin(valid) & (F.char_length(p) <= 20)))
    return F.struct(F.when(first > 0, F.get(heads, (first - 1).cast("int"))).alias("category"), F.slice(topics, 1, 3).alias("topics"))


def parse_translate(reply: Column) -> Column:
    """struct(title, digest): the first line, and the others joined."""
    rows = lines_of(reply)
    rest = F.array_join(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), " ")
    return F.struct(F.nullif(F.substring(F.get(rows, F.lit(0)), 1, 500), F.lit("")).alias("title"), F.nullif(T.truncate(rest, 400), F.lit("")).alias("digest"))


QUOTES = "「」『』\"'“”《》"


def parse_title(reply: Column) -> Column:
    """The first line without quotation marks and bullets; null if nothing is left."""
    line = F.get(lines_of(F.coalesce(reply, F.lit(""))), F.lit(0))
    bare = T.trimmed(F.regexp_replace(F.btrim(line, F.lit(QUOTES)), r"^[#*\-— ]+", ""))
    return F.nullif(F.substring(bare, 1, 500), F.lit(""))


def split_digest(reply: Column) -> Column:
    """struct(zh, en): lines that begin with EN, and with a colon behind it lose it, make the English side, the others the Chinese one."""
    rows = lines_of(reply)
    is_en = lambda s: s.rlike("(?i)^EN")
    plain = lambda part: T.strip_markdown(F.array_join(part, " "))
    en = F.transform(F.filter(rows, is_en), lambda s: T.trimmed(F.regexp_replace(s, r"(?i)^EN\s*[:：]\s*", "")))
    return F.struct(plain(F.filter(rows, lambda s: ~is_en(s))).alias("zh"), plain(en).alias("en"))


SECTION = "array<struct<h_zh:string,h_en:string,t:string>>"


def _json_sections(reply: Column) -> Column:
    """Sections of a JSON list of {h_zh, h_en, paras}, paras a list or one string; null where there is no such list."""
    listed = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    items = F.from_json(listed, "array<string>")
    several = lambda x: F.from_json(F.get_json_object(x, "$.paras"), "array<string>")
    paras = lambda x: F.coalesce(several(x), F.array_compact(F.array(F.get_json_object(x, "$.paras"))))
    text = lambda x: F.array_join(F.filter(F.transform(paras(x), T.strip_markdown), lambda p: p != ""), "\n\n")
    head = lambda x, name, most: F.substring(T.trimmed(F.coalesce(F.get_json_object(x, f"$.{name}"), F.lit(""))), 1, most)
    found = F.transform(F.filter(items, lambda x: x.startswith("{")), lambda x: F.struct(head(x, "h_zh", 40).alias("h_zh"), head(x, "h_en", 80).alias("h_en"), text(x).alias("t")))
    return T.bound(F.filter(found, lambda s: s["t"] != ""), lambda s: F.when(F.size(s) > 0, s))


def _heading_sections(reply: Column) -> Column:
    """Sections under lines that begin with ##; what stands before the first has no heading. There is no English side."""
    # Each heading line begins a part; its first line is the heading, the rest the text.
    parts = F.split(F.concat(F.lit("\n"), reply), r"\n[ \t]*(?=##)")
    lines = lambda p: F.filter(F.transform(F.split(p, r"\r?\n"), T.trimmed), lambda x: x != "")

    def section(ls: Column) -> Column:
        headed = F.coalesce(F.get(ls, F.lit(0)).startswith("##"), F.lit(False))
        name = F.btrim(T.trimmed(F.regexp_replace(F.get(ls, F.lit(0)), "^#+", "")), F.lit("：:* "))
        body = F.filter(F.transform(F.when(headed, F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1)))).otherwise(ls), T.strip_markdown), lambda x: x != "")
        return F.struct(F.when(headed, F.substring(name, 1, 30)).otherwise("").alias("h_zh"), F.lit("").alias("h_en"), F.array_join(body, "\n\n").alias("t"))

    found = F.filter(F.transform(parts, lambda p: T.bound(lines(p), section)), lambda s: s["t"] != "")
    return T.bound(found, lambda s: F.when(F.size(s) > 0, s))


def parse_sections(reply: Column, most: int = 8) -> Column:
    """Sections {h_zh, h_en, t} of a reply, JSON first, headings else; null for none, for more than ``most``, and for a single one without a heading."""
    found = F.coalesce(_json_sections(reply), _heading_sections(F.coalesce(reply, F.lit(""))))
    good = lambda s: F.when((F.size(s) <= most) & ~((F.size(s) == 1) & (F.get(s, F.lit(0))["h_zh"] == "")), s)
    return T.bound(found, good)


def section_side(sections: Column, chinese: bool) -> Column:
    """{h, t} of one language. An English side needs a heading for every section: else it is null, so that the two sides never differ in structure."""
    name = "h_zh" if chinese else "h_en"
    side = lambda s: F.transform(s, lambda x: F.struct(x[name].alias("h"), x["t"].alias("t")))
    whole = F.lit(True) if chinese else F.forall(sections, lambda x: T.trimmed(x["h_en"]) != "")
    return F.when((F.size(sections) > 0) & whole, side(sections))


def parse_translations(reply: Column, expected: Column) -> Column:
    """The strings of {"t": [...]} if there are exactly ``expected``, none blank and none telegraphic; else null."""
    t = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "t array<string>")["t"]
    found = F.get(t, F.lit(0)).isNotNull()
    good = (F.size(t) == expected) & F.forall(t, lambda s: F.coalesce(T.trimmed(s) != "", F.lit(False)) & ~T.looks_telegraphic(s))
    return F.when(found & good, t)


def same_story(reply: Column) -> Column:
    """Whether the first eight characters, bullets aside, begin with yes."""
    head = F.lower(F.substring(F.regexp_replace(F.coalesce(reply, F.lit("")), r"^[\s\-•*#]+", ""), 1, 8))
    return head.rlike("^(yes|y|是|同一)")


def parse_usage(payload: Column) -> Column:
    """struct of token counts under the names that different services give them; the total is summed where it is missing."""
    pick = lambda *paths: F.greatest(F.coalesce(*[F.get_json_object(payload, p).try_cast("long") for p in paths], F.lit(0)), F.lit(0))
    i, o, c, r = pick(*INPUT), pick(*OUTPUT), pick(*CACHED), pick(*REASONING)
    total = F.coalesce(F.nullif(pick(*TOTAL), F.lit(0)), i + o + F.greatest(F.lit(0), r - o))
    return F.struct(i.alias("input"), o.alias("output"), c.alias("cached"), r.alias("reasoning"), total.alias("total"))


def reply_text(payload: Column) -> Column:
    """The text of a whole or streamed reply: pieces of ``data:`` lines in order, else the message of any of three shapes."""
    shapes = ("$.choices[0].message.content", "$.output[0].content[0].text", "$.content[0].text")
    events = F.transform(F.regexp_extract_all(payload, F.lit(r"(?m)^data:\s*(\{.*\})\s*$"), F.lit(1)), lambda e: F.coalesce(F.get_json_object(e, "$.choices[0].delta.content"), F.get_json_object(e, "$.delta"), F.get_json_object(e, "$.delta.text"), F.lit("")))
    streamed = F.array_join(events, "")
    whole = F.coalesce(*[F.get_json_object(payload, p) for p in shapes], F.lit(""))
    return F.when(streamed != "", streamed).otherwise(whole)


def chunks(paragraphs: Column, budget: int = 3500, least: int = 400) -> Column:
    """Paragraphs in chunks that close once they reach the budget; a last one below ``least`` joins the one before."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def add(acc: Column, p: Column) -> Column:
        cur = F.when(acc["n"] == 0, p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        n = acc["n"] + F.char_length(p) + 2
        full = n >= budget
        return F.struct(F.when(full, F.array_append(acc["done"], cur)).otherwise(acc["done"]).alias("done"), F.when(full, "").otherwise(cur).alias("cur"), F.when(full, 0).otherwise(n).alias("n"))

    def close(acc: Column) -> Column:
        done, n = acc["done"], F.size(acc["done"])
        joined = F.concat(F.slice(done, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.get(done, n - 1), F.lit("\n\n"), acc["cur"])))
        return F.when(acc["n"] == 0, done).when((n > 0) & (acc["n"] < least), joined).otherwise(F.array_append(done, acc["cur"]))

    return F.aggregate(paragraphs, start, add, close)


def batches(sizes: Column, budget: int = 3500) -> Column:
    """The batch number of each size: a batch closes before it would exceed the budget, and holds one item at least."""
    start = F.struct(F.array().cast("array<int>").alias("no"), F.lit(0).alias("cur"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        over = (acc["n"] > 0) & (acc["n"] + s > budget)
        cur = F.when(over, acc["cur"] + 1).otherwise(acc["cur"])
        return F.struct(F.array_append(acc["no"], cur).alias("no"), cur.alias("cur"), F.when(over, s).otherwise(acc["n"] + s).cast("int").alias("n"))

    return F.aggregate(sizes, start, add, lambda acc: acc["no"])


def halves(text: Column) -> Column:
    """A text cut at the sentence end that is first past its middle; whole if there is one sentence only."""
    parts = F.filter(F.split(text, r"(?<=[.!?。！？])\s*"), lambda p: p != "")
    ends = F.aggregate(parts, F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n")), lambda a, p: F.struct(F.array_append(a["at"], a["n"] + F.char_length(p)).alias("at"), (a["n"] + F.char_length(p)).alias("n")), lambda a: a["at"])
    cut = F.greatest(F.size(F.filter(ends, lambda e: e < F.char_length(text) / 2)) + 1, F.lit(1))
    cut = F.least(cut, F.size(parts) - 1)
    two = F.array(F.array_join(F.slice(parts, 1, cut), " "), F.array_join(F.slice(parts, cut + 1, F.size(parts)), " "))
    return F.when(F.size(parts) < 2, F.array(text)).otherwise(two)


def fill(template: str, **values: Column) -> Column:
    """A prompt with each ``{key}`` replaced literally; ``content`` is cut to 4000 characters."""
    out = F.lit(template)
    for key, value in values.items():
        v = F.coalesce(value, F.lit(""))
        out = F.replace(out, F.lit("{" + key + "}"), F.substring(v, 1, 4000) if key == "content" else v)
    return out

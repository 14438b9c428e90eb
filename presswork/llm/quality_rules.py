"""Quality rules by distribution divergence, in DataFrame expressions only.

A document is compared with references of its language: how its characters fall
into classes, and how its words fall onto the language's most common words. The
Jensen-Shannon distance (base 2, 0 to 1) of each histogram to the nearest
reference decides, together with base rules; texts below a minimum length are
left to the base rules, as a short text's histogram says little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import SPACE, SPACE_CHARS, settled, text_of

#: Common function words of the languages that have references.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird",
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más o pero sus le ha me si",
}
WORDS = sorted({w for line in COMMON_WORDS.values() for w in line.split()})
#: Each common word has a one-character code, so that a document's histogram is counted in one short string.
CODES = {w: chr(0x100 + n) for n, w in enumerate(WORDS)}
#: Regular expressions of the character classes; what is in none of them is the last class.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "space": SPACE, "stop": r"[.,;:'\"()?\-]", "shout": "!", "symbol": r"[#*$%&|<>]"}


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable stands for it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, width: int = 8) -> Column:
    """How many words stand in windows of ``width`` words that occur twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash of the words' hashes. Texts whose window hashes are all distinct stop there.
    """

    def covered(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def total(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            twice = F.filter(s, lambda x, i: same(i, i - 1) | same(i, i + 1))
            places = F.sort_array(F.transform(twice, lambda x: x["at"]))
            start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
            step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"))
            return F.aggregate(places, start, step, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_bound(ranked, total))

    def from_hashes(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - width)
        return _bound(F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])), covered)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < width, 0).otherwise(_bound(hashes, from_hashes))


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the histograms ``classes`` and ``common``,
    and ``foreign``: at least half of the characters in words are letters of another script than Latin."""
    text = text_of()
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
    code_of = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])

    def of_words(w: Column) -> Column:
        codes = F.array_join(F.transform(F.filter(w, lambda x: x.isin(WORDS)), lambda x: code_of[x]), "")
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"), codes.alias("codes"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    # Classes that come in runs are counted by what is left without them, the others match by match.
    runs = {"lower", "space"}
    count = lambda name, p: F.char_length(text) - F.char_length(F.regexp_replace(text, p + "+", "")) if name in runs else F.regexp_count(text, F.lit(p))
    counted = {f"__{name}": count(name, pattern).cast("long") for name, pattern in CLASSES.items()}
    out = docs.withColumns({"__w": _bound(words, of_words), "__chars": F.char_length(text).cast("long"), "n_dup_lines": _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"), **counted})
    known = [F.col(f"__{name}") for name in CLASSES]
    other = F.col("__chars") - sum(known[1:], known[0])
    per_word = [F.char_length("__w.codes") - F.char_length(F.replace("__w.codes", F.lit(CODES[w]), F.lit(""))) for w in WORDS]
    common = F.array(*[n.cast("long") for n in per_word], (F.col("__w.n_words") - F.char_length("__w.codes")).cast("long"))
    # Texts of one byte a character, nearly, are not searched.
    letters = F.when(2 * F.octet_length(text) > 3 * F.col("__chars"), F.regexp_count(text, F.lit(r"[\p{L}\p{M}&&[^\p{IsLatin}]]"))).otherwise(0)
    return out.select(
        *docs.columns,
        F.col("__w.n_words").alias("n_words"),
        (F.col("__chars") - F.col("__space")).alias("word_chars"),
        F.col("__symbol").alias("n_symbols"),
        "n_dup_lines",
        F.col("__w.n_repeat_words").alias("n_repeat_words"),
        F.array(*known, other).alias("classes"),
        common.alias("common"),
        ((F.col("__chars") > F.col("__space")) & (2 * letters >= F.col("__chars") - F.col("__space"))).alias("foreign"),
    )


def base_failed(min_words: int = 20, most_repeated: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def divergence(histogram: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance of a count array to a reference's counts; 1 when the histogram is empty."""
    total = float(sum(reference)) or 1.0
    q = [n / total for n in reference]
    # Places where the document has nothing add q/2 each, so only the document's own places are looked at.
    share = F.array(*[F.lit(x) for x in q])

    def term(n: Column, i: Column, size: Column) -> Column:
        p, r = n / size, F.get(share, i)
        own = p * F.log2(2 * p / (p + r))
        return F.when(n > 0, own + F.when(r > 0, r * F.log2(2 * r / (p + r))).otherwise(0.0)).otherwise(r)

    size = F.aggregate(histogram, F.lit(0).cast("long"), lambda a, n: a + n).cast("double")
    terms = _bound(F.struct(histogram.alias("h"), size.alias("n")), lambda s: F.aggregate(F.transform(s["h"], lambda n, i: term(n, i, s["n"])), F.lit(0.0), lambda a, x: a + x))
    return F.when(size > 0, F.sqrt(F.greatest(F.lit(0.0), terms / 2))).otherwise(1.0)


def references(measured: DataFrame, min_words: int = 60, max_classes: float = 0.2, max_common: float = 0.32, rounds: int = 2) -> dict[str, tuple[list[int], list[int]]]:
    """For each language with common words: the summed histograms of all its documents that pass the base rules and,
    after the first round, lie within both distances of the round before.

    At most one row for each of those languages comes to the driver in a round.
    """
    sound = measured.filter(F.col("lang").isin(list(COMMON_WORDS)) & ~base_failed() & (F.col("n_words") >= min_words))
    sums = lambda name, n: F.array(*[F.sum(F.col(name)[k]) for k in range(n)]).alias(name)
    known: dict[str, tuple[list[int], list[int]]] = {}
    for _ in range(rounds):
        near = F.lit(not known)
        for lang, (c, w) in known.items():
            own = (divergence(F.col("classes"), c) <= max_classes) & (divergence(F.col("common"), w) <= max_common)
            near = F.when(F.col("lang") == lang, own).otherwise(near)
        rows = sound.filter(near).groupBy("lang").agg(sums("classes", len(CLASSES) + 1), sums("common", len(WORDS) + 1)).collect()
        known = {r["lang"]: (r["classes"], r["common"]) for r in rows} or known
    return known


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Labels that name no language.
NO_LANGUAGE = ("", "und", "unk", "unknown", "xx")


def without_reference(known: list[str]) -> Column:
    """Whether a document's language has no reference: its ``lang`` names another one, or its script is not Latin."""
    code = F.lower(F.regexp_extract(F.coalesce(F.col("lang"), F.lit("")), "^[A-Za-z]*", 0))
    return F.col("foreign") | ~code.isin(*known, *NO_LANGUAGE)


VERDICT = (*MEASURES, "class_distance", "common_distance", "base_failed", "kept")


def judge(docs: DataFrame, max_classes: float = 0.22, max_common: float = 0.36, max_sum: float = 0.5, min_chars: int = 300, min_words: int = 60, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, common_distance, base_failed, kept.

    References are the corpus's own, one for each language of ``COMMON_WORDS``; a document's distances are those to the
    language whose sum of distances is least (null and unknown languages too). Where its language has no reference (``lang``
    names another language, or half of the characters in words are letters of another script), the base rules decide alone,
    as distances to other languages say nothing about it. Not kept:
    base_failed; class_distance above ``max_classes`` from ``min_chars`` characters in words on; common_distance above
    ``max_common``, or both distances together above ``max_sum``, from ``min_words`` words on. Null and empty texts have no words and fail the base rules. Without
    references (no sound document of such a language) the base rules decide alone. Repeated rows are judged each.
    ``carry`` names the columns of ``docs`` that the result keeps (default: all); columns with a result's name are replaced.
    """
    docs = docs.drop(*VERDICT, "classes", "common", "foreign")
    carried = docs.columns if carry is None else carry
    measured = settled(measures(docs).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carried, "lang"])], *MEASURES, "classes", "common", "foreign"))
    known = references(measured)
    pairs = [F.struct(divergence(F.col("classes"), c).alias("classes"), divergence(F.col("common"), w).alias("common")) for c, w in known.values()]
    judged = measured.withColumn("base_failed", base_failed())
    if not pairs:
        judged = judged.withColumns({"class_distance": F.lit(0.0), "common_distance": F.lit(0.0), "kept": ~F.col("base_failed")})
        return judged.select(*carried, *VERDICT)
    nearest = F.array_min(F.transform(F.array(*pairs), lambda d: F.struct((d["classes"] + d["common"]).alias("sum"), d["classes"].alias("classes"), d["common"].alias("common"))))
    judged = judged.withColumn("__d", nearest).withColumns({"class_distance": F.col("__d.classes"), "common_distance": F.col("__d.common")})
    odd = ((F.col("word_chars") >= min_chars) & (F.col("class_distance") > max_classes)) | ((F.col("n_words") >= min_words) & ((F.col("common_distance") > max_common) | (F.col("class_distance") + F.col("common_distance") > max_sum)))
    odd = odd & ~without_reference(list(known))
    return judged.withColumn("kept", ~F.col("base_failed") & ~odd).select(*carried, *VERDICT)

"""Keywords in texts: one pass over a text finds all keywords of a list, however many there are."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Keywords of these characters stand between non-alphanumerics; all others are found anywhere.
BOUNDED = r"^[A-Za-z0-9][A-Za-z0-9 ._+\-]*$"
#: Letters that a case-blind comparison holds equal to a common one, beside what lower case does.
TWINS = {"İ": "i", "ı": "i", "ſ": "s", "K": "k", "ς": "σ", "µ": "μ"}


ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    for letter, twin in TWINS.items():
        text = text.replace(letter, twin)
    return text.lower().replace("ς", "σ")


def folded_column(text: Column) -> Column:
    """``folded`` in the JVM."""
    letters = "".join(TWINS), "".join(TWINS.values())
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.replace(F.lower(F.translate(text, *letters)), F.lit("ς"), F.lit("σ")))


class Matcher:
    """The least rule of each kind that is in a text. Rules are (id, kind, keyword); blank keywords are in no text."""

    def __init__(self, rules: tuple[tuple[int, str, str], ...], kinds: tuple[str, ...]) -> None:
        found: dict[str, dict] = {}
        self.least = [None] * len(kinds)
        for rule_id, kind, keyword in rules:
            word, k = folded((keyword or "").strip()), kinds.index(kind)
            if not word:
                continue
            bounded = bool(re.match(BOUNDED, keyword.strip()))
            best = found.setdefault(word, {})
            best[k, bounded] = min(rule_id, best.get((k, bounded), rule_id))
            if self.least[k] is None or rule_id < self.least[k]:
                self.least[k] = rule_id
        self.automaton = ahocorasick.Automaton()
        for word, ids in found.items():
            self.automaton.add_word(word, (len(word), [(k, bounded, rule_id) for (k, bounded), rule_id in ids.items()]))
        if found:
            self.automaton.make_automaton()

    def first(self, text: str | None) -> list[int | None]:
        best = [None] * len(self.least)
        if not text or not len(self.automaton):
            return best
        low = folded(text)
        for end, (size, ids) in self.automaton.iter(low):
            for k, bounded, rule_id in ids:
                if best[k] is not None and best[k] <= rule_id:
                    continue
                if bounded and ((end + 1 < len(low) and low[end + 1] in ALNUM) or (end >= size and low[end - size] in ALNUM)):
                    continue
                best[k] = rule_id
                if best == self.least:
                    return best
        return best


@lru_cache(maxsize=8)
def matcher_of(rules: tuple[tuple[int, str, str], ...], kinds: tuple[str, ...]) -> Matcher:
    """The process's matcher for these rules."""
    return Matcher(rules, kinds)


def first_rules(spark: SparkSession, text: Column, rules: list[tuple[int, str, str]], kinds: tuple[str, ...]) -> Column:
    """A struct with, for each kind, the least rule id that is in the text (null texts: none). The rules go to the executors once."""
    sent = spark.sparkContext.broadcast(tuple(rules))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        first = matcher_of(sent.value, kinds).first
        for texts in batches:
            yield pd.DataFrame([first(t) for t in texts], columns=list(kinds), dtype="Int64")

    return F.pandas_udf(run, ", ".join(f"{k} long" for k in kinds))(text)

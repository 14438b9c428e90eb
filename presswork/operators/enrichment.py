"""Steps that ask an injected model: relevance, classification, translation. Networks stay outside; a stub makes them testable."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.functions import replies, text


class FormatError(Exception):
    """A reply that the same model would give again: only another model is worth a try."""


CALL = T.StructType()
for _name, _kind in (("model", T.IntegerType()), ("ok", T.BooleanType()), ("ms", T.LongType()), ("prompt_chars", T.IntegerType()), ("reply_chars", T.IntegerType()), ("error", T.StringType())):
    CALL.add(_name, _kind)
Model = Callable[[str], str]


def _call(text: str | None, models: list[Model], attempts: int, pause: float) -> tuple[str | None, list[dict]]:
    """The reply and a record of each call. Attempts go round the models, with a growing pause between them (4 times ``pause`` at most)."""
    calls: list[dict] = []
    for n in range(attempts if text is not None else 0):
        started = time.monotonic()
        record = {"model": n % len(models), "ok": False, "ms": 0, "prompt_chars": len(text), "reply_chars": 0, "error": None}
        calls.append(record)
        try:
            reply = models[n % len(models)](text)
            record.update(ok=True, reply_chars=len(reply))
            return reply, calls
        except Exception as e:  # noqa: BLE001 - a call that fails is tried again, then counted as failed
            record["error"] = f"{type(e).__name__}: {e}"[:300]
            if isinstance(e, FormatError) and len(models) == 1:
                break
        finally:
            record["ms"] = int(1000 * (time.monotonic() - started))
        if pause and n + 1 < attempts:
            time.sleep(pause * min(2**n, 4))
    return None, calls


def ask(rows: DataFrame, prompt: str, model: Model | list[Model], reply: str = "reply", attempts: int = 3, pause: float = 0.0, calls: str | None = None) -> DataFrame:
    """``rows`` with the model's reply to the column ``prompt``; null after ``attempts`` failures, and where there is no prompt.

    Several models take turns. ``calls`` names a column for the records of the calls, for ``usage_of``. On the executors, a row at a time.
    """
    models = model if isinstance(model, list) else [model]
    schema = T.StructType([*rows.schema.fields, T.StructField(reply, T.StringType())])
    if calls:
        schema = schema.add(calls, T.ArrayType(CALL))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [_call(p, models, attempts, pause) for p in b[prompt]]
            yield b.assign(**{reply: [r for r, _ in done]}, **({calls: [c for _, c in done]} if calls else {}))

    return rows.mapInPandas(run, schema)


def usage_of(rows: DataFrame, calls: str) -> DataFrame:
    """The records of all calls, one a row, as the usage log keeps them."""
    return rows.select(F.explode(calls).alias("c")).select("c.*")


def translate(text: str, together: Callable[[list[str]], list[str] | None], alone: Model, chunks: list[str], batch_chars: int = 3500, calls: int = 120, depth: int = 4, tries: int = 2) -> str | None:
    """The translation of a text's ``chunks``, or null: all of them or none.

    Work is a stack of spans. A span of several chunks is asked for together; if the reply has not one translation of
    sound length for each, the span is cut in two. A single chunk that fails together is asked for alone, ``tries``
    times, and then cut at a paragraph or sentence, at most ``depth`` times. ``calls`` bounds all calls of the text.
    """
    sound = lambda source, out: bool(out) and 0.25 <= len(out) / len(source) <= 1.3

    spans: list[tuple[list[str], int]] = []
    for c in chunks:
        if spans and sum(map(len, spans[-1][0])) + len(c) <= batch_chars:
            spans[-1][0].append(c)
        else:
            spans.append(([c], 0))
    spans.reverse()
    out: list[str] = []
    while spans:
        span, cuts = spans.pop()
        if calls <= 0:
            return None
        if cuts == 0:
            calls -= 1
            got = together(span)
            if got is not None and len(got) == len(span) and all(map(sound, span, got)):
                out += got
                continue
            if len(span) > 1:
                half = len(span) // 2
                spans += [(span[half:], 0), (span[:half], 0)]
                continue
        said = None
        for _ in range(tries):
            if calls <= 0:
                return None
            calls -= 1
            said = alone(span[0])
            if sound(span[0], said):
                break
            said = None
        if said is not None:
            out.append(said)
            continue
        pieces = span[0].split("\n\n")
        joint = "\n\n"
        if len(pieces) < 2:
            pieces, joint = [x for x in re.split(r"(?<=[.!?。！？])\s*", span[0]) if x], " "
        if len(pieces) < 2 or cuts >= depth:
            return None
        half = len(pieces) // 2
        spans += [([joint.join(pieces[half:])], cuts + 1), ([joint.join(pieces[:half])], cuts + 1)]
    return "\n\n".join(out) or None


BATCH_PROMPT = 'Translate each text. Reply {"t": [...]} with as many strings.\n'
ALONE_PROMPT = "Translate.\n"


def translations(rows: DataFrame, model: Model, body: str = "content_full", calls: int = 120) -> DataFrame:
    """(id, content_zh) of the rows whose body is English: the whole body in Chinese, or null where a part could not be had.

    Bodies are cut into chunks by expressions, and replies checked by them; the calls run on the executors.
    """
    pieces = replies.chunks(text.paragraphs(F.col(body)))
    english = rows.filter(text.looks_english(F.col(body))).select("id", F.col(body).alias("body"), pieces.alias("chunks"))

    def safe(prompt: str) -> str | None:
        try:
            return model(prompt)
        except Exception:  # noqa: BLE001 - a failed call is a reply that can't be used
            return None

    def together(span: list[str]) -> list[str] | None:
        try:
            got = json.loads(re.search(r"(?s)\{.*\}", safe(BATCH_PROMPT + json.dumps(span, ensure_ascii=False)) or "")[0])["t"]
        except (TypeError, ValueError, KeyError):
            return None
        return [x.strip() for x in got] if isinstance(got, list) and all(isinstance(x, str) for x in got) else None

    def alone(chunk: str) -> str:
        return (safe(ALONE_PROMPT + chunk) or "").strip()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "body": b["body"], "content_zh": [translate(t, together, alone, list(c), calls=calls) for t, c in zip(b["body"], b["chunks"])]})

    done = english.mapInPandas(run, "id long, body string, content_zh string")
    return done.select("id", F.when(text.translation_usable(F.col("body"), F.col("content_zh")), F.col("content_zh")).alias("content_zh"))


def good_brief(reply: Column, longest: int = 200) -> Column:
    """A written brief that may be kept: Chinese, not telegraphic, whole sentences, none in another language, not too long; else null."""
    t = text.strip_markdown(reply)
    return text.bound(t, lambda x: F.when(text.is_chinese(x) & ~text.looks_telegraphic(x) & x.rlike(r"[。！？.!?]$") & ~text.has_untranslated_sentence(x) & (F.char_length(x) <= longest), x))


def good_digest(reply: Column) -> Column:
    """A translated digest that may be kept: without a headline of its own, not English, not telegraphic; else null."""
    rows = replies.lines_of(reply)
    first = F.get(rows, F.lit(0))
    headline = (F.size(rows) > 1) & (F.char_length(first) <= 20) & ~first.rlike(r"[。！？.!?：:]$")
    t = text.strip_markdown(F.array_join(F.when(headline, F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))).otherwise(rows), " "))
    return text.bound(t, lambda x: F.when((x != "") & ~text.looks_english(x) & ~text.looks_telegraphic(x), x))


PROMPTS = {
    "relevance": "Is this about {topic}? Say yes or no and a score.\n{title}\n{content}",
    "summary": "Summarise.\n{title}\n{content}",
    "digest": "Write a digest in Chinese, then a line EN: in English.\n{title}\n{content}",
    "reason": "Why read it?\n{title}\n{content}",
    "classify": "Choose a category, then topics.\n{title}\n{content}",
    "title_zh": "Translate the title.\n{title}",
    "digest_zh": "Translate the digest.\n{content}",
    "tags": "Give tags.\n{title}\n{content}",
    "brief_zh": "Write a brief.\n{title}\n{content}",
}


def processed(rows: DataFrame, model: Model | list[Model], categories: list[str], topic: str = "news", prompts: dict[str, str] = PROMPTS, **asking) -> DataFrame:
    """What a model says on each row (id, title, content_full): relevance, score, summary, digest, digest_en, reason, category, topics,
    title_zh, digest_zh, tags, brief_zh, status, degraded_reason.

    Every step is a prompt by expressions, the calls, and a check of the replies by expressions; the steps follow each other
    in one stage. Relevance, summary and tags are needed: without one the row is failed, with texts taken from its own body,
    and counts as relevant if that is unknown. The other steps may fail for themselves. Rows that are not relevant are asked no further.
    """
    own = F.col("title"), F.col("content_full")
    body = text.strip_html(F.col("content_full"))
    at = rows.select("id", "title", "content_full", text.truncate(body, 2000).alias("excerpt"), F.lit(True).alias("go"))

    def step(df: DataFrame, name: str, content: Column, when: Column = None) -> DataFrame:
        prompt = replies.fill(prompts[name], topic=F.lit(topic), title=F.col("title"), content=content)
        wanted = F.col("go") if when is None else F.col("go") & when
        return ask(df.withColumn("prompt", F.when(wanted, prompt)), "prompt", model, f"r_{name}", **asking).drop("prompt")

    at = step(at, "relevance", F.col("excerpt"))
    at = at.withColumn("a", F.when(F.col("r_relevance").isNotNull(), replies.parse_relevance(F.col("r_relevance")))).withColumn("go", F.coalesce(F.col("a.relevant"), F.lit(False)))
    at = step(at, "summary", F.col("excerpt")).withColumn("go", F.col("r_summary").isNotNull())
    fallback = text.fallback_digest(*own, chars=400)
    at = step(at, "digest", F.col("excerpt")).withColumn("d", replies.split_digest(F.col("r_digest")))
    at = at.withColumn("digest", F.when(F.col("r_digest").isNull() | text.looks_telegraphic(F.col("d.zh")), fallback).otherwise(text.truncate(F.col("d.zh"), 400)))
    at = step(at, "reason", F.col("r_summary"))
    at = step(at, "classify", F.col("r_summary")).withColumn("c", replies.parse_classify(F.coalesce("r_classify", F.lit("")), categories))
    at = step(at, "title_zh", F.lit(""), ~text.is_chinese(F.coalesce("title", F.lit(""))))
    at = step(at, "digest_zh", F.col("digest"), ~text.is_chinese(F.col("digest")))
    at = step(at, "tags", F.col("r_summary"))
    named = at.withColumns({"title_zh": replies.parse_title(F.col("r_title_zh")), "digest_zh": F.when(text.is_chinese(F.col("digest")), "").otherwise(good_digest(F.col("r_digest_zh")))})
    told = text.strip_markdown(text.first_nonempty(F.col("digest_zh"), F.col("digest")))
    at = step(named.withColumn("go", F.col("go") & F.col("r_tags").isNotNull()), "brief_zh", told)
    judged_no = F.coalesce(~F.col("a.relevant"), F.lit(False))
    failed = ~judged_no & (F.col("r_relevance").isNull() | F.col("r_summary").isNull() | F.col("r_tags").isNull())
    asked = ~judged_no
    either = lambda good, bad: F.when(failed, bad).when(asked, good)
    nothing = F.lit(None).cast("string")
    reason = F.when(F.col("r_reason").isNull() | text.looks_telegraphic(F.col("r_reason")), text.fallback_digest(*own, chars=200)).otherwise(text.truncate(F.col("r_reason"), 200))
    return at.select(
        "id",
        F.when(judged_no, 0).otherwise(1).alias("relevance"),
        F.when(asked, F.col("a.score")).alias("score"),
        either(text.truncate(F.col("r_summary"), 500), fallback).alias("summary"),
        F.when(asked, F.coalesce("digest", fallback)).alias("digest"),
        either(F.nullif(text.truncate(F.col("d.en"), 400), F.lit("")), nothing).alias("digest_en"),
        either(reason, text.truncate(fallback, 200)).alias("reason"),
        either(F.col("c.category"), nothing).alias("category"),
        either(F.when(F.size("c.topics") > 0, F.to_json("c.topics")), nothing).alias("topics"),
        either(F.col("title_zh"), nothing).alias("title_zh"),
        either(F.col("digest_zh"), nothing).alias("digest_zh"),
        either(F.nullif(F.array_join(text.split_tags(F.col("r_tags")), ","), F.lit("")), nothing).alias("tags"),
        either(good_brief(F.col("r_brief_zh")), nothing).alias("brief_zh"),
        F.when(failed, "failed").otherwise("processed").alias("status"),
        F.when(failed, "no model answered").alias("degraded_reason"),
    )


DERIVED = ("title_zh", "title_en", "digest_zh", "digest_en", "content_zh", "body_sections", "body_sections_zh", "brief_zh", "tags")


def refetched(articles: DataFrame, fresh: DataFrame) -> DataFrame:
    """``articles`` with the bodies of ``fresh`` (id, content_full); what was derived from the old body is null, and the row pending again."""
    new = articles.join(fresh.select("id", F.col("content_full").alias("__new")), "id", "left")
    hit = F.coalesce(F.col("__new"), F.lit("")) != ""
    effects = {"content_full": F.when(hit, F.col("__new")).otherwise(F.col("content_full")), "status": F.when(hit, "pending").otherwise(F.col("status"))}
    return new.withColumns(effects | {c: F.when(~hit, F.col(c)) for c in DERIVED if c in articles.columns}).drop("__new")


def judged(rows: DataFrame, model: Callable[[str], str], topic: str = "news") -> DataFrame:
    """(id, relevance, score, status): a failed call leaves the row failed with a null relevance, for the retry queue."""
    asked = rows.select("id", replies.fill("Is this about {topic}? {title}\n{content}", topic=F.lit(topic), title=F.col("title"), content=F.col("content_full")).alias("prompt"))
    answer = replies.parse_relevance(F.col("reply"))
    done = ask(asked, "prompt", model).withColumn("a", F.when(F.col("reply").isNotNull(), answer))
    return done.select("id", F.col("a.relevant").cast("int").alias("relevance"), "a.score", F.when(F.col("reply").isNull(), "failed").otherwise("processed").alias("status"))


def outcome_counts(done: DataFrame) -> DataFrame:
    """(outcome, n): processed, irrelevant, failed."""
    outcome = F.when(F.col("status") == "failed", "failed").when(F.col("relevance") == 1, "processed").otherwise("irrelevant")
    return done.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))

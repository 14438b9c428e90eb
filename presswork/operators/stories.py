"""Stories told by several sources: candidate pairs, merging, links between articles and their repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions import text as T
from presswork.operators.settling import settled
from presswork.operators.visibility import latest_first, ts, visible


#: Articles that may be merged: what a reader can open. A draft or a row that waits must not hide one of these.
MERGEABLE_STATUS = ("processed", "failed")


def candidates(articles: DataFrame, now: str, days: int = 7, newest: int = 40) -> DataFrame:
    """The newest visible, relevant articles of the pair window in a status that may be merged, whose links point to no local fixture."""
    recent = F.col("published_at") >= ts(now) - F.expr(f"INTERVAL {days} DAY")
    return articles.filter(visible() & (F.col("relevance") == 1) & F.col("status").isin(*MERGEABLE_STATUS) & recent & ~F.lower("link").startswith("http://localhost")).orderBy(*latest_first()).limit(newest)


def story_title() -> Column:
    """The title by which stories are compared: the Chinese one where there is one."""
    return T.first_nonempty(F.col("title_zh"), F.col("title"))


def title_classes(articles: DataFrame) -> DataFrame:
    """(id, class_id, words): articles whose titles have the same set of words form a class, named by its smallest id."""
    sets = articles.select("id", F.sort_array(T.story_words(story_title())).alias("words"))
    least = sets.groupBy("words").agg(F.min("id").alias("class_id"))
    return sets.join(least, "words").select("id", "class_id", "words")


#: The most frequent words have a bit each, in so many longs; the others share the bits of a signature.
HOT_LONGS, SIGNATURE_LONGS = 4, 2


def _ranked_words(sets: DataFrame, most_ranked: int) -> DataFrame:
    """(id, n, words, hot, rest, signature): words of two titles or more as structs (n_titles, code, bit), the rarest first, in one order for all titles.

    n counts all words of the title. Codes are whole numbers, one a word. The most frequent words are the last ones and have a bit, the
    rarest of them the lowest: hot holds a title's bits, and rest the codes of its other words (bit -1), whose hashes mark the signature.
    The ``most_ranked`` most frequent words get their counts by broadcast, the others, of which none is in many titles, by a shuffled join.
    """
    single = sets.select("id", F.size("words").alias("n"), F.explode("words").alias("word"))
    counted = settled(single.groupBy("word").agg(F.count("*").alias("n_titles")).filter("n_titles > 1").withColumn("code", F.monotonically_increasing_id()))
    falling = [F.desc("n_titles"), F.desc("code")]
    top = counted.orderBy(*falling).limit(most_ranked)
    bit = F.greatest(64 * HOT_LONGS - F.row_number().over(Window.orderBy(*falling)), F.lit(-1))
    met = single.join(F.broadcast(settled(top.withColumn("bit", bit))), "word", "left")
    others = met.filter("code is null").select("id", "n", "word").join(counted, "word").withColumn("bit", F.lit(-1))
    known = met.filter("code is not null").unionByName(others).withColumn("mark", F.pmod(F.xxhash64("code"), F.lit(64 * SIGNATURE_LONGS)).cast("int"))
    # A shift counts modulo 64.
    flag = lambda name, k: F.when(F.floor(F.col(name) / 64) == k, F.expr(f"shiftleft(1L, {name})")).otherwise(F.lit(0).cast("long"))
    hot = [F.bit_or(flag("bit", k)).alias(f"hot{k}") for k in range(HOT_LONGS)]
    signature = [F.bit_or(F.when(F.col("bit") < 0, flag("mark", k)).otherwise(F.lit(0).cast("long"))).alias(f"signature{k}") for k in range(SIGNATURE_LONGS)]
    titles = known.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("n_titles", "code", "bit"))).alias("words"), *hot, *signature)
    rest = F.transform(F.filter("words", lambda w: w["bit"] < 0), lambda w: w["code"])
    return titles.withColumn("rest", rest)


def title_pairs(articles: DataFrame, min_overlap: float = 0.25, frequent: int = 1000, most_ranked: int = 100_000) -> DataFrame:
    """(a, b, shared, title_overlap) with a < b of all pairs of title classes that share two words or more, and ``min_overlap`` of the smaller title's.

    a and b are class ids, so many copies of one title are one row here; ``title_classes`` says who is in a class.

    A set-similarity join by prefixes. Words have one order for all titles, the rarest first; those of one title only are left out.
    A title of n words, m of them in other titles too, must share k = max(2, ceil(min_overlap n)) with every larger partner, so the rarest
    common word is among its first m - k + 1, and has k - 1 words or more behind it in both titles. The words that most titles share stand
    last, and are no keys of long titles. A word of more than ``frequent`` titles is a key only together with one of the words behind it,
    the second rarest common word: of the smaller title only those before its last k - 2. So a title has about a row for each of its words,
    more only for pairs of frequent ones. What meets is compared at once, and counts at the key of the pair's rarest common words only, so
    that no pair is shuffled.

    There can be as many pairs as the square of the titles, so little is done for one. The most frequent words, which bring most pairs
    together, are counted as common bits. Signatures bound the number of other common words from above, and their codes are looked at only
    where this bound leaves the pair or its key open.
    """
    sets = settled(articles.select("id", F.sort_array(T.story_words(story_title())).alias("words")).filter(F.size("words") >= 2).groupBy("words").agg(F.min("id").alias("id")))
    ranked = settled(_ranked_words(sets, most_ranked))
    none = F.struct(F.lit(0).cast("long").alias("n_titles"), F.lit(-1).cast("long").alias("code"), F.lit(-1).alias("bit"))
    needed = lambda n: F.greatest(F.lit(2), F.ceil(n * min_overlap - 1e-9).cast("int"))
    hot, signature = range(HOT_LONGS), range(SIGNATURE_LONGS)

    def keys(first: Column, second: Column) -> Column:
        """(a, b, at) for the first ``first`` words a; frequent ones with each later word b up to the ``second``-th, others without (b has the code -1)."""

        def of(w: Column, i: Column) -> Column:
            later = F.slice("words", i + 2, F.greatest(second - i - 1, F.lit(0)))
            row = lambda v: F.struct(w.alias("a"), v.alias("b"), i.alias("at"))
            return F.when(w["n_titles"] <= frequent, F.array(row(none))).otherwise(F.transform(later, row))

        return F.explode(F.flatten(F.transform(F.slice("words", F.lit(1), F.greatest(first, F.lit(0))), of))).alias("e")

    m, k = F.size("words"), needed(F.col("n"))
    of_key = [F.col("e.a.code").alias("key_a"), F.col("e.b.code").alias("key_b")]
    small = ranked.select("*", m.alias("m"), k.alias("k"), keys(m - k + 1, m - k + 2)).filter(m - F.col("e.at") >= k)
    # The rest words among the key's, -1 where its last word is one, as other rest words may follow then.
    bit_a, bit_b, lone = F.col("e.a.bit"), F.col("e.b.bit"), F.col("e.b.code") == -1
    last = F.when(lone, bit_a).otherwise(bit_b)
    small = small.withColumn("last", last).withColumn("of_rest", F.when(last < 0, -1).when(lone | (bit_a >= 0), 0).otherwise(1))

    def before(j: int) -> Column:
        """The title's bits below the key's last word but its first: words that make another key of the pair where they are common too."""
        below = F.when(F.col("last") >= 64 * (j + 1), F.lit(-1).cast("long")).when(F.col("last") <= 64 * j, F.lit(0).cast("long")).otherwise(F.expr("~shiftleft(-1L, last)"))
        first = F.when((bit_a >= 64 * j) & (bit_a < 64 * (j + 1)), F.expr("shiftleft(1L, e.a.bit)")).otherwise(F.lit(0).cast("long"))
        # Never null, and known to be so: a test for nulls in front would make the method too long to be compiled.
        return F.coalesce(F.col(f"hot{j}").bitwiseAND(below).bitwiseAND(F.bitwise_not(first)), F.lit(0).cast("long")).alias(f"before{j}")

    unmarked = F.size("rest") - sum((F.bit_count(f"signature{j}") for j in signature), F.lit(0))
    small = small.select(*of_key, F.col("id").alias("x"), F.col("n").alias("nx"), "k", "of_rest", unmarked.alias("unmarked"), F.col("rest").alias("u"), *[before(j) for j in hot], *[F.col(f"hot{j}").alias(f"xh{j}") for j in hot], *[F.col(f"signature{j}").alias(f"xs{j}") for j in signature])
    large = ranked.select("*", keys(m - 1, m)).select(*of_key, F.col("id").alias("y"), F.col("n").alias("ny"), (m - F.col("e.at")).alias("left_y"), F.col("rest").alias("v"), *[F.col(f"hot{j}").alias(f"yh{j}") for j in hot], *[F.col(f"signature{j}").alias(f"ys{j}") for j in signature])

    both = lambda p, q, over: [F.col(f"{p}{j}").bitwiseAND(F.col(f"{q}{j}")) for j in over]
    n_hot = sum((F.bit_count(b) for b in both("xh", "yh", hot)), F.lit(0))
    n_marks = sum((F.bit_count(b) for b in both("xs", "ys", signature)), F.lit(0))
    at_most = F.when(n_marks == 0, 0).otherwise(n_marks + F.col("unmarked"))
    order = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    first_hot = reduce(lambda p, q: p & q, [b == 0 for b in both("before", "yh", hot)])
    enough = n_hot + F.when(F.col("of_rest") >= 0, F.col("of_rest")).otherwise(at_most) >= F.col("k")
    met = small.join(large, ["key_a", "key_b"]).filter(order & (F.col("left_y") >= F.col("k")) & first_hot & enough)
    # As an exploded column the common codes are made once a pair, for the conditions and the result.
    settled_by_marks = (F.col("of_rest") >= 0) & (at_most <= F.col("of_rest"))
    common = F.when(settled_by_marks, F.array().cast("array<bigint>")).otherwise(F.array_intersect("u", "v"))
    found = met.select("x", "y", "nx", "k", "key_a", "key_b", "of_rest", n_hot.alias("n_hot"), settled_by_marks.alias("sure"), F.explode(F.array(common)).alias("common"))
    n_rest = F.when(F.col("sure"), F.col("of_rest")).otherwise(F.size("common"))
    rarest = (F.get("common", F.lit(0)) == F.col("key_a")) & ((F.col("key_b") == -1) | (F.get("common", F.lit(1)) == F.col("key_b")))
    theirs = F.when(F.col("of_rest") >= 0, n_rest == F.col("of_rest")).otherwise(F.coalesce(rarest, F.lit(False)))
    shared = F.col("n_hot") + n_rest
    pairs = found.filter(theirs & (shared >= F.col("k"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), shared.alias("shared"), (shared / F.col("nx")).alias("title_overlap"))
    return pairs.filter(F.col("title_overlap") >= min_overlap)


def article_pairs(candidates: DataFrame, min_overlap: float = 0.25, most: int = 1000) -> DataFrame:
    """(a, b, title_overlap) of single articles, copies expanded: for merge candidates, of which there may be ``most``."""
    if candidates.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} candidates: pairs of single articles are for bounded frames, title_pairs for others")
    members = title_classes(candidates).filter(F.size("words") >= 2).select("id", "class_id")
    x, y = members.select(F.col("id").alias("x"), F.col("class_id").alias("a")), members.select(F.col("id").alias("y"), F.col("class_id").alias("b"))
    across = title_pairs(candidates, min_overlap).join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "title_overlap")
    inside = x.join(y, F.col("a") == F.col("b")).filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("title_overlap"))
    return across.unionByName(inside)


def ranked_pairs(articles: DataFrame, top: int = 8, body_chars: int = 4000) -> DataFrame:
    """The most suspicious pairs, a < b: title overlap and a tenth of the bodies' overlap; of equals those whose newer article is newer, then whose older one is."""
    pairs = article_pairs(articles.filter("duplicate_of is null"))
    body = articles.select("id", F.struct(F.unix_micros(F.col("published_at").cast("timestamp")).alias("at"), "id").alias("age"), T.story_words(F.substring(T.strip_html(F.col("content_full")), 1, body_chars)).alias("w"))
    scored = pairs.join(body.select(F.col("id").alias("a"), F.col("w").alias("x"), F.col("age").alias("p")), "a").join(body.select(F.col("id").alias("b"), F.col("w").alias("y"), F.col("age").alias("q")), "b")
    return scored.withColumn("score", F.col("title_overlap") + T.overlap(F.col("x"), F.col("y")) / 10).orderBy(F.desc("score"), F.greatest("p", "q").desc(), F.least("p", "q").desc()).limit(top).select("a", "b", "title_overlap", "score")


def merge(articles: DataFrame, same_story, top: int = 8) -> DataFrame:
    """(id, duplicate_of) of the articles that a merge links to their primary.

    ``same_story(a, b)`` judges a pair of ids. At most ``top`` pairs come to the driver, in order; a pair with an
    article that is linked already is passed over. The primary is the one with a Chinese body, then with the longer body, then the
    earlier one, then the one of the greater id. A primary may be linked to another one later: ``primary_of`` follows such chains.
    """
    body = F.struct((T.trimmed(F.coalesce("content_zh", F.lit(""))) != "").alias("zh"), F.char_length(F.coalesce("content_full", F.lit(""))).alias("chars"))
    rows = articles.select("id", body.alias("n"), F.unix_micros(F.col("published_at").cast("timestamp")).alias("at"))
    pairs = ranked_pairs(articles, top).join(rows.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("ta")), "a").join(rows.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("tb")), "b")
    linked: dict[int, int] = {}
    newer = lambda r: sorted([(r["ta"], r["a"]), (r["tb"], r["b"])], reverse=True)
    for p in sorted(sorted(pairs.collect(), key=newer, reverse=True), key=lambda r: -r["score"]):
        if p["a"] in linked or p["b"] in linked or not same_story(p["a"], p["b"]):
            continue
        first = (*p["na"], -p["ta"]) > (*p["nb"], -p["tb"])
        keep, lose = (p["a"], p["b"]) if first else (p["b"], p["a"])
        linked[lose] = keep
    return articles.sparkSession.createDataFrame(list(linked.items()) or [], "id long, duplicate_of long")


def repair_links(articles: DataFrame) -> DataFrame:
    """(id, duplicate_of, repaired): links to a missing article, or to one judged not relevant, become null. A primary not judged keeps its links."""
    known = articles.select(F.col("id").alias("primary_id"), "relevance")
    links = articles.filter("duplicate_of is not null").select("id", "duplicate_of")
    checked = links.join(known, F.col("duplicate_of") == F.col("primary_id"), "left")
    broken = F.col("primary_id").isNull() | F.coalesce(F.col("relevance") != 1, F.lit(False))
    return checked.select("id", F.when(~broken, F.col("duplicate_of")).alias("duplicate_of"), broken.alias("repaired"))


def duplicates_of(articles: DataFrame) -> DataFrame:
    """(primary_id, id, title): the articles that tell the same story as a primary, without deleted ones."""
    children = articles.filter("duplicate_of is not null and deleted_at is null").select("id", "title", F.col("duplicate_of").alias("primary_id"))
    return children.join(articles.select(F.col("id").alias("primary_id")), "primary_id").select("primary_id", "id", "title")


def primary_of(articles: DataFrame) -> DataFrame:
    """(id, primary_id) of the linked articles: the end of the chain of links, null if a hop is missing, deleted or in a circle.

    The first join finds what every link points at: an end, nothing, or another link. Pointer doubling follows: in each round
    the links that are open yet take over their target's target, so n rounds follow chains of 2^n links. A round reads the
    links of the round before twice and settles them; when so many rounds are done that every chain has ended, what is
    open still runs in circles.
    """
    nodes = articles.select(F.col("id").alias("n"), F.col("duplicate_of").alias("n_at"), F.col("deleted_at").isNotNull().alias("n_gone"))
    links = articles.filter("duplicate_of is not null").select("id", F.col("duplicate_of").alias("at"))
    dead = F.coalesce("n_gone", F.lit(True))
    met = links.join(nodes, F.col("at") == F.col("n"), "left")
    state = settled(met.select("id", "at", dead.alias("dead"), (dead | F.col("n_at").isNull()).alias("over")))
    left = state.filter("not over").count()
    for _ in range(left.bit_length() + 1):
        if not left:
            break
        state = settled(_one_round(state))
        left = state.filter("not over").count()
    return state.select("id", F.when(F.col("over") & ~F.col("dead"), F.col("at")).alias("primary_id"))


def _one_round(state: DataFrame) -> DataFrame:
    """Open links (id, at, dead, over) with their target's state. Those that are over meet nothing: their key is no link's id, another for each."""
    theirs = state.select(F.col("id").cast("string").alias("key"), F.col("at").alias("t_at"), F.col("dead").alias("t_dead"), F.col("over").alias("t_over"))
    own = state.withColumn("key", F.when(F.col("over"), F.concat(F.lit("over "), F.col("id").cast("string"))).otherwise(F.col("at").cast("string")))
    return own.join(theirs, "key", "left").select("id", F.coalesce("t_at", "at").alias("at"), F.coalesce("t_dead", "dead").alias("dead"), F.coalesce("t_over", "over").alias("over"))


def shared_openings(articles: DataFrame, min_group: int = 3, min_chars: int = 20) -> DataFrame:
    """(source_id, head, members): first paragraphs that at least ``min_group`` articles of a source share."""
    heads = articles.select("source_id", T.trimmed(T.head_paragraph(F.col("content_full"))).alias("head")).filter(F.char_length("head") >= min_chars)
    return heads.groupBy("source_id", "head").agg(F.count("*").alias("members")).filter(F.col("members") >= min_group)


def strip_shared_openings(articles: DataFrame, passes: int = 4, min_group: int = 3, min_chars: int = 20) -> DataFrame:
    """(id, content_full, stripped[, body_images]): shared openings are removed until none is left, ``passes`` times at most. A text is never emptied.

    The passes work on each article's first paragraphs alone; texts are looked at again once, at the end, where one is to be cut.
    Image anchors {i, url}, where ``articles`` has them, move up by the paragraphs that went; those before the text stay there.
    """
    parts = F.split("content_full", "\n\n")
    later = F.slice(F.filter(F.transform(F.slice(parts, 2, F.size(parts)), T.trimmed), lambda p: p != ""), 1, passes)
    rows = articles.select("id", "source_id", F.concat(F.array(T.trimmed(F.get(parts, F.lit(0)))), later).alias("heads"), F.lit(0).alias("stripped"))
    for _ in range(passes):
        # Settled, as a pass reads the rows twice: to count the openings, on the map side first, and to look up the few shared ones.
        now = settled(rows.withColumn("head", F.get("heads", F.col("stripped"))))
        shared = now.filter(F.char_length("head") >= min_chars).groupBy("source_id", "head").agg(F.count("*").alias("n")).filter(F.col("n") >= min_group)
        hit = F.col("n").isNotNull() & (F.size("heads") > F.col("stripped") + 1)
        rows = now.join(shared, ["source_id", "head"], "left").select("id", "source_id", "heads", (F.col("stripped") + hit.cast("int")).alias("stripped"))
    anchors = ["body_images"] if "body_images" in articles.columns else []
    cut = articles.select("id", "content_full", *anchors).join(rows.select("id", "stripped"), "id")
    rest = F.aggregate(F.sequence(F.lit(1), F.col("stripped")), F.col("content_full"), lambda t, _: T.without_head(t))
    moved = F.transform("body_images", lambda a: F.struct(F.greatest(a["i"] - F.col("stripped"), F.lit(0)).alias("i"), a["url"].alias("url"))) if anchors else None
    return cut.select("id", F.when(F.col("stripped") > 0, rest).otherwise(F.col("content_full")).alias("content_full"), "stripped", *([moved.alias("body_images")] if anchors else []))

"""SQL of queries whose expressions repeat often, put together from the constants they share with the operators."""

from __future__ import annotations

from presswork.functions import html as H
from presswork.functions import text as T

BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANK}+', ' ', 'g'), ' ')"


def strip_html(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, char in T.ENTITIES.items():
        out = f"replace({out}, {quoted(name)}, {quoted(char)})"
    return collapsed(out)


def junk(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {quoted(p.lower())})" for p in T.JUNK_PHRASES) + ")"


def paragraph_texts(html: str) -> str:
    blocks = rf"regexp_extract_all({html}, '(?is)<p\b[^>]*>(.*?)</p>', 1)"
    return f"list_filter(list_transform({blocks}, lambda b: {strip_html('b')}), lambda p: length(p) >= 24 AND NOT {junk('p')})"


def trim_tail(text: str, blocks: str = "blocks") -> str:
    """A SELECT's worth of expressions over a column ``blocks`` of the trimmed text's blocks."""
    goes = f"(b = '' OR (length(b) <= 400 AND regexp_matches(b, {quoted(T.TAIL_PROMOTION)})))"
    marks = f"list_transform({blocks}, lambda x, i: CASE WHEN {goes.replace('b = ', trimmed('x') + ' = ').replace('length(b)', f'length({trimmed('x')})').replace('regexp_matches(b,', f'regexp_matches({trimmed('x')},')} THEN 0 ELSE i END)"
    last = f"list_max({marks})"
    return trimmed(f"array_to_string(CASE WHEN {last} = 0 THEN {blocks} ELSE {blocks}[1:{last}] END, chr(10) || chr(10))")


def clean_page() -> str:
    drop = "|".join(rf"<{n}\b[^>]*>.*?</{n}>" for n in H.DROPPED)
    clean = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    clean = f"regexp_replace({clean}, '(?is){drop}', ' ', 'g')"
    return rf"regexp_replace({clean}, '(?i)</?(?:{'|'.join(H.DROPPED)})\b[^>]*>', ' ', 'g')"


SPLIT_TAGS = rf"'(?i)</?(?:{'|'.join(H.BLOCK_TAGS)})\b[^>]*>'"


def block_texts(html: str, least: int = 24) -> str:
    return f"list_filter(list_transform(string_split_regex({html}, {SPLIT_TAGS}), lambda b: {strip_html('b')}), lambda p: length(p) >= {least} AND NOT {junk('p')})"


def article_text() -> str:
    length = lambda x: f"coalesce(list_sum(list_transform({x}, lambda q: length(q))), 0)"
    inside = lambda n: rf"regexp_extract_all(page, '(?is)<{n}\b[^>]*>(.*?)</{n}>', 1)"
    inner = " || ".join(inside(n) for n in H.CONTAINERS)
    # Of the parts of one kind the one of the greatest weight above nothing, of equal ones the first.
    best = lambda n, weight: f"list_max(list_filter(list_transform({inside(n)}, lambda h, i: struct_pack(n := {weight}, pos := -i, h := h)), lambda x: x.n > 0)).h"
    dense = ", ".join([best(n, f"len({block_texts('h')})") for n in H.CONTAINERS] + [best("div", length(block_texts("h"))), "page"])
    return f"""WITH c AS (SELECT page_id, html, {clean_page()} AS page FROM pages),
i AS (SELECT page_id, unnest({inner}) AS part FROM c),
m AS (SELECT page_id, {paragraph_texts('part')} AS p FROM i),
b AS (SELECT page_id, max(struct_pack(n := {length('p')}, p := p)) AS best FROM m GROUP BY page_id),
w AS (SELECT c.page_id, html, page, best, {paragraph_texts('page')} AS whole FROM c LEFT JOIN b ON b.page_id = c.page_id),
x AS (SELECT page_id, html, page, CASE WHEN best IS NOT NULL AND (best.n >= 200 OR best.n >= {length('whole')}) THEN best.p ELSE whole END AS p0 FROM w),
v AS (SELECT page_id, html, p0, CASE WHEN len(p0) > 0 THEN '' ELSE coalesce({dense}) END AS dense FROM x),
y AS (SELECT page_id, html, CASE WHEN len(p0) > 0 THEN p0 ELSE {block_texts('dense')} END AS p1 FROM v),
z AS (SELECT page_id, html, {trimmed("array_to_string(list_filter(p1, lambda v, k: k = 1 OR v <> p1[k - 1]), chr(10) || chr(10))")} AS body FROM y),
t AS (SELECT page_id, html, string_split_regex(body, '\\n\\s*\\n') AS blocks FROM z),
r AS (SELECT page_id, html, {trim_tail('body')} AS body FROM t)
SELECT page_id, CASE WHEN regexp_matches(substr(html, 1, 200), '(?i)<\\s*/?\\s*[a-z]') AND length(body) >= 200 THEN substr(body, 1, 40000) ELSE '' END AS text FROM r"""


def tail_trim() -> str:
    return f"""WITH p AS (SELECT id, CASE WHEN id % 3 = 0 THEN content_full || chr(10) || chr(10) || 'Sign up for our letter' || chr(10) || chr(10) || 'Follow us on the net' ELSE content_full END AS t FROM a),
q AS (SELECT id, t, string_split_regex({trimmed('t')}, '\\n\\s*\\n') AS blocks FROM p)
SELECT id, length(t) AS before, length({trim_tail('t')}) AS after FROM q"""


def trimmed_tails() -> str:
    return f"""WITH n AS (SELECT id, content_full || CASE WHEN id % 3 = 0 THEN chr(10) || chr(10) || 'Sign up for our letter' ELSE '' END AS t FROM a WHERE content_full <> '' ORDER BY published_at DESC, id DESC LIMIT 500),
q AS (SELECT id, t, string_split_regex({trimmed('t')}, '\\n\\s*\\n') AS blocks FROM n), c AS (SELECT id, t, {trim_tail('t')} AS cut FROM q)
SELECT id, cut AS content_full FROM c WHERE cut <> '' AND cut <> {trimmed('t')}"""


def strip_openings(passes: int = 4) -> str:
    steps = ["WITH r0 AS (SELECT id, source_id, content_full AS t, 0 AS stripped FROM a)"]
    for k in range(passes):
        head, rest = trimmed("split_part(t, chr(10) || chr(10), 1)"), trimmed("substr(t, strpos(t, chr(10) || chr(10)) + 2)")
        steps.append(f"h{k} AS (SELECT *, {head} AS head, CASE WHEN strpos(t, chr(10) || chr(10)) > 0 THEN nullif({rest}, '') END AS rest FROM r{k})")
        steps.append(f"g{k} AS (SELECT *, rest IS NOT NULL AND length(head) >= 20 AND count(*) OVER (PARTITION BY source_id, head) >= 3 AS hit FROM h{k})")
        steps.append(f"r{k + 1} AS (SELECT id, source_id, CASE WHEN hit THEN rest ELSE t END AS t, stripped + hit::int AS stripped FROM g{k})")
    return ",\n".join(steps) + f"\nSELECT id, stripped, length(t) AS chars FROM r{passes} WHERE stripped > 0"

def filled(*values: str) -> str:
    """The first value that is neither null nor empty, else the empty string."""
    return "coalesce(" + ", ".join(f"nullif({v}, '')" for v in values) + ", '')"


def strip_markdown(x: str) -> str:
    return collapsed(rf"regexp_replace(regexp_replace(coalesce({x}, ''), {quoted(T.LINE_MARKS)}, '', 'g'), '\*\*|__', '', 'g')")


def letters(x: str, kind: str, first: int = 400) -> str:
    return f"length(regexp_replace(substr(coalesce({x}, ''), 1, {first}), '[^{kind}]', '', 'g'))"


def english(x: str) -> str:
    return f"({letters(x, 'A-Za-z')} > 2 * {letters(x, '一-鿿')} AND {letters(x, 'A-Za-z')} > 40)"


def ratio(x: str) -> str:
    han, latin = letters(x, "一-鿿"), letters(x, "A-Za-z")
    return f"(CASE WHEN {han} + {latin} > 0 THEN {han} / ({han} + {latin}) ELSE 0 END)"


def untranslated(x: str) -> str:
    """Whether a sentence of ten characters or more is not Chinese."""
    parts = rf"string_split(replace(regexp_replace({x}, '([。！？!?])', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1))"
    return f"(len(list_filter(list_transform({parts}, lambda v: {trimmed('v')}), lambda v: length(v) >= 10 AND {ratio('v')} < 0.3)) > 0)"


def topics(x: str) -> str:
    return f"coalesce(CAST({x} AS JSON)::VARCHAR[], [])"


def digests(rows: str) -> str:
    """CTEs that end in ``brief(id, kind, b)``: the digest of every text of ``rows`` (id, kind, lim, x)."""
    clause = "(?s)^(.{20,}[，、；：,;:])"
    return rf"""digest_of AS (SELECT id, kind, lim, {collapsed("coalesce(x, '')")} AS clean FROM ({rows})),
pieces_of AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(clean, '([。！？.!?])', '\1' || chr(1), 'g'), chr(1)), lambda v: {trimmed('v')}), lambda v: v <> '') AS ps FROM digest_of),
lengths_of AS (SELECT *, list_transform(range(1, len(ps) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda v: length(v)))) AS cum FROM pieces_of),
taken_of AS (SELECT *, coalesce(list_position(list_transform(cum, lambda c: c >= lim - 20), true), 0) AS hit FROM lengths_of),
whole_of AS (SELECT id, kind, {filled("array_to_string(ps[1:CASE WHEN hit = 0 THEN len(ps) WHEN cum[hit] > lim THEN hit - 1 ELSE hit END], '')", "ps[1]", "clean")} AS whole FROM taken_of),
short_of AS (SELECT id, kind, {trimmed(f"CASE WHEN length(whole) > 216 AND regexp_matches(whole, '{clause}') THEN regexp_extract(whole, '{clause}', 1) ELSE whole END")} AS short FROM whole_of),
brief AS (SELECT id, kind, CASE WHEN short = '' OR regexp_matches(short, '[。！？.!?]$') THEN short ELSE short || '。' END AS b FROM short_of)"""


def brief_texts(rows: str) -> str:
    """CTEs that end in ``said(id, brief)``: the brief of every row of the table ``rows``."""
    usable = lambda x: f"{ratio(x)} >= 0.3"
    kinds = ("digest_zh", "digest", "reason", "summary")
    material = " UNION ALL ".join([f"SELECT id, '{k}' AS kind, 108 AS lim, {k} AS x FROM {rows}" for k in kinds] + ["SELECT id, 'body', 216, body FROM excerpt", "SELECT id, 'title', 108, name FROM excerpt"])
    excerpt = lambda x: f"CASE WHEN {usable(x)} THEN substr({x}, 1, 400) END"

    def rung(kind: str) -> str:
        extra = "summary" if kind == "reason" else "reason"
        b, e, tail = f"d.{kind}", f"d.{extra}", f"regexp_replace(d.{extra}, '[，、；：,;: ]+$', '')"
        merged = f"(CASE WHEN regexp_matches({tail}, '[。！？.!?]$') THEN {b} || {tail} ELSE {b} || CASE WHEN regexp_matches({b}, '[。！？.!?]$') THEN '' ELSE '。' END || {tail} || '。' END)"
        joins = f"length({b}) < 70 AND {usable(e)} AND NOT contains({b}, {e}) AND {tail} <> '' AND length({merged}) <= 128"
        own = trimmed(f"coalesce(r.{kind}, '')")
        return f"WHEN {usable(own)} THEN CASE WHEN {joins} THEN {merged} ELSE {b} END"

    stored = trimmed("coalesce(r.brief_zh, '')")
    return f"""plain AS (SELECT id, {strip_markdown('content_zh')} AS zh, {strip_markdown('content_full')} AS own, {trimmed(filled('title_zh', 'title'))} AS name FROM {rows}),
excerpt AS (SELECT id, coalesce({excerpt('zh')}, {excerpt('own')}, '') AS body, name FROM plain),
{digests(material)},
d AS (SELECT id, {", ".join(f"max(b) FILTER (WHERE kind = '{k}') AS {k}" for k in (*kinds, 'body', 'title'))} FROM brief GROUP BY id),
said AS (SELECT r.id, CASE WHEN {ratio(stored)} >= 0.4 AND NOT {untranslated(stored)} THEN {stored} {" ".join(rung(k) for k in kinds)}
  WHEN length(d.body) >= 30 THEN d.body WHEN {ratio('e.name')} >= 0.4 THEN d.title ELSE '' END AS brief FROM {rows} r JOIN d ON d.id = r.id JOIN excerpt e ON e.id = r.id)"""


def story_words(x: str) -> str:
    """The sorted distinct words of a title or text as stories compare them."""
    stop = ", ".join(quoted(w) for w in T.STOPWORDS)
    low = f"lower(coalesce({x}, ''))"
    latin = f"list_filter(regexp_extract_all({low}, {quoted(T.STORY_WORD)}), lambda q: q NOT IN ({stop}))"
    pairs = f"list_transform(range(1, greatest(length({low}) - 1, 1) + 1), lambda i: substr({low}, i, 2))"
    return f"list_sort(list_distinct(CASE WHEN regexp_matches({low}, {quoted(T.CJK)}) THEN list_concat({latin}, {pairs}) ELSE {latin} END))"


STORY_TITLE = "coalesce(nullif(title_zh, ''), nullif(title, ''), '')"


def merge_candidates() -> str:
    over = lambda x, y: f"CASE WHEN least(len({x}), len({y})) > 0 THEN len(list_intersect({x}, {y})) / least(len({x}), len({y})) ELSE 0 END"
    return f"""WITH c AS (SELECT * FROM vis WHERE relevance = 1 AND status IN ('processed', 'failed') AND published_at >= timestamp '2024-01-31' - INTERVAL 30 DAY ORDER BY published_at DESC, id DESC LIMIT 40),
w AS (SELECT id, published_at AS at, {story_words(STORY_TITLE)} AS t, {story_words(f"substr({strip_html('content_full')}, 1, 4000)")} AS b FROM c),
p AS (SELECT x.id AS a, y.id AS b, {over('x.t', 'y.t')} AS title_overlap, {over('x.b', 'y.b')} AS body_overlap, greatest((x.at, x.id), (y.at, y.id)) AS newer, least((x.at, x.id), (y.at, y.id)) AS older FROM w x JOIN w y ON x.id < y.id WHERE len(list_intersect(x.t, y.t)) >= 2)
SELECT a, b, title_overlap, title_overlap + body_overlap / 10 AS score FROM p WHERE title_overlap >= 0.25 ORDER BY score DESC, newer DESC, older DESC LIMIT 8"""


def telegraphic(x: str) -> str:
    count = lambda kind: f"length(regexp_replace(coalesce({x}, ''), '[^{kind}]', '', 'g'))"
    pieces = rf"len(list_filter(string_split_regex(coalesce({x}, ''), '[。！？!?；;\n]'), lambda v: regexp_matches(v, '[一-鿿]')))"
    han, words = count("一-鿿"), count(T.FUNCTION_WORDS)
    return f"({han} >= 25 AND {words} * 100 < {han} * 6.5 AND {pieces} > 0 AND {han} < {pieces} * 14)"


def attribute(tag: str, name: str) -> str:
    pattern = quoted(rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
    return trimmed("concat(" + ", ".join(f"regexp_extract({tag}, {pattern}, {k})" for k in (1, 2, 3)) + ")")


#: What the pages' own HTML lacks: every way in which an image names its address, ties and noise.
IMAGES = (
    """<img class='a' data-src='/p/%s.jpg?a=1&amp;b=2'><img srcset='/s.png 100w, /l.png 800w'><img src='/logo.png'><img srcset='/b.jpg, /a.jpg'>"""
    """<img srcset='/w300.jpg 300w, /x2.jpg 2x'><img data-srcset='/d1.jpg 1.5x, /d2.jpg 1400w'><img src='data:x'><img src='/s.png 1'><img src="" data-original=/bare.jpg>"""
    """<img srcset='/bad.jpg 9z, /good.jpg 1w'><img src='https://cdn.example.com/abs.jpg'><img src='/b.jpg'>"""
)


def page_images() -> str:
    parts = f"list_filter(list_transform(string_split(coalesce(nullif({attribute('t', 'srcset')}, ''), {attribute('t', 'data-srcset')}), ','), lambda p: {trimmed('p')}), lambda p: p <> '')"
    second = r"lower(string_split_regex(p, '\s+')[2])"
    weight = rf"coalesce(try_cast(regexp_extract({second}, '^([0-9]+)w$', 1) AS double), floor(try_cast(regexp_extract({second}, '^([0-9]*\.?[0-9]+|[0-9]+\.)x$', 1) AS double) * 1000), 0)"
    widest = rf"coalesce(list_max(list_transform({parts}, lambda p, i: struct_pack(w := {weight}, at := -i, url := string_split_regex(p, '\s+')[1]))).url, '')"
    url = filled(*[attribute("t", a) for a in H.SOURCES], widest)
    for name, char in T.ENTITIES.items():
        url = f"replace({url}, '{name}', {quoted(char)})"
    origin = "regexp_extract(url, '^[a-z]+://[^/]+')"
    return rf"""WITH m AS (SELECT page_id, {origin} AS origin, html || replace({quoted(IMAGES)}, '%s', page_id::varchar) AS html FROM pages),
t AS (SELECT page_id, origin, unnest(regexp_extract_all(html, '(?is)<img\b[^>]*>')) AS t, generate_subscripts(regexp_extract_all(html, '(?is)<img\b[^>]*>'), 1) AS pos FROM m),
r AS (SELECT page_id, origin, pos, {trimmed(url)} AS url FROM t),
u AS (SELECT page_id, pos, CASE WHEN starts_with(url, '/') THEN origin || url ELSE url END AS url FROM r WHERE url <> '' AND NOT starts_with(url, 'data:')),
f AS (SELECT page_id, url, min(pos) AS pos FROM u WHERE NOT regexp_matches(url, {quoted(H.NOISE)}) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) <= 9)
SELECT page_id, coalesce(string_agg(url, ' ' ORDER BY pos), '') AS images FROM (SELECT page_id FROM pages) LEFT JOIN f USING (page_id) GROUP BY page_id"""


def page_contents() -> str:
    heads = f"list_filter({block_texts(clean_page(), 2)}, lambda b: length(b) BETWEEN 2 AND 30 AND NOT regexp_matches(b, '[。！？.!?,，;；:：]$') AND NOT regexp_matches(b, '^[0-9]'))"
    return f"SELECT page_id, array_to_string(({heads})[1:12], '|') AS contents FROM pages"


def page_sections() -> str:
    """Sections by the places of headings, of the page and of a version of it; pairs where the places agree."""
    heading = "(length(b) BETWEEN 2 AND 30 AND NOT regexp_matches(b, '[。！？.!?,，;；:：]$') AND NOT regexp_matches(b, '^[0-9]'))"
    starts = lambda x: f"list_filter(range(len({x})), lambda i: i = 0 OR list_transform({x}, lambda b: {heading})[i + 1])"
    return f"""WITH b AS (SELECT page_id, {block_texts(clean_page(), 2)} AS l FROM pages),
v AS (SELECT *, CASE page_id % 3 WHEN 0 THEN l WHEN 1 THEN l[2:] ELSE list_concat(l[1:greatest(len(l) - 1, 0)], ['And one more sentence stands at the end.']) END AS r FROM b),
s AS (SELECT *, {starts('l')} AS sl, {starts('r')} AS sr FROM v)
SELECT page_id, array_to_string(sl, ' ') AS starts, (CASE WHEN len(l) = 0 OR len(r) = 0 THEN 0 WHEN sl = sr THEN len(sl) ELSE 1 END)::int AS pairs,
  (CASE WHEN len(l) = 0 OR len(r) = 0 THEN 0 WHEN sl = sr AND len(sr) > 1 THEN sr[2] - sr[1] ELSE len(r) END)::int AS first_right FROM s"""


def reply_halves() -> str:
    parts = r"list_filter(string_split(regexp_replace(text, '([.!?。！？])\s*', '\1' || chr(1), 'g'), chr(1)), lambda p: p <> '')"
    return rf"""WITH p AS (SELECT conv_id, turn, text, {parts} AS ps FROM conversations),
e AS (SELECT *, list_transform(range(1, len(ps) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda v: length(v)))) AS ends FROM p),
c AS (SELECT *, least(greatest(len(list_filter(ends, lambda v: v < length(text) / 2)) + 1, 1), len(ps) - 1) AS cut FROM e)
SELECT conv_id, turn, CASE WHEN len(ps) < 2 THEN text ELSE array_to_string(ps[1:cut], ' ') || ' | ' || array_to_string(ps[cut + 1:], ' ') END AS halves FROM c"""


def chunk_plan() -> str:
    """Chunks and batches by walking paragraphs and chunks one step at a time, all texts at once."""
    blocks = rf"list_filter(list_transform(string_split_regex(content_full, '\n\s*\n'), lambda v: {trimmed('v')}), lambda v: v <> '')"
    return f"""WITH RECURSIVE p AS (SELECT id, list_transform({blocks}, lambda v: length(v)) AS ps FROM a),
w AS (SELECT id, 0::bigint AS i, 0::bigint AS n, 0::bigint AS c, 0::bigint AS own FROM p
  UNION ALL SELECT w.id, i + 1, CASE WHEN n + ps[i + 1] + 2 >= 3500 THEN 0 ELSE n + ps[i + 1] + 2 END, c + (n + ps[i + 1] + 2 >= 3500)::int, c FROM w JOIN p ON p.id = w.id WHERE i < len(ps)),
ends AS (SELECT id, arg_max(n, i) AS n, arg_max(own, i) AS own FROM w GROUP BY id),
g AS (SELECT w.id, CASE WHEN w.own = ends.own AND ends.n > 0 AND ends.n < 400 AND w.own > 0 THEN w.own - 1 ELSE w.own END AS chunk, ps[i] AS size FROM w JOIN p ON p.id = w.id JOIN ends ON ends.id = w.id WHERE i > 0),
k AS (SELECT id, chunk, (sum(size) + 2 * (count(*) - 1))::bigint AS size FROM g GROUP BY 1, 2),
l AS (SELECT id, list(size ORDER BY chunk) AS sizes FROM k GROUP BY id),
b AS (SELECT id, 0::bigint AS i, 0::bigint AS cur, 0::bigint AS n FROM l
  UNION ALL SELECT b.id, i + 1, CASE WHEN n > 0 AND n + sizes[i + 1] > 3500 THEN cur + 1 ELSE cur END, CASE WHEN n > 0 AND n + sizes[i + 1] > 3500 THEN sizes[i + 1] ELSE n + sizes[i + 1] END FROM b JOIN l ON l.id = b.id WHERE i < len(sizes)),
o AS (SELECT id, string_agg(cur::varchar, ' ' ORDER BY i) AS batch_of FROM b WHERE i > 0 GROUP BY id)
SELECT a.id, coalesce(len(l.sizes), 0)::bigint AS chunks, coalesce(o.batch_of, '') AS batch_of FROM a LEFT JOIN l ON l.id = a.id LEFT JOIN o ON o.id = a.id"""


DAY = f"""SELECT row_number() OVER (ORDER BY published_at DESC, r.id DESC) AS rank, {filled('title_zh', 'title')} AS title, link, coalesce(s.name, 'unknown') AS source, published_at, status = 'failed' AS degraded,
  coalesce(nullif({strip_markdown('summary')}, ''), '(no summary)') AS summary, tags FROM rep r LEFT JOIN s ON r.source_id = s.id WHERE published_at >= timestamp '2024-01-15' AND published_at < timestamp '2024-01-16'"""


def escaped(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def daily_report() -> str:
    return DAY


def report_markdown() -> str:
    entry = "concat_ws(chr(10), concat('## ', rank, '. ', title), '- source: ' || source, '- summary: ' || summary || CASE WHEN degraded THEN ' (degraded)' ELSE '' END, '- tags: ' || tags, '- link: ' || link)"
    return f"""WITH d AS ({DAY}) SELECT '2024-01-15' AS date, count(*) AS article_count, '# 2024-01-15' || chr(10) || chr(10) || coalesce(string_agg({entry}, chr(10) || chr(10) ORDER BY rank), 'no articles') AS content_md FROM d"""


def rss_items() -> str:
    return f"""WITH d AS ({DAY}) SELECT rank, '<item><title>' || {escaped('title')} || '</title><link>' || {escaped('link')} || '</link><guid isPermaLink="false">' || {escaped('link')} || '</guid><description>' || {escaped("substr(summary, 1, 600)")}
  || '</description><pubDate>' || strftime(published_at, '%a, %d %b %Y %H:%M:%S') || ' +0800</pubDate></item>' AS xml FROM d"""


def report_html() -> str:
    return f"""WITH d AS ({DAY}) SELECT '2024-01-15' AS date, '<h1>2024-01-15</h1><ol>' || coalesce(string_agg('<li><a href="' || {escaped('link')} || '">' || {escaped('title')} || '</a> ' || {escaped('source')} || '<p>' || {escaped('summary')} || '</p><p>' || {escaped('tags')} || '</p></li>', '' ORDER BY rank), '') || '</ol>' AS content_html FROM d"""


def enrichment() -> str:
    return """WITH p AS (SELECT id, length('Is this about news? ' || title || chr(10) || substr(content_full, 1, 4000)) AS n FROM a WHERE status = 'pending')
SELECT id, (n % 3 <> 0)::int AS relevance, CASE WHEN n % 3 <> 0 THEN (n % 101)::int END AS score, 'processed' AS status FROM p"""


def story_cards() -> str:
    return f"""WITH c AS (SELECT *, {trimmed('content_full')} AS t, (epoch(timestamp '2024-01-31') - epoch(published_at))::bigint AS sec, {strip_markdown('digest_zh')} AS zh, {strip_markdown(filled('digest_zh', 'digest'))} AS dg, {strip_markdown('reason')} AS why FROM rep)
SELECT c.id, coalesce(nullif(title_zh, ''), nullif(title, ''), 'untitled') AS title, coalesce(title_zh, '') AS title_zh, coalesce(s.name, 'unknown') AS source, split_part(split_part(link, '://', 2), '/', 1) AS host,
  strftime(published_at, '%H:%M') AS time, strftime(published_at, '%Y-%m-%d') AS date_key,
  CASE WHEN sec < 0 THEN '' WHEN sec < 60 THEN 'just now' WHEN sec < 3600 THEN (sec // 60)::varchar || ' min ago' WHEN sec < 86400 THEN (sec // 3600)::varchar || ' h ago'
    WHEN sec < 604800 THEN (sec // 86400)::varchar || ' d ago' ELSE strftime(published_at, '%Y-%m-%d') END AS age,
  {filled('dg', strip_markdown('summary'))} AS digest, zh AS digest_zh, CASE WHEN why = {filled('zh', 'dg')} THEN '' ELSE why END AS reason,
  CASE WHEN length(t) <= 120 THEN t ELSE regexp_replace(substr(t, 1, 120), '{BLANK}+$', '') || '…' END AS lead,
  array_to_string({topics('topics')}, '|') AS topic_list, replace(tags, ', ', '|') AS tag_list,
  CASE WHEN status = 'processed' THEN {trimmed("coalesce(content_zh, '')")} = '' AND {english('content_full')} ELSE {english(filled('digest', 'summary'))} END AS degraded,
  status = 'failed' AND {trimmed("coalesce(digest_zh, '')")} = '' AS pending, coalesce(process_attempts, 0) AS attempts, starred = 1 AS starred
FROM c LEFT JOIN s ON c.source_id = s.id"""

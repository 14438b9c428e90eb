"""DuckDB SQL for the training-data operators that SQL can express."""

from presswork.llm.quality_rules import CLASSES, COMMON_WORDS, NO_LANGUAGE, WORDS


def _divergence_rules(max_classes: float = 0.22, max_common: float = 0.36, max_sum: float = 0.5, min_chars: int = 300, min_words: int = 60, trim_classes: float = 0.2, trim_common: float = 0.32) -> str:
    """The rules in long form: one row for each document and histogram bin. Bins without the document's own counts add their share of the reference."""
    counts = ", ".join("length(text) - length(regexp_replace(text, '{0}', '', 'g')) AS c_{1}".format(p.replace("'", "''"), n) for n, p in CLASSES.items())
    bins = " UNION ALL ".join(f"SELECT doc_id, 'c' AS kind, '{n}' AS bin, c_{n} AS n FROM m" for n in CLASSES)
    other = " - ".join(["length(text)", *[f"c_{n}" for n in CLASSES]])
    langs = ", ".join(f"'{x}'" for x in COMMON_WORDS)
    words = ", ".join(f"('{w}')" for w in WORDS)
    none = ", ".join(f"'{x}'" for x in NO_LANGUAGE)
    letters = r"length(regexp_replace(regexp_replace(text, '[^\p{L}\p{M}]', '', 'g'), '\p{Latin}', '', 'g'))"
    code = "lower(regexp_extract(coalesce(b.lang, ''), '^[A-Za-z]*'))"
    foreign = f"(length(text) > c_space AND 2 * strlen(text) > 3 * length(text) AND 2 * {letters} >= length(text) - c_space)"
    without_reference = f"({foreign} OR ({code} NOT IN ({none}) AND {code} NOT IN (SELECT lang FROM r1)))"

    def reference(name: str, extra: str) -> str:
        return f"""{name} AS (SELECT r.lang, h.kind, h.bin, sum(h.n) / sum(sum(h.n)) OVER (PARTITION BY r.lang, h.kind) AS q
  FROM sound r JOIN hist h ON h.doc_id = r.doc_id WHERE {extra} GROUP BY r.lang, h.kind, h.bin)"""

    def distance(name: str, ref: str) -> str:
        return f"""{name} AS (SELECT doc_id, lang, max(d) FILTER (WHERE kind = 'c') AS dc, max(d) FILTER (WHERE kind = 'w') AS dw FROM (
  SELECT h.doc_id, l.lang, h.kind, sqrt(greatest(0.0, (sum(h.p * log2(2 * h.p / (h.p + coalesce(q, 0))) + CASE WHEN q > 0 THEN q * log2(2 * q / (h.p + q)) ELSE 0 END) + 1 - sum(coalesce(q, 0))) / 2)) AS d
  FROM (SELECT doc_id, kind, bin, n / sum(n) OVER (PARTITION BY doc_id, kind) AS p FROM hist QUALIFY p > 0) h
  CROSS JOIN (SELECT DISTINCT lang FROM {ref}) l LEFT JOIN {ref} r ON r.lang = l.lang AND r.kind = h.kind AND r.bin = h.bin GROUP BY 1, 2, 3) GROUP BY 1, 2)"""

    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 7], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS pos FROM t WHERE len(words) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS place FROM (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1)) GROUP BY doc_id),
m AS (SELECT t.doc_id, lang, text, words, len(words) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words, {counts},
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id),
k AS (SELECT * FROM (VALUES {words}) v(w)),
cw AS (SELECT doc_id, w AS bin, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM m) JOIN k USING (w) GROUP BY 1, 2),
hist AS ({bins} UNION ALL SELECT doc_id, 'c', 'other', {other} FROM m UNION ALL SELECT doc_id, 'w', bin, n FROM cw
  UNION ALL SELECT m.doc_id, 'w', '*', n_words - coalesce((SELECT sum(n) FROM cw WHERE cw.doc_id = m.doc_id), 0) FROM m),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
sound AS (SELECT doc_id, lang FROM b WHERE NOT base_failed AND n_words >= 60 AND lang IN ({langs})),
{reference("r0", "true")},
{distance("d0", "r0")},
{reference("r1", f"EXISTS (SELECT 1 FROM d0 WHERE d0.doc_id = r.doc_id AND d0.lang = r.lang AND dc <= {trim_classes} AND dw <= {trim_common})")},
{distance("d1", "r1")},
near AS (SELECT doc_id, arg_min(dc, dc + dw) AS dc, arg_min(dw, dc + dw) AS dw FROM d1 GROUP BY doc_id)
SELECT b.doc_id, n_words, CAST(length(text) - c_space AS BIGINT) AS word_chars, CAST(c_symbol AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND ({without_reference} OR NOT coalesce(length(text) - c_space >= {min_chars} AND dc > {max_classes}, false) AND NOT coalesce(n_words >= {min_words} AND (dw > {max_common} OR dc + dw > {max_sum}), false)) AS kept
FROM b LEFT JOIN near ON near.doc_id = b.doc_id
"""


def _vector_codes(rounds: int = 4) -> str:
    """Codebooks as rows (p, e, c), one set for each round; distances are exact sums of whole doubles."""

    def nearest(books: str) -> str:
        far = "list_dot_product(b.c, b.c) - 2 * list_dot_product(x.v, b.c)"
        return f"SELECT x.rn, x.p, arg_min(b.e, struct_pack(d := {far}, e := b.e)) AS e, min({far}) + list_dot_product(any_value(x.v), any_value(x.v)) AS d FROM x JOIN {books} b USING (p) GROUP BY x.rn, x.p"

    def improved(n: int) -> str:
        return f"""a{n} AS MATERIALIZED ({nearest(f"b{n}")}),
m{n} AS (SELECT p, e, list(s ORDER BY i) AS c FROM (SELECT a.p, a.e, u.i, floor(sum(u.y) / count(*)) AS s FROM a{n} a JOIN u USING (rn, p) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m USING (p, e))"""

    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) AS rn, * FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
x AS MATERIALIZED (SELECT rn, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS v FROM k, range(4) r(p)),
u AS MATERIALIZED (SELECT rn, p, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM x),
b0 AS MATERIALIZED (SELECT p, rn - 1 AS e, v AS c FROM x WHERE rn <= 256),
{", ".join(improved(n) for n in range(rounds))},
f AS ({nearest(f"b{rounds}")}),
o AS (SELECT rn, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d) AS error FROM f GROUP BY rn),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::bigint), ','), ',' ORDER BY p, e)) AS digest FROM b{rounds})
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM o JOIN k USING (rn), h
"""


ORACLES = {
    "op12_vector_codes": _vector_codes(),
    "op4_divergence_rules": _divergence_rules(),
    "op10_line_dedup": r"""
WITH line AS (
  SELECT d.doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents d,
       LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos) u),
common AS (
  SELECT k, max(doc_id) AS keeper FROM line WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT l.doc_id, l.pos, l.line, c.k IS NOT NULL AND c.keeper <> l.doc_id AS lost FROM line l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
}

"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import quality_rules as q

REACH = """
     r(node, other) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM r JOIN links l ON r.other = l.a),
     c AS (SELECT node, least(node, min(other)) AS component FROM r GROUP BY node)"""

NGRAM = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
     u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS same FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
     one AS (SELECT a, b FROM p WHERE 100 * same >= 80 * (na + nb - same)),
     links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),{REACH}
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component, s.doc_id) AS component_id FROM s LEFT JOIN c ON c.node = s.doc_id"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
     n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.l > 0 AND b.l > 0 AND list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.9),
     links AS (SELECT a, b FROM p),{REACH},
     d AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(c.component, v.vec_id) AS component_id, v.vec_id = coalesce(c.component, v.vec_id) AS kept
FROM v LEFT JOIN c ON c.node = v.vec_id LEFT JOIN d ON d.a = v.vec_id"""


def _without(characters: str) -> str:
    quoted = characters.replace("'", "''")
    return f"(length(s) - length(translate(s, '{quoted}', '')))"


def _distance(p: str, q_: str) -> str:
    """The Jensen-Shannon distance of two lists of counts."""
    x, y = f"({p}[i] / list_sum({p}))", f"({q_}[i] / list_sum({q_}))"
    term = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({x} + {y}) / 2)) ELSE 0.0 END"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q_}) > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {term(x)} + {term(y)})) / 2, 0.0)) END"


_STOP = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in q.COMMON_WORDS.items()) + f" ELSE {q.COMMON_WORDS['en']} END"

QUALITY = rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS s FROM documents),
     w AS (SELECT *, list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
     n AS (SELECT doc_id, lang, w, len(w)::BIGINT AS n_words, length(regexp_replace(s, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, {_without("#*$%&|<>")}::BIGINT AS n_symbols,
                  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, {_without("0123456789")} AS digits, {_without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")} AS upper, {_without(".,;:!?'" + chr(34) + "()[]{}-_/" + chr(92) + "@=+~^`")} AS punct, length(s) AS chars FROM w),
     g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS win FROM n WHERE len(w) >= 3),
     d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM g) x WHERE k > 1),
     r AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM d) x GROUP BY doc_id),
     f AS (SELECT n.doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
                  [word_chars - n_symbols - digits - upper - punct, upper, digits, punct, n_symbols, chars - word_chars]::DOUBLE[] AS classes,
                  list_transform({_STOP}, lambda y: len(list_filter(w, lambda x: lower(x) = y)))::DOUBLE[] AS seen FROM n LEFT JOIN r ON r.doc_id = n.doc_id),
     h AS (SELECT *, list_append(seen, n_words - list_sum(seen)) AS words FROM f),
     e AS (SELECT lang, sum(n_words) AS total, {"[" + ", ".join(f"sum(classes[{i + 1}])" for i in range(6)) + "]"} AS classes, {"[" + ", ".join(f"sum(words[{i + 1}])" for i in range(21)) + "]"} AS words FROM h GROUP BY lang),
     a AS (SELECT {"[" + ", ".join(f"sum(classes[{i + 1}])" for i in range(6)) + "]"} AS classes FROM h),
     j AS (SELECT h.*, e.lang IS NOT NULL AND e.total >= {q.LEAST_REFERENCE_WORDS} AS own, CASE WHEN e.lang IS NOT NULL AND e.total >= {q.LEAST_REFERENCE_WORDS} THEN e.classes ELSE a.classes END AS rc, e.words AS rw
           FROM h LEFT JOIN e ON e.lang IS NOT DISTINCT FROM h.lang CROSS JOIN a),
     k AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_distance("classes", "rc")} AS cd, CASE WHEN own AND lang IN ('en', 'de', 'fr', 'es') THEN {_distance("words", "rw")} END AS wd FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words >= {q.LEAST_CLASS_WORDS} AND coalesce(cd, 0) > {q.MOST_CLASS_DISTANCE}) AND NOT (n_words >= {q.LEAST_COMMON_WORDS} AND coalesce(wd, 0) > {q.MOST_WORD_DISTANCE}) AS kept
FROM k"""


def _codes(rounds: int = 2) -> str:
    """Product codes of 16 parts and 64 entries: distance and entry of each part packed in one integer, 64 * distance + entry."""
    nearest = """SELECT vec_id, p.part, min(64 * list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - e.x[i]) * (p.x[i] - e.x[i])))::BIGINT + k) AS m FROM p JOIN {e} e ON e.part = p.part GROUP BY ALL"""
    steps = "\n".join(
        f"""     a{r} AS ({nearest.format(e=f"e{r}")}),
     s{r} AS (SELECT part, m % 64 AS k, i, count(*) AS n, sum(v)::BIGINT AS v FROM (SELECT p.part, m, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM p JOIN a{r} a ON a.vec_id = p.vec_id AND a.part = p.part) y GROUP BY ALL),
     f{r} AS (SELECT part, k, list((v - ((v % n) + n) % n) // n ORDER BY i)::BIGINT[] AS x FROM s{r} GROUP BY part, k),
     e{r + 1} AS (SELECT e.part, e.k, coalesce(f.x, e.x) AS x FROM e{r} e LEFT JOIN f{r} f ON f.part = e.part AND f.k = e.k),"""
        for r in range(rounds)
    )
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
     p AS (SELECT vec_id, part, x[part * (len(x) // 16) + 1:(part + 1) * (len(x) // 16)] AS x FROM v, range(16) t(part)),
     o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v QUALIFY k < 64),
     e0 AS (SELECT part, k, x FROM p JOIN o ON o.vec_id = p.vec_id),
{steps}
     c AS ({nearest.format(e=f"e{rounds}")}),
     r AS (SELECT c.vec_id, string_agg(format('{{:02x}}', m % 64), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM c GROUP BY c.vec_id),
     b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM e{rounds})
SELECT v.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN r ON r.vec_id = v.vec_id CROSS JOIN b"""


SPELLING = r"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) x(i)) y),
     s AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
     u AS (SELECT run, string_split(d || ':' || run, '') AS l FROM s WHERE length(run) >= 6),
     y AS (SELECT run, flatten(list_transform(l, lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)) AS y FROM u),
     h AS (SELECT run, xor(list_reduce(y, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM y CROSS JOIN t),
     q AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM h),
     w AS (SELECT word, count(*) AS n FROM q WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
     z AS (SELECT word, n, i, length(word) AS l, left(word, i::BIGINT) || substr(word, i::BIGINT + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w) x),
     p AS (SELECT a.word, b.word AS near FROM z a JOIN z b ON a.i = b.i AND a.l = b.l AND a.cut = b.cut AND a.word <> b.word UNION SELECT z.word, w.word FROM z JOIN w ON z.cut = w.word UNION SELECT w.word, z.word FROM z JOIN w ON z.cut = w.word),
     b AS (SELECT p.word, count(*) AS n_near, max(w.n) AS most FROM p JOIN w ON w.word = p.near GROUP BY p.word),
     k AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM w LEFT JOIN b ON b.word = w.word),
     f AS (SELECT k.word, min(encode(p.near)) AS form FROM k JOIN p ON p.word = k.word JOIN w ON w.word = p.near AND w.n = k.form_n GROUP BY k.word),
     g(word, here, steps) AS (SELECT word, word, 0 FROM w UNION ALL SELECT g.word, decode(f.form), steps + 1 FROM g JOIN f ON f.word = g.here),
     r AS (SELECT word, arg_max(here, steps) AS root FROM g GROUP BY word)
SELECT k.word, decode(f.form) AS form, root, n, n_near, form_n FROM k JOIN r ON r.word = k.word LEFT JOIN f ON f.word = k.word"""

LINES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
     k AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i, unnest(list_transform(l, lambda x: translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS key FROM d),
     f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON f.key = k.key GROUP BY k.r, k.doc_id"""

SQL = {"op2_ngram_join": NGRAM, "op6_quality_rules": QUALITY, "op8_embedding_dedup": EMBEDDINGS, "op11_vector_codes": _codes(), "op12_spelling_variants": SPELLING, "op13_line_dedup": LINES}

"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from orrery.llm import licenses, line_dedup, secret_scan
from orrery.llm.common import LOWER, UPPER

SPACED = r"[^\x20\x09-\x0D]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def folded(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


def license_scans() -> str:
    rows = []
    for i, (text, label, phrase) in enumerate([(t, x, True) for t, x in licenses.PHRASES] + [(t, x, False) for t, x in licenses.NOTICES]):
        words = licenses.words_of(text)
        rows += [f"({i}, {quoted(label)}, {phrase}, {len(words) - 1}, {j}, {quoted(a)}, {quoted(b)})" for j, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return rf"""
WITH t(template, label, phrase, n_pairs, t_place, t_first, t_second) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, regexp_extract_all({folded("text")}, '{licenses.WORD}') w FROM documents),
x AS (SELECT doc_id, unnest(range(len(w))) pos, unnest(w) a, unnest(list_append(w[2:], '')) b FROM d WHERE len(w) > 0),
h AS (SELECT DISTINCT doc_id, template, label, phrase, n_pairs, pos - t_place diagonal, t_place FROM x JOIN t ON a = t_first AND b = t_second),
g AS (SELECT DISTINCT doc_id, template, phrase, diagonal FROM h),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > CASE WHEN phrase THEN 0 ELSE {licenses.SLACK} END THEN 1 ELSE 0 END fresh FROM g),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) island FROM n),
s AS (SELECT h.doc_id, h.template, island, any_value(label) label, any_value(h.phrase) phrase, min(h.diagonal + t_place) start, count(DISTINCT t_place) / any_value(n_pairs) AS share, any_value(n_pairs) n_pairs
      FROM h JOIN i USING (doc_id, template, diagonal) GROUP BY 1, 2, 3),
v AS (SELECT *, phrase AND share >= 1 base FROM s WHERE share >= CASE WHEN phrase OR n_pairs < {licenses.FEW_PAIRS} THEN 1 ELSE {licenses.MIN_SHARE} END),
r AS (SELECT doc_id, count(*) FILTER (WHERE base) n_base, min(start) FILTER (WHERE base) first_word, max(start) FILTER (WHERE base) last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) base_labels, string_agg(DISTINCT label, ',' ORDER BY label) labels, round(max(share), 6) score FROM v GROUP BY 1)
SELECT doc_id, len(w) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0.0) score
FROM d LEFT JOIN r USING (doc_id)"""


def secret_scans() -> str:
    parts = []
    for i, rule in enumerate(secret_scan.RULES):
        pattern = quoted(rule.pattern)
        parts.append(
            f"SELECT doc_id, '{rule.kind}' kind, {i} ord, {str(rule.base).upper()} base, unnest(m) m, unnest(list_transform(range(1, len(m) + 1), "
            f"lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) start "
            f"FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) m, string_split_regex(text, {pattern}) p FROM documents WHERE regexp_matches(text, {pattern}))"
        )
    union = " UNION ALL ".join(parts)
    assign = next(r for r in secret_scan.RULES if r.min_chars > 1)
    return f"""
WITH a AS ({union}),
s AS (SELECT *, kind || ':' || start || ':' || (start + length(m)) AS span FROM a WHERE kind != '{assign.kind}' OR length(regexp_extract(m, {quoted(assign.pattern)}, {assign.value})) >= {assign.min_chars}),
r AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') n_assign, count(*) FILTER (WHERE kind = 'access') n_access, count(*) FILTER (WHERE kind = 'hex') n_hex,
      string_agg(span, ',' ORDER BY start, ord) FILTER (WHERE base) base, string_agg(span, ',' ORDER BY start, ord) spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
FROM (SELECT doc_id FROM documents) LEFT JOIN r USING (doc_id)"""


def line_dedup_sql() -> str:
    split = "string_split(coalesce(text, ''), chr(10))"
    return rf"""
WITH x AS (SELECT doc_id, unnest({split}) line, unnest(range(len({split}))) line_no FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) k FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT line, length(line) n, row_number() OVER (ORDER BY doc_id, line_no) place FROM l WHERE k = 1 AND length(line) >= {line_dedup.MIN_CHARS}),
near AS (SELECT DISTINCT CASE WHEN a.place > b.place THEN a.line ELSE b.line END line FROM f a JOIN f b ON a.n BETWEEN b.n AND b.n + 1 AND a.place != b.place
         AND (left(a.line, b.n // 2) = left(b.line, b.n // 2) OR right(a.line, b.n // 2) = right(b.line, b.n // 2)) AND levenshtein(a.line, b.line) <= 1),
g AS (SELECT doc_id, line_no, k = 1 AS near FROM l LEFT JOIN near ON l.line = near.line WHERE k > 1 OR near.line IS NOT NULL),
n AS (SELECT doc_id, count(*) n_lines FROM l GROUP BY 1),
r AS (SELECT doc_id, count(*) FILTER (WHERE NOT near) n_exact, count(*) FILTER (WHERE near) n_near, string_agg(line_no, ',' ORDER BY line_no) gone FROM g GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_exact, 0) n_exact, coalesce(n_near, 0) n_near, coalesce(gone, '') gone
FROM (SELECT doc_id FROM documents) LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)"""


def jaccard_join_sql() -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({folded("text")}, '{SPACED}') w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END g FROM d),
n AS (SELECT doc_id, len(g) n FROM s),
x AS (SELECT doc_id, unnest(g) g FROM s),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT doc_id, min(other) least_id FROM r GROUP BY 1),
k AS (SELECT a doc_id, count(*) n_links FROM e GROUP BY 1)
SELECT n.doc_id, n.n n_shingles, least(n.doc_id, coalesce(least_id, n.doc_id)) component_id, coalesce(n_links, 0) n_links
FROM n LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)"""


def hard_negatives_sql() -> str:
    return """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) v
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id anchor_id, b.vec_id other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) score FROM e a JOIN e b ON a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, p.other_id positive_id, n.other_id negative_id, p.score positive_score, n.score negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) r
      FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 10"""


def centroid_clusters_sql() -> str:
    """Five rounds and the last assignment, each a step of its own; every pair is measured."""
    distance = "CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT)"
    steps = []
    for i in range(6):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) v, arg_min(cid, ({distance}, cid)) cid, min({distance}) distance FROM e, c{i} GROUP BY vec_id)")
        if i < 5:
            parts = f"SELECT cid, unnest(range(64)) pos, unnest(v) x FROM a{i}"
            floors = f"SELECT cid, list(floor(total / n) ORDER BY pos) c FROM (SELECT cid, pos, sum(x) total, count(*) n FROM ({parts}) GROUP BY 1, 2) GROUP BY 1"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cid, coalesce(m.c, c{i}.c) c FROM c{i} LEFT JOIN ({floors}) m USING (cid))")
    return f"""
WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 cid, v c FROM e QUALIFY cid < 40),
{", ".join(steps)},
t AS (SELECT cid, sum(distance) total FROM a5 GROUP BY 1)
SELECT vec_id, CAST(cid AS INTEGER) AS cluster, distance, CAST(total AS BIGINT) cluster_inertia, CAST((SELECT sum(total) FROM t) AS BIGINT) inertia,
       sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) centroid_sha256
FROM a5 JOIN t USING (cid) JOIN c5 USING (cid)"""


def warc_archives_sql() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') html FROM pages),
f AS (SELECT page_id, html, strlen(html) n, sha256(html) digest, min(page_id) OVER (PARTITION BY html) least FROM p)
SELECT page_id, n payload_bytes, digest payload_digest, CASE WHEN n >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END record_type,
       CASE WHEN n >= 100 AND page_id > least THEN least END refers_to FROM f"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scans": license_scans(),
        "op2_secret_scans": secret_scans(),
        "op5_line_dedup": line_dedup_sql(),
        "op9_jaccard_join": jaccard_join_sql(),
        "op11_hard_negatives": hard_negatives_sql(),
        "op12_centroid_clusters": centroid_clusters_sql(),
        "op13_warc_archives": warc_archives_sql(),
    }

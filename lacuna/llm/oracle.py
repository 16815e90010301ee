"""SQL with the results of the queries, for DuckDB. Where an operator learns or searches, there is none."""

from __future__ import annotations

from lacuna.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, template_words

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


_SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
),
firsts AS (SELECT s, min(doc_id) AS f FROM windows GROUP BY s),
repeated AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE f < doc_id),
hits AS (SELECT DISTINCT doc_id, i + k AS p FROM repeated, range(50) t(k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN hits USING (doc_id, p) GROUP BY doc_id
),
gone AS (SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _escaped(column: str) -> str:
    return rf"replace(replace(replace(coalesce({column}, ''), '\', '\\'), '</turn>', '\</turn>'), '### ', '\### ')"


_CHAT = rf"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
sized AS (
    SELECT *, 13 + length(replace({_escaped("role")}, chr(10), '\n')) + length({_escaped("text")}) AS size,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
        count(*) OVER (PARTITION BY conv_id) AS n
    FROM t
),
placed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
    CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN prefix ELSE 0 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

_DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_low("text")}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_low("text")}, '{_ALNUM}') AS w FROM benchmark),
units AS (
    SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS s
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, least(10, len(w)) AS size FROM b WHERE len(w) > 0))
),
sizes AS (SELECT DISTINCT size FROM units),
windows AS (
    SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS s
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
),
found AS (SELECT doc_id, size, i, item FROM windows JOIN units USING (size, s)),
hits AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id
),
items AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t
    FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
    sha256(coalesce(items.t, '')) AS items_sha256, hits.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _licenses() -> str:
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS start, '{label}' AS label FROM starts WHERE "
        + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    sets = {t: template_words(x) for t, x in TEMPLATES.items()}
    values = ", ".join(f"('{t}', '{w}', {len(s)})" for t, s in sets.items() for w in s)
    return rf"""
WITH d AS (SELECT doc_id, {_low("text")} AS low, regexp_extract_all({_low("text")}, '{_ALNUM}') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
places AS ({phrases}),
base AS (SELECT doc_id, count(*) AS n, min(start) AS a, max(start) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
templates(template, word, size) AS (VALUES {values}),
lines AS (SELECT doc_id, unnest(string_split(low, chr(10))) AS line, generate_subscripts(string_split(low, chr(10)), 1) AS k FROM d),
tokens AS (SELECT DISTINCT doc_id, k, unnest(regexp_extract_all(line, '{_ALNUM}')) AS word FROM lines),
shares AS (
    SELECT doc_id, k, template, count(*) / any_value(size) AS share FROM tokens JOIN templates USING (word)
    GROUP BY doc_id, k, template HAVING count(*) >= {CONTAINMENT} * any_value(size) - 1e-9
),
best AS (SELECT doc_id, max(share) AS share FROM shares GROUP BY doc_id),
every AS (SELECT doc_id, label FROM places UNION SELECT doc_id, template FROM shares),
labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word,
    coalesce(base.labels, '') AS base_labels, coalesce(labels.labels, '') AS labels,
    greatest(coalesce(share, 0.0), CASE WHEN n IS NULL THEN 0.0 ELSE 0.5 END)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN labels USING (doc_id)
"""


_WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS f FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
    CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN f < page_id THEN f END AS refers_to
FROM p LEFT JOIN firsts USING (digest)
"""

_TOPK = """
WITH every AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
good AS (SELECT vec_id FROM every GROUP BY vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x))),
v AS (SELECT vec_id, k, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM every JOIN good USING (vec_id)),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.k = c.k AND q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY q.vec_id, c.vec_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""

_NEGATIVES = """
WITH every AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE label IS NOT NULL),
good AS (SELECT vec_id FROM every GROUP BY vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x))),
v AS (SELECT vec_id, k, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM every JOIN good USING (vec_id)),
named AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
    FROM embeddings JOIN good USING (vec_id) WHERE label IS NOT NULL
),
scores AS (
    SELECT q.vec_id AS anchor_id, c.vec_id AS other, CAST(sum(q.x * c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.k = c.k AND q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY q.vec_id, c.vec_id
),
pairs AS (
    SELECT anchor_id, other, score, a.label = b.label AS same
    FROM scores JOIN named a ON a.vec_id = anchor_id JOIN named b ON b.vec_id = other
),
positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score
    FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS r FROM pairs WHERE same) WHERE r <= 5
),
ranked AS (
    SELECT p.*, other AS negative_id, score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS r
    FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same
        AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE r <= 10
"""

_LEXICAL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_low("text")}, '{_ALNUM}') AS w FROM documents),
sizes AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_low("text")}, '{_ALNUM}')) AS term FROM benchmark),
dfs AS (SELECT term, count(*) AS df FROM tfs WHERE term IN (SELECT term FROM asked) GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM dfs, total),
shares AS (
    SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))) AS part
    FROM tfs JOIN weights USING (term) JOIN sizes USING (doc_id), total
),
scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN shares USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 10
"""

#: The given pages have one element ``article`` each and nothing else in it than h1, p, b and br.
_MAINTEXT = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS inside FROM pages),
pieces AS (SELECT page_id, url, string_split_regex(inside, '</?(h1|p)>') AS parts FROM a),
plain AS (
    SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(
        regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<br>', ' ', 'g'),
        '&quot;', '"'), '&lt;', '<'), '&gt;', '>')) AS parts
    FROM pieces
),
decoded AS (
    SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
        regexp_replace(x, '&amp;?', '&', 'g'), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'))), lambda x: x <> '') AS parts
    FROM plain
)
SELECT page_id, url, array_to_string(parts, chr(10)) AS text, length(array_to_string(parts, chr(10))) AS n_chars FROM decoded
"""

ORACLES = {
    "op1_substrings": _SUBSTRINGS,
    "op5_chat": _CHAT,
    "op6_decontamination": _DECONTAMINATION,
    "op7_licenses": _licenses(),
    "op8_warc": _WARC,
    "op10_topk": _TOPK,
    "op11_negatives": _NEGATIVES,
    "op12_lexical": _LEXICAL,
    "op13_maintext": _MAINTEXT,
}

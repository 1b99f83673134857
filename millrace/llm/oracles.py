"""DuckDB SQL of the operators that SQL can express, with all columns of their queries."""

from __future__ import annotations

from .quality import MAX_DOCUMENTS, MIN_LEFT, REPEATED, SYMBOLS

_WORD = r"'[^\x20\x09-\x0D]+'"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Links by counting common shingles, components by all that is reachable.
NEAR_DUPLICATES = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), {_WORD}) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""

#: Counts within a text; lines of a host by distinct documents.
QUALITY = f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, {_SPACE}) <> '') AS lines FROM documents),
v AS (SELECT doc_id, i, hash(array_to_string(w[i:i + {REPEATED - 1}], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {REPEATED - 2})) AS i FROM d WHERE len(w) >= {REPEATED})),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM v) WHERE n > 1),
q AS (SELECT doc_id, sum(least({REPEATED}, coalesce(after - i, {REPEATED})))::bigint AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM t) GROUP BY 1),
e AS MATERIALIZED (SELECT doc_id, host, lower(trim(l, {_SPACE})) AS line, length(trim(l, {_SPACE})) AS chars FROM (SELECT doc_id, host, unnest(lines) AS l FROM d)),
f AS (SELECT host, line FROM e GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > {MAX_DOCUMENTS}),
g AS (SELECT doc_id, 1 - sum(CASE WHEN f.line IS NOT NULL THEN chars ELSE 0 END) / sum(chars) AS "left" FROM e LEFT JOIN f ON e.host = f.host AND e.line = f.line GROUP BY 1),
c AS (SELECT doc_id, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars, (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint AS n_symbols, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce("left", 1.0) AS "left" FROM d LEFT JOIN q USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND "left" >= {MIN_LEFT} AS kept FROM c"""

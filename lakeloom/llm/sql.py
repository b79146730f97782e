"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from . import decontam, lines, mixing, negatives, quality, search, secrets, tokens
from .common import UPPER

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _rules(rules: tuple[quality.Rule, ...]) -> str:
    tests = [f"{r.metric} < {r.low}" for r in rules if r.low is not None] + [f"{r.metric} > {r.high}" for r in rules if r.high is not None]
    return " OR ".join(tests)


OP2_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5),
keyed AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 4], ' ')) AS c FROM starts),
covered AS (SELECT DISTINCT doc_id, i + o AS p FROM keyed, (SELECT unnest(range(0, 5)) AS o) WHERE c > 1),
repeats AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, greatest(len(ws), 1) AS n, greatest(len(ls), 1) AS nl,
         length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^{quality.SYMBOLS}]+', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters,
         length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
         len(regexp_extract_all(t, '!!+|\?\?+')) AS n_bangs,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: list_contains({[*dict.fromkeys(quality.STOP_FORMS)]!r}, x))) AS n_stops,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•▪‣]'))) AS n_bullets,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses
  FROM w LEFT JOIN repeats r ON r.doc_id = w.doc_id),
ratios AS (
  SELECT *, 100.0 * n_repeat_words / n AS repeat_pct, word_chars::DOUBLE / n AS mean_word_chars, n_symbols::DOUBLE / n AS symbols_per_word,
         (n_stops + 0.2::DOUBLE) / n AS stop_ratio, n_upper::DOUBLE / greatest(n_letters, 1) AS upper_ratio,
         n_letters::DOUBLE / greatest(word_chars, 1) AS alpha_ratio, n_bangs::DOUBLE / n AS bang_ratio,
         n_dup_lines::DOUBLE / nl AS dup_line_ratio, n_bullets::DOUBLE / nl AS bullet_ratio, n_ellipses::DOUBLE / nl AS ellipsis_ratio
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, ({_rules(quality.BASE_RULES)}) AS base_failed,
       NOT ({_rules(quality.BASE_RULES + quality.RULES)}) AS kept
FROM ratios"""


def _kind(kind: secrets.Kind, rank: int) -> str:
    pattern = kind.pattern.replace("'", "''")
    return rf"""
  SELECT doc_id, owner, repo, {rank} AS rank, '{kind.name}' AS kind, val,
         list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start, length(hit) AS size
  FROM (SELECT doc_id, owner, repo, pieces, hits, unnest(hits) AS hit, unnest(vals) AS val, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT doc_id, owner, repo, regexp_split_to_array(t, '{pattern}') AS pieces, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {kind.value}) AS vals
              FROM d WHERE regexp_matches(t, '{pattern}')))
  WHERE length(val) >= {kind.least}"""


_KINDS = (*secrets.BASE_KINDS, *secrets.MORE_KINDS)
_N = len(secrets.BASE_KINDS)
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, to_json({{'s': source, 'l': lang}}) AS repo, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_kind(k, i) for i, k in enumerate(_KINDS))}),
spans AS (SELECT doc_id, owner, repo, rank, kind, val, start::BIGINT AS start, (start + size)::BIGINT AS stop FROM found),
apart AS (
  SELECT * FROM spans m WHERE rank < {_N} OR NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.doc_id = m.doc_id AND b.rank < {_N} AND m.stop > b.start AND m.start < b.stop)),
held AS (SELECT val, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM apart GROUP BY val),
judged AS (SELECT a.*, owners, repos, owners <= 1 AND repos <= 2 AS live, kind || ':' || start || ':' || stop AS label FROM apart a JOIN held USING (val)),
per AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in secrets.BASE_KINDS)},
         string_agg(label, ',' ORDER BY start, rank, stop) FILTER (rank < {_N}) AS base,
         string_agg(label, ',' ORDER BY start, rank, stop) FILTER (rank < {_N} OR live) AS spans,
         string_agg(owners || ':' || repos, ',' ORDER BY start, rank, stop) FILTER (rank < {_N} OR live) AS held_by,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k.name}, 0)::BIGINT AS n_{k.name}" for k in secrets.BASE_KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(held_by, '') AS held_by, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN per USING (doc_id)"""

_LEAST = lines.MIN_WORDS
OP4_SQL = rf"""
WITH s AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS n FROM s),
l AS (
  SELECT doc_id, line, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw
  FROM a WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (
  SELECT doc_id, n, i,
         list(line) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {_LEAST - 1} FOLLOWING) AS lines,
         list(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {_LEAST - 1} FOLLOWING) AS ns,
         list(nw) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {_LEAST - 1} FOLLOWING) AS nws,
         list(line) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {_LEAST - 1} PRECEDING AND CURRENT ROW) AS lines_b,
         list(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {_LEAST - 1} PRECEDING AND CURRENT ROW) AS ns_b,
         list(nw) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {_LEAST - 1} PRECEDING AND CURRENT ROW) AS nws_b
  FROM l),
runs AS (
  SELECT doc_id, i, lines[1:m] AS lines, ns[1:m] AS ns
  FROM (SELECT *, list_min(list_filter(range(1, len(nws) + 1), lambda k: list_sum(nws[1:k]) >= {_LEAST})) AS m FROM f) WHERE m IS NOT NULL
  UNION ALL
  SELECT doc_id, i - m + 1, lines_b[len(lines_b) - m + 1:], ns_b[len(ns_b) - m + 1:]
  FROM (SELECT *, list_min(list_filter(range(1, len(nws_b) + 1), lambda k: list_sum(nws_b[len(nws_b) - k + 1:]) >= {_LEAST})) AS m FROM f) WHERE m IS NOT NULL),
later AS (SELECT *, rank() OVER (PARTITION BY array_to_string(lines, chr(10)) ORDER BY doc_id, i) AS k FROM runs),
gone AS (SELECT doc_id, list_sort(list_distinct(flatten(list(ns)))) AS removed FROM later WHERE k > 1 GROUP BY doc_id)
SELECT s.doc_id, len(coalesce(removed, []))::BIGINT AS n_removed, array_to_string(coalesce(removed, []), ',') AS removed_lines,
       CASE WHEN removed IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, j: NOT list_contains(removed, j - 1)), chr(10)) END AS text
FROM s LEFT JOIN gone ON s.doc_id = gone.doc_id"""



def _fillers() -> str:
    near = f"NOT picked AND size > 0 AND whole + extra::INTEGER < {mixing.MAX_REPEATS} AND "
    step = """r{k} AS (
  SELECT doc_id, size, source, source_size, target, whole, o, extra, picked OR (near AND place = 1) AS picked, gap - sum(CASE WHEN near AND place = 1 THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap
  FROM (SELECT *, {near} AS near, row_number() OVER (PARTITION BY source, ({near}) ORDER BY abs(size - gap), o, doc_id) AS place FROM r{j}))"""
    fits = lambda k: near + ("abs(size - gap) < gap" if k == mixing.FILLERS else "size <= gap")
    return ",\n".join(step.format(k=k, j=k - 1, near=fits(k)) for k in range(1, mixing.FILLERS + 1))


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5('42:' || doc_id) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY {mixing.MAX_REPEATS}.0 * source_size / w, source NULLS LAST) AS k FROM r),
f AS (
  SELECT *, (sum(source_size) OVER () - {mixing.MAX_REPEATS} * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM o),
l AS (SELECT k, level FROM f WHERE level * w <= {mixing.MAX_REPEATS} * source_size ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN f.k < l.k THEN ({mixing.MAX_REPEATS} * source_size)::DOUBLE ELSE l.level * w END AS target FROM f, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least({mixing.MAX_REPEATS}, floor((target + 1e-6) / source_size)) ELSE 0 END AS whole FROM t),
q AS (SELECT *, greatest(0, target - whole * source_size) AS rest FROM p),
c AS (
  SELECT d.doc_id, d.size, q.source, source_size, target, whole, rest, o, size > 0 AND rest > 0 AND sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id) <= rest AS extra
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
r0 AS (SELECT *, FALSE AS picked, rest - sum(CASE WHEN extra THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM c),
{_fillers()}
SELECT doc_id, size, source_size, target, (CASE WHEN size = 0 THEN 0 ELSE size * (whole + extra::INTEGER + picked::INTEGER) END)::BIGINT AS taken
FROM r{mixing.FILLERS}"""

OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
                      THEN list_transform(embedding, lambda x: x::DOUBLE) END AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND a.e IS NOT NULL AND b.e IS NOT NULL AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
SELECT comp.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, comp.vec_id = component_id AS kept
FROM comp LEFT JOIN n USING (vec_id)"""


_LOWER_WORDS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{tokens.SEPARATOR}'), lambda x: x <> '')"

OP12_SQL = rf"""
WITH d AS (SELECT doc_id, {_LOWER_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_LOWER_WORDS} AS ws FROM benchmark),
k AS (SELECT DISTINCT least(len(ws), {decontam.WINDOW}) AS k FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + k - 1], ' ') AS win
       FROM (SELECT item_id, ws, least(len(ws), {decontam.WINDOW}) AS k, unnest(range(1, len(ws) - least(len(ws), {decontam.WINDOW}) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, k)),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

OP13_SQL = rf"""
WITH d AS (SELECT doc_id, {_LOWER_WORDS} AS ws FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
b AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_LOWER_WORDS}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
g AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)) AS g FROM tf, s),
r AS (SELECT item_id, doc_id, sum(times * w * g)::BIGINT AS score FROM b JOIN w USING (term) JOIN g USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {search.TOP}"""

OP11_SQL = rf"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES}),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND {negatives.NEAR} * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives.NEGATIVES}"""

"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from .licence_rules import signatures

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
STOPS = (
    "the of and to in is that was for with as on are by at be this have from or der die das und ein eine zu den mit ist "
    "nicht von auf sich im des dem la le les de et un une est en que dans par pour pas du el los las y es del se por con para no una"
).split()

OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents
), win AS (
  SELECT r, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS s FROM d, range(1, len(w) - 6) g(i) WHERE len(w) >= 8
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r
), m AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^!]', '', 'g')) AS exclaims,
    len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{s}'" for s in STOPS)}))) AS stops,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), k AS (
  SELECT *, len(lines) AS nl, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS dots FROM m
), f AS (
  SELECT k.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed FROM k LEFT JOIN rep USING (r)
)
SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND chars * 1.0 / n_words BETWEEN 2.5 AND 15 AND n_symbols::DOUBLE / n_words <= 0.1::DOUBLE
  AND exclaims::DOUBLE / n_words <= 0.5 AND stops::DOUBLE / n_words >= 0.05::DOUBLE AND n_dup_lines::DOUBLE / nl <= 0.4::DOUBLE
  AND bullets::DOUBLE / nl <= 0.9::DOUBLE AND dots::DOUBLE / nl <= 0.3::DOUBLE
  AND (n_words < 50 OR n_words::DOUBLE / nl >= 1.5) AS kept
FROM f
"""

OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size FROM documents
), k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, md5(t))), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370497.0::DOUBLE)
    / CASE WHEN length(t) > 0
      THEN greatest(0.1::DOUBLE, 1.0::DOUBLE - 5 * length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::DOUBLE / length(t)) ELSE 0.1::DOUBLE END AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3)::DOUBLE AS w FROM d GROUP BY source
), fill AS (
  -- Reshare until no source is above three times its size.
  SELECT source, source_size, w, false AS capped, 0 AS step FROM s
  UNION ALL
  SELECT source, source_size, w, capped OR level * w > 3 * source_size, step + 1 FROM (
    SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) FILTER (WHERE capped) OVER (), 0))
      / sum(w) FILTER (WHERE NOT capped) OVER () AS level,
    FROM fill
  ) WHERE step < (SELECT count(*) FROM s)
), last AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) FILTER (WHERE capped) OVER (), 0))
    / sum(w) FILTER (WHERE NOT capped) OVER () AS level
  FROM fill WHERE step = (SELECT count(*) FROM s)
), goal AS (
  SELECT source, source_size, CASE WHEN capped THEN 3.0::DOUBLE * source_size ELSE level::DOUBLE * w END AS target FROM last
), plan AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM goal
), run AS (
  SELECT k.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key) - sum(size) OVER (PARTITION BY k.source, key) AS before,
    sum(size) OVER (PARTITION BY k.source, key) AS tied
  FROM k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN rest > 0 AND before + tied / 2 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM run
"""


def _op10() -> str:
    """Every rule is tried on every text: the keyword gate has to lose nothing."""
    table = ", ".join(
        f"({i}, '{s.label}', '{s.keyword}', {s.priority}, '\\b(?:{s.pattern})\\b')" for i, s in enumerate(signatures())
    )
    return rf"""
WITH sig(rule, label, keyword, priority, pattern) AS (VALUES {table}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS joined FROM documents
), w AS (
  SELECT r, doc_id, regexp_replace(joined, '[^\x00-\x7F]', '_', 'g') AS shown,
    CASE WHEN joined = '' THEN [] ELSE string_split(joined, ' ') END AS ws FROM d
), spot AS (
  SELECT r, CASE WHEN ws[i] = 'cc' AND ws[i + 1] = 'by' THEN 'cc-by'
    WHEN ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license' THEN 'gpl'
    WHEN ws[i] = 'all' AND ws[i + 1] = 'rights' AND ws[i + 2] = 'reserved' THEN 'reserved' END AS label, i - 1 AS place
  FROM w, range(1, len(ws) + 1) g(i)
), base AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels
  FROM spot WHERE label IS NOT NULL GROUP BY r
), hit AS (
  SELECT r, rule, label, priority, string_split_regex(shown, pattern) AS gaps, regexp_extract_all(shown, pattern) AS found
  FROM w, sig WHERE regexp_matches(shown, pattern)
), span AS (
  SELECT r, rule, label, priority,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start,
    length(found[i]) AS n FROM hit, range(1, len(found) + 1) g(i)
), live AS (
  SELECT r, label, priority FROM span a WHERE NOT EXISTS (
    SELECT 1 FROM span b WHERE a.r = b.r AND b.start <= a.start AND b.start + b.n >= a.start + a.n AND b.priority >= a.priority
      AND (b.n > a.n OR b.priority > a.priority OR b.rule < a.rule))
), own AS (
  SELECT r, list(DISTINCT label) AS labels, max(priority) AS best FROM live GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
  greatest(coalesce(best, 0) / 100.0::DOUBLE, CASE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN own USING (r)
"""

OP12 = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), met AS (
  SELECT a.n AS an, a.vec_id AS anchor_id, r.n, r.vec_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM v a JOIN v r ON a.n <> r.n AND len(a.q) = len(r.q) WHERE a.vec_id % 100 = 0
), pos AS (
  SELECT an, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY an ORDER BY score DESC, vec_id NULLS LAST, n) AS k FROM met WHERE same QUALIFY k <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY an, k ORDER BY score DESC, vec_id NULLS LAST, n)::INTEGER AS "rank",
  vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN (SELECT an, n, vec_id, score FROM met WHERE NOT same) m USING (an)
WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY "rank" <= 10
"""

# Prefixes as joined digests; the CRC bit by bit.
OP13 = """
WITH own AS (
  SELECT conv_id, list({'h': sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[1:32],
    'b': octet_length(encode(coalesce(text, '')))} ORDER BY turn NULLS FIRST,
    sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT *, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || [1::BIGINT, 1, 1, 1, 1, 1, 1, 1],
      lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 9 AS h
  FROM own
), conv AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM h c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
), pre AS (
  SELECT conv_id, d, d = len(turns) AS ends, list_aggregate(list_transform(turns[1:d], lambda x: x.h), 'string_agg', ',') AS p,
    list_aggregate(list_transform(turns[1:d - 1], lambda x: x.h), 'string_agg', ',') AS up, coalesce(turns[d].b, 0) AS b
  FROM conv, range(0, len(turns) + 1) g(d)
), node AS (
  SELECT d AS depth, CASE WHEN d = 0 THEN '' ELSE p END AS p, CASE WHEN d = 1 THEN '' WHEN d > 1 THEN any_value(up) END AS up, min(conv_id) AS conv_id,
    count(*) AS n_convs, any_value(b) * (count(*) - 1) AS saved, string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS members
  FROM pre GROUP BY 1, 2
), kids AS (
  SELECT up, count(*) AS n FROM node WHERE depth > 0 GROUP BY up
), below AS (
  SELECT a.p, sum(b.saved) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM node a JOIN node b ON b.depth >= a.depth AND (a.depth = 0 OR b.p = a.p OR starts_with(b.p, a.p || ',')) LEFT JOIN kids k ON k.up = b.p GROUP BY a.p
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
  w.leaves::BIGINT AS n_leaves, w.saved::BIGINT AS saved_tokens, sha256(coalesce(n.members, '')) AS ends_sha256
FROM node n JOIN below w ON w.p = n.p LEFT JOIN kids k ON k.up = n.p LEFT JOIN node u ON u.p = n.up
"""

ORACLE = {
    "op1_quality_rules": OP1, "op7_source_mix": OP7, "op10_license_scan": _op10(),
    "op12_hard_negatives": OP12, "op13_conversation_trie": OP13,
}

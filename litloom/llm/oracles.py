"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .blobledger import RULES

#: Words of [^\x20\x09-\x0D]+.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
win AS (
  SELECT doc_id, p, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d, lead(word, 4) OVER o AS e,
    lead(word, 5) OVER o AS f, lead(word, 6) OVER o AS g, lead(word, 7) OVER o AS h, lead(word, 8) OVER o AS i, lead(word, 9) OVER o AS j,
    lead(word, 10) OVER o AS k, lead(word, 11) OVER o AS l
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)
),
seen AS (
  SELECT doc_id, p, word,
    e IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, b, c, d, e) > 1 AS r5,
    h IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, b, c, d, e, f, g, h) > 1 AS r8,
    l IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, b, c, d, e, f, g, h, i, j, k, l) > 1 AS r12
  FROM win
),
cover AS (
  SELECT doc_id, length(word) AS n,
    bool_or(r5) OVER (PARTITION BY doc_id ORDER BY p ROWS 4 PRECEDING) AS c5,
    bool_or(r8) OVER (PARTITION BY doc_id ORDER BY p ROWS 7 PRECEDING) AS c8,
    bool_or(r12) OVER (PARTITION BY doc_id ORDER BY p ROWS 11 PRECEDING) AS c12
  FROM seen
),
spans AS (
  SELECT doc_id, count(*) AS n_words, sum(n) AS word_chars, count(*) FILTER (c5) AS n_repeat_words,
    coalesce(sum(n) FILTER (c5), 0) AS x5, coalesce(sum(n) FILTER (c8), 0) AS x8, coalesce(sum(n) FILTER (c12), 0) AS x12
  FROM cover GROUP BY doc_id
),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
equal AS (
  SELECT doc_id, line, count(*) - 1 AS again, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS n
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line
),
dup AS (SELECT doc_id, sum(again)::BIGINT AS n_dup_lines, sum(again * n) AS x FROM equal GROUP BY doc_id),
base AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, x5, x8, x12, x
  FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN dup USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND x5 / word_chars <= 0.20 AND x8 / word_chars <= 0.16
    AND x12 / word_chars <= 0.12 AND coalesce(x, 0) / word_chars <= 0.30 AS kept
FROM base
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER best = 1 AS kept, text_sha256
FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)
"""


def _op2() -> str:
    """Matches in order and the pieces between them give the starts: the k-th is preceded by k pieces and k - 1 matches."""
    parts, names = [], []
    for k, (name, pattern, group, least) in enumerate(RULES):
        quoted = pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {k} AS rule, '{name}' AS kind, p, m[p] AS hit, list_sum(list_transform(x[:p], lambda s: length(s))) + coalesce(list_sum(list_transform(m[:p - 1], lambda s: length(s))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS p FROM (
    SELECT doc_id, regexp_extract_all(t, '{quoted}') AS m, string_split_regex(t, '{quoted}') AS x FROM d WHERE regexp_matches(t, '{quoted}')))
  WHERE length({f"regexp_extract(m[p], '{quoted}', {group})" if group else "m[p]"}) >= {least}""")
        names.append(name)
    parts[2] = parts[2].replace("[0-9a-f]+", "[0-9a-f]{16,}")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
found AS (
  SELECT doc_id, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || (start + length(hit))::BIGINT, ',' ORDER BY start, rule) FILTER (rule < 3) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || (start + length(hit))::BIGINT, ',' ORDER BY start, rule) AS spans
  FROM hits GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (doc_id)
"""


SQL = {"op2_secret_scan": _op2(), "op4_quality_rules": OP4, "op10_exact_dedup": OP10}

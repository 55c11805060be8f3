"""DuckDB SQL with the results that the llm queries must have."""

#: An escape adds one character for each control string in a role or text. Examples are prefixes up to each assistant turn.
CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, row_number() OVER w - 1 AS k, sum(length(role) + length(text) + 20
    + len(regexp_extract_all(role || chr(10) || text, '[<\[]\\*/?(?:s>|INST\])'))) OVER w AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS formatted_chars,
  CAST(max(upto) AS BIGINT) AS layout_chars, count(*) FILTER (role = 'assistant') AS n_examples
FROM s GROUP BY conv_id
"""

QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents
), x AS (
  SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x) WHERE c > 1
), cover AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM again, range(5) r(k) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words, CAST(list_sum(list_transform(w, lambda y: length(y))) AS BIGINT) AS wc,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ln) - len(list_distinct(ln)) AS n_dup_lines,
    coalesce(n_repeat, 0) AS n_repeat_words, len(ln) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims
  FROM d LEFT JOIN cover USING (doc_id)
), f AS (
  SELECT doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_exclaims,
    CAST(n_words < 10 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS BIGINT) + 4 * CAST(100 * n_symbols > 30 * n_words AS BIGINT)
    + 8 * CAST(100 * n_upper > 50 * coalesce(wc, 0) AS BIGINT) + 16 * CAST(100 * n_exclaims > 30 * n_words AS BIGINT)
    + 32 * CAST(100 * n_dup_lines > 50 * n_lines AS BIGINT) + 64 * CAST(coalesce(wc, 0) > 25 * n_words AS BIGINT) AS failed
  FROM m
)
SELECT *, failed & 3 != 0 AS base_failed, failed = 0 AS kept FROM f
"""

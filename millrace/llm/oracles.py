"""DuckDB equivalents of the corpus queries that SQL can express.

The others (parsing, XXH64, merges, trained models, CRC-checked tokens, look-around patterns, hash order) are held
against brute-force versions in the tests.
"""

from millrace.llm import decontaminate, host_rules

OP3 = rf"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (SELECT doc_id, p, list_slice(w, p, p + {host_rules.WINDOW - 1}) AS g FROM base, unnest(range(1, greatest(len(w) - {host_rules.WINDOW - 2}, 1))) AS r(p)),
twice AS (SELECT doc_id, p FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, range({host_rules.WINDOW}) AS s(k) GROUP BY doc_id),
counted AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN covered AS c USING (doc_id)),
judged AS (SELECT *, n_words < {host_rules.MIN_WORDS} OR 100 * n_repeat_words > {host_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS x FROM judged GROUP BY source),
moments AS (SELECT sum(n) AS n, sum(x) / sum(n) AS m, count(*) AS k, sum(x * x / n) AS q, sum(n * n) AS n2 FROM hosts),
spread AS (SELECT m, m * (1 - m) AS noise, (q - n * m * m - (k - 1) * m * (1 - m)) / nullif(n - n2 / n - (k - 1), 0) AS b FROM moments),
prior AS (SELECT m, CASE WHEN b > 0 THEN greatest({host_rules.PRIOR_MIN}, least({host_rules.PRIOR_MAX}, noise / b - 1)) ELSE {host_rules.PRIOR_MAX} END AS s FROM spread),
verdicts AS (SELECT source, (x + m * s) / (n + s) > least({host_rules.HOST_LIMIT}, m + {host_rules.LIMIT_DEVIATIONS} * sqrt(m * (1 - m) / (s + 1))) AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents), items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) AS m FROM items WHERE len(w) > 0),
patterns AS (SELECT DISTINCT item_id, m, list_slice(w, p, p + m - 1) AS g FROM sized, unnest(range(1, len(w) - m + 2)) AS r(p)),
windows AS (
  SELECT doc_id, p, m, list_slice(w, p, p + m - 1) AS g
  FROM docs, (SELECT DISTINCT m FROM patterns), unnest(range(1, greatest(len(w) - m + 2, 1))) AS r(p)),
hits AS (SELECT doc_id, p, windows.m, item_id FROM windows JOIN patterns USING (g)),
words AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM hits, unnest(range(m)) AS s(k) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""

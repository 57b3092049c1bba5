"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

#: Words are runs of anything but these six characters; the rules' limits are those of quality.py.
OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
c AS (SELECT k, doc_id, source, words, len(words)::BIGINT AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM w),
win AS (SELECT k, i, hash(array_to_string(words[i:i+7], ' ')) AS h, array_to_string(words[i:i+7], ' ') AS s
  FROM (SELECT k, words, unnest(range(1, n_words - 6)) AS i FROM c WHERE n_words >= 8)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, h, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT k, sum(least(8, coalesce(lead_i - i, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS lead_i FROM rep) GROUP BY k),
f AS (SELECT c.doc_id, c.source, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM c LEFT JOIN cov USING (k)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 5 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS soft_failed FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR soft_failed) AS x FROM g GROUP BY source),
m AS (SELECT sum(x) / sum(n) AS m, coalesce(var_samp(x / n), 0) AS v, avg(1 / n) AS noise FROM h),
p AS (SELECT m, greatest(1, least(1000, CASE WHEN v - m * (1 - m) * noise > 0 THEN m * (1 - m) / (v - m * (1 - m) * noise) - 1 ELSE 1000 END)) AS s FROM m),
b AS (SELECT source, (x + m * s) / (n + s) AS shrunk_rate FROM h, p)
SELECT g.doc_id, n_symbols, word_chars, n_words, n_dup_lines, n_repeat_words, base_failed, soft_failed, shrunk_rate, shrunk_rate > 0.5 AS bad_host,
  NOT base_failed AND NOT (shrunk_rate > 0.5 AND soft_failed) AS kept
FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source
"""

OP4 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
r AS (SELECT doc_id, s, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY s) AS group_size
  FROM t WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(s) AS text_sha256 FROM r
"""


OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS n, sha1(html) AS h FROM p),
e AS (SELECT h, max(page_id) AS elected FROM d WHERE n >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, d.h AS payload_digest,
  CASE WHEN elected IS NULL OR elected = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN elected <> page_id THEN elected END AS refers_to
FROM d LEFT JOIN e ON d.h = e.h AND n >= 1000
"""


def corpus_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op4_exact_dedup": OP4, "op7_warc": OP7}

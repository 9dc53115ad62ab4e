"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from lattica.llm import mixing

OP3 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), k AS (
  SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest
"""

_SPACE = 1 << mixing.POINT_BITS
_EPOCHS = " + ".join(
    f"greatest(0, least(start + {e} * source_size + size, top) - start - {e} * source_size)" for e in range(mixing.MAX_REPEATS)
)

OP5 = rf"""
WITH s AS (
  SELECT doc_id, source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s GROUP BY source
), w AS (
  SELECT *, ([5e0, 2e0, 1e0])[sid % 3 + 1] AS weight, source_size * 3e0 AS cap FROM per
), lv AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, least(weight * (SELECT level FROM lv WHERE level * weight <= cap ORDER BY cap / weight, sid LIMIT 1), cap) AS target FROM lv
), hi AS (
  SELECT sid, CASE WHEN sid = max(sid) OVER () THEN {_SPACE}
    ELSE floor(sum(target) OVER (ORDER BY sid) / sum(target) OVER () * {_SPACE}) END::BIGINT AS hi
  FROM t WHERE target > 0
), cut AS (
  SELECT sid, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo, hi FROM hi
), point AS (
  SELECT (i::HUGEINT * {mixing.GOLDEN} % {_SPACE})::BIGINT AS p
  FROM (SELECT unnest(range(0, (SELECT ceil(sum(size) / {mixing.BLOCK})::BIGINT FROM s))) AS i)
), slot AS (
  SELECT sid, count(*) AS k FROM point JOIN cut ON p >= lo AND p < hi GROUP BY sid
), line AS (
  SELECT doc_id, size, source_size, target,
    least(coalesce(k, 0) * {mixing.BLOCK}, source_size * {mixing.MAX_REPEATS}) AS top,
    coalesce(sum(size) OVER (PARTITION BY t.sid
      ORDER BY ('0x' || substr(md5(concat_ws(':', {mixing.SEED}, doc_id)), 1, {mixing.HASH_DIGITS}))::BIGINT, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN slot ON slot.sid = t.sid
)
SELECT doc_id, size, source_size, target, ({_EPOCHS})::BIGINT AS taken FROM line
"""

OP6 = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)
), dup AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win
  ) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, i + d AS j FROM dup, range(20) AS t(d)
), word AS (
  SELECT doc_id, unnest(words) AS x, generate_subscripts(words, 1) AS j FROM w
), kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.j) AS text, count(*) AS n
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.j = gone.j
  GROUP BY word.doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

# For pages as these tables have them: one article of h1 and p elements, with inline b and br only.
OP8 = r"""
WITH a AS (
  SELECT page_id, url,
    regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:h1|p)>') AS parts
  FROM pages
), b AS (
  SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(
    regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS parts
  FROM a
), c AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS parts
  FROM b
), d AS (
  SELECT page_id, url, coalesce(array_to_string(parts, chr(10)), '') AS text FROM c
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""

ORACLES = {"op3_warc": OP3, "op5_mixing": OP5, "op6_substring_dedup": OP6, "op8_html_text": OP8}

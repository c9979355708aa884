"""DuckDB statements for the text queries that SQL can express, over the same tables."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = r"coalesce(regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP1 = rf"""
WITH item AS (
  SELECT item_id, {_ITEM_WORDS.format(_LOWER.format("text"))} AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS win
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i)
  WHERE len(w) > 0
), doc AS (
  SELECT doc_id, {_ITEM_WORDS.format(_LOWER.format("text"))} AS w FROM documents
), doc_window AS (
  SELECT doc_id, s.size, i, array_to_string(w[i:i + s.size - 1], ' ') AS win
  FROM doc, (SELECT DISTINCT size FROM item_window) AS s, unnest(range(1, len(w) - s.size + 2)) AS t(i)
), hit AS (
  SELECT doc_id, i, d.size, item_id FROM doc_window AS d JOIN item_window AS b USING (size, win)
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP2 = r"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS five
  FROM doc, unnest(range(1, len(w) - 3)) AS t(i)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
), line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM doc
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n, count(*) AS n_lines FROM line
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, length(text) AS chars,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS upper_chars,
         length(regexp_replace(text, '[\p{L}\p{M}\s\x0B]', '', 'g')) AS other_chars
  FROM doc LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 4 * chars
            OR 100 * upper_chars > 45 * chars OR 100 * other_chars > 55 * chars
            OR chars > 26 * n_words OR 100 * n_dup_lines > 60 * n_lines) AS kept
FROM base
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v[{k}] >> {shift} & 31)::INT + 1, 1)"
    for k in range(1, 9)
    for shift in (15, 10, 5, 0)
)

OP3 = f"""
WITH page AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS h FROM pages
), digest AS (
  SELECT page_id, octet_length(payload) AS n, h,
         list_transform(range(8), lambda k: ('0x' || substr(h, 5 * k + 1, 5))::BIGINT) AS v
  FROM page
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS response FROM digest
)
SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM grouped
"""

_RULES = (
    ("www.example.com", "/en/", "allow"),
    ("example.com", "/en/", "block"),
    ("com", "/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"

OP5 = rf"""
WITH part AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), page AS (
  SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM part
), listed AS (
  SELECT DISTINCT host FROM page WHERE substr(md5(page_id::VARCHAR), 1, 1) IN ('0', '1') AND host <> ''
), ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for h, p, _ in _RULES)} END AS rule
  FROM page
)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in _RULES)}
            WHEN listed.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN listed USING (host)
"""

OP12 = r"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL
  SELECT -1, t, ['user', 'assistant'][t + 1], '<|im_end|><|im_start|>assistant ok' FROM range(2) AS r(t)
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         coalesce(role = 'assistant', false) AS reply
  FROM said
), shown AS (
  SELECT *, length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g'))
         + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_start|><|im_end|>') + 2 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN reply THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN reply THEN text END, '' ORDER BY turn NULLS FIRST, role, text), ''))
         AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, count_if(reply)::BIGINT AS n_examples
FROM shown GROUP BY conv_id
"""

ORACLES: dict[str, str] = {
    "op1_decontamination": OP1,
    "op2_quality_rules": OP2,
    "op3_warc": OP3,
    "op5_url_filter": OP5,
    "op12_chat_format": OP12,
}

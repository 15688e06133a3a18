"""DuckDB SQL for the queries that SQL expresses."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i WHERE 100 * k >= 85 * (na + nb - k)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, coalesce(l.k, 0)::BIGINT AS n_links
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON s.doc_id = c.doc_id
LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY a) l ON s.doc_id = l.a
""".replace("{u}", UPPER).replace("{l}", LOWER)

OP5 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p + 1:p + least(10, len(w))], ' ') AS g
  FROM b, unnest(range(0, greatest(1, len(w) - 9))) t(p) WHERE len(w) > 0),
grams AS (
  SELECT rid, n, p, array_to_string(w[p + 1:p + n], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM wins), unnest(range(0, greatest(0, len(w) - n + 1))) t(p)),
met AS (SELECT g.rid, g.p, g.n, w.item_id FROM grams g JOIN wins w ON g.n = w.n AND g.g = w.g),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM met) GROUP BY rid),
its AS (SELECT rid, list_sort(list(DISTINCT coalesce(item_id::VARCHAR, 'null'))) AS items FROM met GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
""".replace("{u}", UPPER).replace("{l}", LOWER)

OP6 = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
s AS (
  SELECT conv_id, turn, role, text,
    length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;')) + 24 AS chars
  FROM rows),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text) AS form,
    sum(chars) AS chars
  FROM s GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(learned)::BIGINT AS loss_chars,
  sha256(learned) AS loss_sha256, chars::BIGINT AS formatted_chars, regexp_full_match(form, 's?(ua)+') AS valid
FROM c
"""

# CRC-32 (the reflected polynomial 0xEDB88320), a byte at a time, and draws as 13 hexadecimal digits of md5.
OP7 = """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, row_number() OVER () AS rid FROM documents),
x AS (SELECT rid, doc_id, octet_length(b) + 8 AS size, hex(b) AS h FROM d),
s AS (SELECT rid, doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 8), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, y: xor(c >> 8, t.t[(xor(c, y) & 255) + 1])), 4294967295) AS crc FROM x, t),
w AS (SELECT rid, k, ('0x' || md5(coalesce('k' || doc_id, 'null') || '/' || k)[:13])::BIGINT AS draw FROM s, range(25) r(k)),
p AS (SELECT rid, arg_max(k, draw * 32 + k) FILTER (k < 24) AS shard, arg_max(k, draw * 32 + k) AS grown FROM w GROUP BY rid)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce('k' || doc_id, 'null') || ':k' || size || ':k' || crc), doc_id, size, crc) - 1 AS slot,
  grown::INTEGER AS grown_shard
FROM s JOIN p USING (rid)
"""


def oracles() -> dict[str, str]:
    return {
        "op3_top_k_search": OP3,
        "op4_ngram_jaccard_join": OP4,
        "op5_benchmark_decontamination": OP5,
        "op6_chat_formatting": OP6,
        "op7_sharding": OP7,
    }

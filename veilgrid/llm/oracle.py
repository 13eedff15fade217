"""DuckDB SQL of the operators' queries that SQL can express, all pairs and all words, without the operators' shortcuts."""

from __future__ import annotations

_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

OP7 = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}
), p AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (SELECT vec_id AS s, vec_id AS t FROM embeddings UNION SELECT r.s, p.y FROM r JOIN p ON p.x = r.t
), c AS (SELECT s, min(t) AS component_id FROM r GROUP BY s
), n AS (SELECT x, count(*) AS k FROM p GROUP BY x)
SELECT vec_id, coalesce(k, 0) AS n_links, component_id, component_id = vec_id AS kept FROM embeddings JOIN c ON s = vec_id LEFT JOIN n ON x = vec_id"""

def _crc_words() -> list[int]:
    """What each bit of a byte does to a CRC-32; a byte's effect is the exclusive or of its bits'."""
    out = []
    for bit in range(8):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, byte by byte."""
    step = "(c >> 8)"
    for bit, word in enumerate(_crc_words()):
        step = f"xor({step}, ((xor(c, b) >> {bit}) & 1) * {word}::BIGINT)"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {step}), 4294967295::BIGINT)"


OP6 = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 16 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents
), k AS (SELECT *, CAST('0x' || substring(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text_crc32), 1, 15) AS BIGINT) AS k FROM d
), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, text_crc32) AS i, count(*) OVER (PARTITION BY source) AS m, count(*) OVER () AS n FROM k
), p AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * i - 1 AS DOUBLE) / (2 * m), source NULLS FIRST, k, doc_id NULLS FIRST, text_crc32) - 1 AS pos FROM r
), s AS (SELECT *, pos * 40 // n AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, pos - (shard * n + 39) // 40 AS slot, NULL::INT AS grown_shard, source FROM s"""

# base32 takes five hexadecimal digits to four letters
OP8 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS last FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substring(x, 5 * (i // 4) + 1, 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM m"""

OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w
), u AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.y FROM r JOIN p ON p.x = r.b
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(sh) AS n_shingles, component_id FROM s JOIN c ON a = doc_id"""

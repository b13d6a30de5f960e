"""SQL for the queries whose whole results SQL can tell: each from the tables alone, by the plainest way."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
d AS (SELECT *, strlen(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
e AS (SELECT *, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest FROM d),
f AS (SELECT payload_digest, min(page_id) AS first FROM e GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to, coalesce(url, '') AS url
FROM e JOIN f USING (payload_digest)"""

#: Smallest name reachable from each, over pairs a, b of a CTE called links; names are those of a CTE called nodes.
REACH = """
reach AS (SELECT id, id AS root FROM nodes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE r.root < l.b),
component AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END) AS s FROM w),
n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
nodes AS (SELECT doc_id AS id FROM n),{REACH}
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN component ON id = doc_id"""

SHARDING = """
WITH RECURSIVE grown AS (
  SELECT range::INT AS vslot, 0 AS shard, 1 AS n FROM range(4096)
  UNION ALL SELECT vslot, CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY md5(vslot::VARCHAR)) <= count(*) OVER (PARTITION BY shard) // (n + 1) THEN n ELSE shard END, n + 1 FROM grown WHERE n < 17),
bits AS (SELECT range AS b, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, range) AS c FROM range(256)),
crcs AS (SELECT list(c ORDER BY b) AS t FROM bits),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) + 1 AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % 4096 AS vslot FROM documents),
e AS (SELECT doc_id, size, vslot, xor(list_reduce([('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(size - 1)], lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, crcs),
f AS (SELECT e.*, a.shard, b.shard AS grown_shard FROM e JOIN grown a ON a.vslot = e.vslot AND a.n = 16 JOIN grown b ON b.vslot = e.vslot AND b.n = 17)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY vslot, doc_id NULLS LAST, text_crc32, size) - 1 AS slot, grown_shard, vslot::INT AS vslot, sum(size) OVER (PARTITION BY vslot)::BIGINT AS slot_bytes FROM f"""

NEAR = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS len FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len([i FOR i IN x IF i IS NULL OR isnan(i) OR isinf(i)]) = 0 AND len([i FOR i IN x IF i <> 0]) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) >= 0.95 * a.len * b.len),
nodes AS (SELECT vec_id AS id FROM v),{REACH}
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN component ON id = v.vec_id"""

SQL = {"op3_warc": WARC, "op6_jaccard": JACCARD, "op8_sharding": SHARDING, "op10_near_vectors": NEAR}

"""DuckDB SQL for the queries that SQL can express, each by the plainest way."""

from __future__ import annotations

from lodestar.llm.mixing import BLOCK_WORDS, DOCS_PER_SHARD, MAX_REPEATS, SEED

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce({_LOWER}, ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _seats(parties: str, group: str, key: str, votes: str, seats: str) -> str:
    """Highest quotients, each of them ranked."""
    return f"""SELECT {group} g, {key} k, count(*) won FROM (
      SELECT {group}, {key}, row_number() OVER (PARTITION BY {group} ORDER BY q DESC, {key}, n) r, {seats} s FROM (
        SELECT *, {votes} / (2 * n + 1) q FROM (SELECT *, unnest(range(0, CAST({seats} AS BIGINT))) n FROM {parties} WHERE {votes} > 0))) WHERE r <= s GROUP BY ALL"""


MIXING = rf"""
WITH sizes AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) size FROM documents),
src AS (SELECT source, sum(size) source_size, count(*) n_docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 place FROM sizes GROUP BY source),
cap AS (SELECT *, CAST(1 + place % 3 AS DOUBLE) weight, CAST({MAX_REPEATS} * source_size AS DOUBLE) cap, CAST(sum(source_size) OVER () AS DOUBLE) total FROM src),
room AS (SELECT *, cap / weight room FROM cap),
lev AS (SELECT *, (total - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) lev FROM room WINDOW w AS (ORDER BY room, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
one AS (SELECT arg_min(lev, room * 1e6 + place) level FROM lev WHERE lev <= room),
tgt AS (SELECT room.*, least(cap, coalesce(weight * level, cap)) target, floor(total / {BLOCK_WORDS} + 0.5) all_seats, 1 + n_docs // {DOCS_PER_SHARD} n_shards, 0 one FROM room, one),
won AS ({_seats("tgt", "one", "place", "target", "all_seats")}),
line AS (SELECT s.*, place, source_size, target, coalesce(won, 0) seats, md5('{SEED}/' || doc_id || '/' || size) ord, n_shards FROM sizes s JOIN tgt ON s.source IS NOT DISTINCT FROM tgt.source LEFT JOIN won ON won.k = place),
laid AS (SELECT *, CAST('0x' || substr(ord, 1, 8) AS BIGINT) % n_shards shard FROM line),
sh AS (SELECT place, shard, CAST(sum(size) AS DOUBLE) shard_size, max(seats) seats FROM laid GROUP BY ALL),
shw AS ({_seats("sh", "place", "shard", "shard_size", "seats")}),
q AS (SELECT laid.*, CAST(shard_size AS BIGINT) shard_size, coalesce(won, 0) * {BLOCK_WORDS} quota,
  coalesce(sum(size) OVER (PARTITION BY laid.place, laid.shard ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before
  FROM laid JOIN sh USING (place, shard) LEFT JOIN shw ON shw.g = laid.place AND shw.k = laid.shard)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(CASE WHEN shard_size = 0 THEN 0 ELSE least({MAX_REPEATS} * size, (quota // shard_size) * size + least(size, greatest(0, quota % shard_size - before))) END AS BIGINT) AS taken FROM q
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_WORDS} w FROM documents), b AS (SELECT item_id, w, least(10, len(w)) m FROM (SELECT item_id, {_WORDS} w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') k FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) i FROM b)),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) i FROM d, (SELECT DISTINCT m FROM bw))),
h AS (SELECT doc_id, i, m, k FROM dw SEMI JOIN bw USING (m, k)),
hit AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) s FROM (SELECT DISTINCT doc_id, item_id FROM h JOIN bw USING (m, k)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

LINE_DEDUP = r"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) s FROM documents),
l AS (SELECT doc_id, p, trim(line, ' ' || chr(9) || chr(13)) l FROM (SELECT doc_id, unnest(range(len(s))) p, unnest(s) line FROM s)),
j AS (SELECT *, len(l) - len(replace(l, ' ', '')) + 1 n, doc_id * 10000000 + p o FROM l WHERE l <> ''),
d AS (SELECT l, n, min(o) o FROM j GROUP BY l, n),
v AS (SELECT l, n, o, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:n]), ' ') k FROM (SELECT l, n, o, string_split(l, ' ') w, unnest(range(1, n + 1)) i FROM d WHERE n >= 10)),
near AS (
  SELECT l FROM (SELECT l, o, min(o) OVER (PARTITION BY n, i, k) m FROM v) WHERE m < o
  UNION SELECT CASE WHEN d.o < v.o THEN v.l ELSE d.l END FROM v JOIN d ON v.k = d.l WHERE d.n = v.n - 1 AND d.n >= 10),
gone AS (SELECT doc_id, list(p) ps FROM j JOIN d USING (l, n) WHERE j.o <> d.o OR l IN (SELECT l FROM near) GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_lines, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
CASE WHEN ps IS NULL THEN text ELSE array_to_string(list_filter(s, lambda x, i: NOT list_contains(ps, i - 1)), chr(10)) END AS text FROM s LEFT JOIN gone USING (doc_id)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, v.vec_id vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages), m AS (SELECT *, sha1(h) d, max(page_id) OVER (PARTITION BY h) last FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(d, i // 4 * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM m
"""

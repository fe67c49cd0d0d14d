"""SQL twins of the corpus queries that SQL can express."""

from __future__ import annotations


def _field(column: str, value: str | None = None) -> str:
    value = value or f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


_FIELDS = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC_STEP = "xor(crc >> 1, 3988292384 * (crc & 1))"
_CRC = (
    "xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),"
    f" lambda c, b: list_reduce(range(8), lambda crc, bit: {_CRC_STEP}, xor(c, b)), 4294967295), 4294967295)"
)

OP12_MERKLE_MANIFEST = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, sha256({_FIELDS} || {_field("text")}) AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN sha256({_FIELDS} || {_field("text", _LOWERED)}) END AS bent
  FROM documents
), leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, leaf, coalesce(bent, leaf) AS bent,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM hashed
), nodes(tree, lv, idx, n, h) AS (
  SELECT tree, 0, idx, n, leaf FROM leaves
  UNION ALL
  SELECT tree, lv + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, lv, idx // 16, n
), subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(lv, idx, n, h) AS (
  SELECT 0, idx, n, h FROM subroots
  UNION ALL
  SELECT lv + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lv, idx // 16, n
), runs AS (
  SELECT tree, lv, idx // 16 AS up, list(h ORDER BY idx) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
), top_runs AS (
  SELECT lv, idx // 16 AS up, list(h ORDER BY idx) AS hs FROM tops WHERE n > 1 GROUP BY ALL
), inside(doc_id, tree, leaf, first, lv, pos, n, siblings, cur) AS (
  SELECT doc_id, tree, leaf, idx, 0, idx, n, '', bent FROM leaves
  UNION ALL
  SELECT i.doc_id, i.tree, i.leaf, i.first, i.lv + 1, i.pos // 16, (i.n + 15) // 16,
    i.siblings || array_to_string(r.hs[:i.pos % 16], '') || array_to_string(r.hs[i.pos % 16 + 2:], ''),
    sha256(array_to_string(r.hs[:i.pos % 16], '') || i.cur || array_to_string(r.hs[i.pos % 16 + 2:], ''))
  FROM inside i JOIN runs r ON r.tree = i.tree AND r.lv = i.lv AND r.up = i.pos // 16 WHERE i.n > 1
), across(doc_id, leaf, tree, first, lv, pos, n, siblings, cur, subroot) AS (
  SELECT i.doc_id, i.leaf, i.tree, i.first, 0, s.idx, s.n, i.siblings, i.cur, s.h FROM inside i JOIN subroots s ON s.tree = i.tree WHERE i.n = 1
  UNION ALL
  SELECT a.doc_id, a.leaf, a.tree, a.first, a.lv + 1, a.pos // 16, (a.n + 15) // 16,
    a.siblings || array_to_string(r.hs[:a.pos % 16], '') || array_to_string(r.hs[a.pos % 16 + 2:], ''),
    sha256(array_to_string(r.hs[:a.pos % 16], '') || a.cur || array_to_string(r.hs[a.pos % 16 + 2:], '')), a.subroot
  FROM across a JOIN top_runs r ON r.lv = a.lv AND r.up = a.pos // 16 WHERE a.n > 1
)
SELECT a.doc_id, a.leaf, a.subroot, t.h AS root, sha256(a.siblings) AS proof_sha256, a.cur AS folded_root, a.cur = t.h AS verified
FROM across a JOIN tops t ON t.n = 1 WHERE a.n = 1
"""


def _nearest(round_: int) -> str:
    """Number and squared distance of the nearest centroid of each vector."""
    squares = "list_sum(list_transform(list_zip(v.pos, c.pos), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return (
        f"near{round_} AS (SELECT who, id, any_value(pos) AS pos, min({{'d': d, 'c': num}}) AS best FROM ("
        f"SELECT v.who, v.id, v.pos, c.num, CAST({squares} AS BIGINT) AS d FROM grid v CROSS JOIN c{round_} c) GROUP BY who, id)"
    )


def _moved(round_: int) -> str:
    """Centroids after the round: exact floors of the means; those without vectors stay."""
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    return (
        f"c{round_ + 1} AS (SELECT c.num, coalesce(m.pos, c.pos) AS pos FROM c{round_} c LEFT JOIN ("
        f"SELECT num, list({floor} ORDER BY i) AS pos FROM ("
        f"SELECT best.c AS num, i, sum(pos[i]) AS s, count(*) AS n FROM near{round_}, range(1, 65) t(i) GROUP BY best.c, i"
        f") GROUP BY num) m ON m.num = c.num)"
    )


_ROUNDS = ", ".join(f"{_nearest(r)}, {_moved(r)}" for r in range(3))
OP13_ORCHARD = f"""
WITH grid AS (
  SELECT row_number() OVER () AS who, vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS pos
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY h, pos) - 1 AS num, pos
  FROM (SELECT sha256('1:' || coalesce(CAST(id AS VARCHAR), '')) AS h, pos FROM grid ORDER BY h, pos LIMIT 16)
), {_ROUNDS}, {_nearest(3)}, sums AS (SELECT best.c AS num, CAST(sum(best.d) AS BIGINT) AS own FROM near3 GROUP BY ALL)
SELECT n.id AS vec_id, CAST(n.best.c AS INTEGER) AS cluster, n.best.d AS distance, s.own AS cluster_inertia,
  (SELECT CAST(sum(own) AS BIGINT) FROM sums) AS inertia, sha256(array_to_string(c.pos, ',')) AS centroid_sha256
FROM near3 n JOIN sums s ON s.num = n.best.c JOIN c3 c ON c.num = n.best.c
"""

"""SQL for the operators on pairs, over whole tables; quadratic in places and meant for small tables only."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingles(table: str, key: str, k: int) -> str:
    """``(rid, key, n, sh)``: each row's distinct shingles; rid tells rows with equal keys apart."""
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    cut = f"CASE WHEN len(ws) >= {k} THEN list_distinct(list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i : i + {k - 1}], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END"
    return f"SELECT rid, {key}, len(l) AS n, l FROM (SELECT rid, {key}, {cut} AS l FROM (SELECT row_number() OVER () AS rid, {key}, {words} AS ws FROM {table}))"


def components(nodes: str, key: str) -> str:
    """Recursive reach over ``links(a, b)`` given both ways, from every row of ``nodes``: ``roots(rid, root)``."""
    return f"reach(rid, other) AS (SELECT rid, rid FROM {nodes} UNION SELECT r.rid, l.b FROM reach r JOIN links l ON l.a = r.other), roots AS (SELECT r.rid, min(n.{key}) AS root FROM reach r JOIN {nodes} n ON n.rid = r.other GROUP BY r.rid)"


OP4_SQL = f"""
WITH RECURSIVE d AS ({shingles("documents", "doc_id", 3)}), s AS (SELECT rid, n, unnest(l) AS sh FROM d),
links AS (SELECT a.rid AS a, b.rid AS b FROM s a JOIN s b ON a.sh = b.sh AND a.rid <> b.rid AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
          GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
{components("d", "doc_id")}
SELECT d.doc_id, d.n::BIGINT AS n_shingles, r.root AS component_id FROM d JOIN roots r USING (rid)
"""

OP9_SQL = f"""
WITH i AS ({shingles("benchmark", "item_id", 5)}), d AS ({shingles("documents", "doc_id", 5)}),
si AS (SELECT rid, item_id, n, unnest(l) AS sh FROM i), sd AS (SELECT rid, doc_id, unnest(l) AS sh FROM d)
SELECT sd.doc_id, si.item_id, si.n::BIGINT AS n_shingles, count(*)::BIGINT AS n_found, count(*) / si.n AS containment
FROM sd JOIN si USING (sh) GROUP BY sd.rid, sd.doc_id, si.rid, si.item_id, si.n HAVING count(*) >= 0.8 * si.n - 1e-9
"""

OP10_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.rid AS a, b.rid AS b FROM g a JOIN g b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93e0),
{components("v", "vec_id")},
c AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, r.root AS component_id, v.vec_id = r.root AS kept FROM v JOIN roots r USING (rid) LEFT JOIN c USING (rid)
"""

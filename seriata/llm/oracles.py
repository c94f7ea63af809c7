"""DuckDB SQL for the queries that SQL can express."""

_WHITE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP9 = f"""
WITH l AS (
  SELECT doc_id, i, x AS line, translate(trim(x, {_WHITE}), '{_UP}', '{_LOW}') AS key FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
k AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT l.*, k.first_doc IS NOT NULL AND l.doc_id > k.first_doc AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"

#: Every window between the first and the last shared shingle, by exact similarity; an item of fewer than five words is one shingle.
OP5 = f"""
WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bk AS (SELECT item_id, w, least(len(w), 5) AS k, len(w) - least(len(w), 5) + 1 AS l FROM b WHERE len(w) > 0),
ds AS (SELECT doc_id, w, k, len(w) - k + 1 AS n, i, array_to_string(w[i + 1 : i + k], ' ') AS s FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bk) WHERE len(w) >= k)),
bs AS (SELECT item_id, w AS v, k, l, array_to_string(w[o + 1 : o + k], ' ') AS s FROM (SELECT *, unnest(range(0, l)) AS o FROM bk)),
hit AS (SELECT doc_id, w, item_id, v, k, l, any_value(n) AS n, min(i) AS lo, max(i) AS hi FROM ds JOIN (SELECT DISTINCT * FROM bs) USING (k, s)
        GROUP BY ALL HAVING count(DISTINCT i) >= (least(l, any_value(n)) + l) * 0.8 / 1.8 - 0.000001),
st AS (SELECT *, unnest(range(greatest(0, lo - l + 1), greatest(0, least(hi, n - l)) + 1)) AS st FROM hit),
a AS (SELECT doc_id, w, item_id, v, st, ds.s, count(*) AS n FROM st JOIN ds USING (doc_id, w, k) WHERE ds.i >= st AND ds.i < st + l GROUP BY ALL),
c AS (SELECT doc_id, w, item_id, v, st, bs.s, count(*) AS n FROM st JOIN bs USING (item_id, v) GROUP BY ALL),
j AS (SELECT coalesce(a.doc_id, c.doc_id) AS doc_id, coalesce(a.item_id, c.item_id) AS item_id, coalesce(a.st, c.st) AS st,
             sum(least(coalesce(a.n, 0), coalesce(c.n, 0))) / sum(greatest(coalesce(a.n, 0), coalesce(c.n, 0))) AS sim
      FROM a FULL JOIN c ON a.doc_id = c.doc_id AND a.w = c.w AND a.item_id = c.item_id AND a.v = c.v AND a.st = c.st AND a.s = c.s GROUP BY 1, 2, 3, coalesce(a.w, c.w), coalesce(a.v, c.v))
SELECT doc_id, item_id, CAST(arg_min(st, struct_pack(x := -sim, y := st)) AS BIGINT) AS start, CAST(max(sim) AS DOUBLE) AS similarity
FROM j WHERE sim >= 0.8 GROUP BY doc_id, item_id
"""

#: All pairs that share a shingle, by exact counts, and what they reach.
OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.seen)
SELECT node AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(seen) AS component_id FROM r LEFT JOIN n ON n.doc_id = node GROUP BY node
"""

ORACLES = {"op1_jaccard_join": OP1, "op5_decontaminate": OP5, "op9_line_dedup": OP9}

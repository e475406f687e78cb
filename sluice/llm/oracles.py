"""DuckDB SQL of those queries that SQL can express exactly."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
 b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
 place AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0),
 win AS (SELECT DISTINCT item_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM place),
 sizes AS (SELECT DISTINCT n FROM win),
 dw AS (SELECT doc_id, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS i, w FROM d, sizes WHERE len(w) >= n),
 found AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw),
 met AS (SELECT f.doc_id, f.i, f.n, x.item_id, x.k FROM found f JOIN win x ON f.n = x.n AND f.s = x.s),
 hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY 1),
 its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM met GROUP BY 1),
 run AS (SELECT doc_id, item_id, i, n, i - k AS shift, i - row_number() OVER (PARTITION BY doc_id, item_id, i - k ORDER BY i) AS island FROM met),
 lon AS (SELECT doc_id, count(*) AS n_matches, max(size) AS longest_match FROM (SELECT doc_id, max(i) - min(i) + max(n) AS size FROM run GROUP BY doc_id, item_id, shift, island) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
 coalesce(n_matches, 0) AS n_matches, coalesce(longest_match, 0) AS longest_match
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id LEFT JOIN lon ON d.doc_id = lon.doc_id
"""

EMBEDDING_LINKS = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id <> b.vec_id
   WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.9e0),
 r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.v FROM r JOIN l ON r.b = l.u),
 c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT u, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON vec_id = a LEFT JOIN n ON vec_id = u
"""

NGRAM_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACED} AS w FROM documents),
 g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
 s AS (SELECT doc_id, unnest(g) AS s FROM g),
 k AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 p AS (SELECT u, v FROM k JOIN g a ON a.doc_id = u JOIN g b ON b.doc_id = v WHERE 100 * k >= 85 * (len(a.g) + len(b.g) - k)),
 l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
 r AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, l.v FROM r JOIN l ON r.b = l.u),
 c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM g JOIN c ON doc_id = a
"""

_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 h AS (SELECT page_id, html, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(list_transform(range(8), lambda i: CAST('0x' || substr(x, 5 * i + 1, 5) AS INTEGER)), lambda v: {_DIGITS}), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h
"""

_HAND_OVER = "list_reduce(list_prepend({start}, {steps}), lambda c, b: {step})"
_CRC_TABLE = "list_transform(range(256), lambda x: " + _HAND_OVER.format(start="x", steps="range(8)", step="CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END") + ")"
_CRC = "xor(" + _HAND_OVER.format(start="4294967295", steps="bytes", step="xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])") + ", 4294967295)"

SPELLING_VARIANTS = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
 each_run AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY 1, 2),
 coded AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)) AS bytes FROM each_run),
 summed AS (SELECT run, n, {_CRC} AS h FROM coded, (SELECT {_CRC_TABLE} AS crc_table)),
 changed AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
 w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
 del AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
 pairs AS (SELECT a.word AS u, b.word AS v FROM del a JOIN del b ON a.x = b.x AND a.i = b.i AND a.word <> b.word UNION SELECT word, x FROM del SEMI JOIN w ON x = w.word UNION SELECT x, del.word FROM del SEMI JOIN w ON x = w.word),
 ranked AS (SELECT u, v, b.n AS form_n, count(*) OVER (PARTITION BY u) AS n_near, row_number() OVER (PARTITION BY u ORDER BY b.n DESC, v) AS k FROM pairs JOIN w b ON b.word = v),
 f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN v END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM w LEFT JOIN ranked ON u = w.word AND k = 1),
 walk AS (SELECT word, word AS place FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.place = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.place AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word JOIN f l ON l.word = walk.place AND l.form IS NULL
"""


def _nearest(k: int) -> str:
    off = "list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)"
    return f"a{k} AS (SELECT rid, p, any_value(x) AS x, min({{'d': {off}, 'e': e}}) AS best FROM part JOIN b{k} USING (p) GROUP BY rid, p)"


def _means(k: int) -> str:
    places = f"(SELECT p, best.e AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{k})"
    return f"""s{k} AS (SELECT p, e, list(y ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(y) / count(*)) AS y FROM {places} GROUP BY ALL) GROUP BY ALL),
 b{k + 1} AS (SELECT p, e, coalesce(s{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN s{k} USING (p, e))"""


# integers below 2^53 are exact in doubles
VECTOR_CODES = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS q FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 part AS MATERIALIZED (SELECT rid, p, q[p * len(q) // 8 + 1:(p + 1) * len(q) // 8] AS x FROM k, (SELECT unnest(range(8)) AS p)),
 b0 AS MATERIALIZED (SELECT p, rid AS e, x AS c FROM part WHERE rid < 16),
 {", ".join(f"{_nearest(r)}, {_means(r)}" for r in range(6))}, {_nearest(6)},
 done AS (SELECT rid, CAST(sum(best.d) AS BIGINT) AS error, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code FROM a6 GROUP BY rid),
 books AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS y, unnest(range(len(c))) AS i FROM b6))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN done USING (rid), books
"""

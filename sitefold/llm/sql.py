"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables: brute force, by other methods."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

_VECTORS = "SELECT vec_id, label, CAST(embedding AS double[]) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_CLUSTERS, _ROUNDS = 8, 10


def _lloyd() -> str:
    """Lloyd rounds one after the other, each as two queries."""
    steps = [
        """k AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: CAST(floor(1024 * x) AS bigint)) AS v
FROM (SELECT vec_id, CAST(embedding AS double[]) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) x)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS integer) AS cluster, v AS c FROM (SELECT v, sha256('3:' || vec_id) AS h FROM k ORDER BY h LIMIT {_CLUSTERS}) x)",
    ]
    for r in range(_ROUNDS + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, v, m.cluster AS cluster, m.distance AS distance
FROM (SELECT vec_id, v, min(struct_pack(distance := list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))), cluster := cluster)) AS m FROM k, c{r} GROUP BY ALL) x)"""
        )
        if r < _ROUNDS:
            steps.append(
                f"""s{r + 1} AS (SELECT cluster, i, CAST(sum(x) AS bigint) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) x GROUP BY ALL),
m{r + 1} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r + 1} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r + 1} m USING (cluster))"""
            )
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, cluster, CAST(distance AS bigint) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS bigint) AS cluster_inertia, CAST(sum(distance) OVER () AS bigint) AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{_ROUNDS} JOIN c{_ROUNDS} USING (cluster)"""


_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_UPPER, _LOWER)

ORACLE_SQL: dict[str, str] = {
    "op3_exact_topk": f"""
WITH v AS (SELECT vec_id, list_transform(v, lambda x: floor(256 * x)) AS v FROM ({_VECTORS}) e),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS bigint) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS integer) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT * FROM ({_VECTORS}) e WHERE list_inner_product(v, v) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, vec_id <= coalesce(low.b, vec_id) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN deg ON deg.a = vec_id""",
    "op5_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, l.b FROM reach r JOIN sym l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low.b, w.doc_id)) AS component_id, w.doc_id <= coalesce(low.b, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.a = w.doc_id""",
    "op6_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM w) x),
low AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT win.doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN low USING (h) WHERE win.doc_id > low.d) x GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS bigint) AS n_words, CAST(coalesce(len(ps), 0) AS bigint) AS n_removed,
 sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256 FROM w LEFT JOIN gone USING (doc_id)""",
    "op7_line_dedup": """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, lower(trim(ls[i], ' ' || chr(9) || chr(13))) AS m FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d) x),
long AS (SELECT * FROM l WHERE length(m) >= 16),
f AS (SELECT m, min(struct_pack(a := doc_id, b := i)) AS f, length(m) AS n FROM long GROUP BY m),
pair AS MATERIALIZED (SELECT x.m AS x, y.m AS y, x.n AS nx, y.n AS ny FROM f x JOIN f y ON left(x.m, 8) = left(y.m, 8) WHERE y.f < x.f AND abs(x.n - y.n) <= 1
 UNION SELECT x.m, y.m, x.n, y.n FROM f x JOIN f y ON right(x.m, 8) = right(y.m, 8) WHERE y.f < x.f AND abs(x.n - y.n) <= 1),
half AS MATERIALIZED (SELECT *, least(nx, ny) AS n FROM pair WHERE left(x, least(nx, ny) // 2) = left(y, least(nx, ny) // 2) OR right(x, least(nx, ny) // 2) = right(y, least(nx, ny) // 2)),
ends AS (SELECT x, n, greatest(nx, ny) AS most, coalesce(list_position(list_transform(range(1, n + 1), lambda i: left(x, i) <> left(y, i)), true) - 1, n) AS a,
 coalesce(list_position(list_transform(range(1, n + 1), lambda i: right(x, i) <> right(y, i)), true) - 1, n) AS b FROM half),
near AS (SELECT DISTINCT x FROM ends WHERE least(a + b, n) >= most - 1),
gone AS (SELECT doc_id, list(DISTINCT i) AS ps FROM long JOIN f USING (m) WHERE struct_pack(a := doc_id, b := i) <> f.f OR m IN (SELECT x FROM near) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS bigint) AS n_lines, CAST(coalesce(len(ps), 0) AS bigint) AS n_removed,
 sha256(array_to_string(CASE WHEN ps IS NULL THEN ls ELSE list_filter(ls, lambda x, i: NOT list_contains(ps, i)) END, chr(10))) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)""",
    "op11_decontamination": f"""
WITH w AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS t FROM i),
d AS (SELECT doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS k FROM w, (SELECT DISTINCT m FROM iw) x),
hit AS MATERIALIZED (SELECT doc_id, k, m, item_id FROM (SELECT doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') AS t FROM d) x JOIN iw USING (m, t)),
p AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM hit) x GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item FROM hit) x GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS bigint) AS n_words, CAST(coalesce(p.n, 0) AS bigint) AS n_hit, CAST(coalesce(s.n, 0) AS bigint) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, p.n IS NOT NULL AS contaminated FROM w LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op12_fill_in_middle": """
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS varchar), '')) AS h FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, list_transform(range(4), lambda i: CAST('0x' || substring(h, CAST(8 * i + 1 AS bigint), 8) AS bigint)) AS h FROM u),
c AS (SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS bigint) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS bigint) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS bigint) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op13_centroid_clustering": _lloyd(),
}

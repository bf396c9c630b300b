"""SQL for the queries that SQL can express."""

from __future__ import annotations

_ITEM_WORDS = """
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
"""

DECONTAMINATE = f"""
WITH item_words AS ({_ITEM_WORDS}),
windows AS (
    SELECT DISTINCT item_id, w[i : i + 9] AS terms, len(w[i : i + 9]) AS n
    FROM item_words, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s(i) WHERE len(w) > 0),
docs AS (
    SELECT row_number() OVER () AS row_id, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT row_id, i, n, w[i : i + n - 1] AS terms
    FROM docs, sizes, unnest(generate_series(1, len(w) - n + 1)) AS s(i)
    WHERE n = 10 OR len(w) >= n),
matches AS (SELECT DISTINCT row_id, i, p.n, item_id FROM places p JOIN windows USING (terms)),
hit AS (SELECT row_id, count(DISTINCT j) AS n_hit FROM matches, unnest(generate_series(i, i + n - 1)) AS s(j) GROUP BY row_id),
item AS (
    SELECT row_id, count(DISTINCT item_id) AS n_items,
           string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
    FROM matches GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (row_id) LEFT JOIN item USING (row_id)
"""



def _centroids(rounds: int = 10, k: int = 8, dims: int = 64) -> str:
    """The rounds one after another, all in integers."""
    assign = """
a{r} AS MATERIALIZED (
    SELECT rid, first(c ORDER BY d, c) AS c, min(d) AS d
    FROM (SELECT rid, c, list_sum(list_transform(list_zip(kept.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept CROSS JOIN c{r})
    GROUP BY rid)"""
    move = """
s{r} AS (
    SELECT c, i, sum(v) AS s, count(*) AS n
    FROM (SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM kept JOIN a{r} USING (rid)) GROUP BY c, i),
m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY c),
c{q} AS MATERIALIZED (SELECT c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (c))"""
    steps = [
        f"""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {dims}),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x FROM kept QUALIFY c < {k})"""
    ]
    for r in range(rounds):
        steps += [assign.format(r=r), move.format(r=r, q=r + 1)]
    steps.append(assign.format(r=rounds))
    return f"""WITH {",".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (rid) JOIN c{rounds} USING (c)
"""


ORACLE: dict[str, str] = {"op4_decontaminate": DECONTAMINATE, "op12_centroids": _centroids()}

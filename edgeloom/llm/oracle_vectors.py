"""The rounds of vector codes in SQL: one set of common table expressions a round."""


def _round(r: int) -> str:
    return f"""a{r} AS MATERIALIZED (SELECT i, p.k, any_value(p.x) AS x, min((CAST(list_inner_product(b.x, b.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(p.x, p.x) AS BIGINT) * 256) + b.e) AS best
FROM p JOIN b{r} b ON p.k = b.k GROUP BY i, p.k)"""


def _books(r: int) -> str:
    return f"""m{r} AS (SELECT k, e, list(floor(s / n) ORDER BY j) AS x FROM (SELECT k, best % 256 AS e, j, sum(x[j]) AS s, count(*) AS n FROM a{r - 1}, unnest(range(1, 17)) t(j) GROUP BY ALL) GROUP BY k, e),
b{r} AS MATERIALIZED (SELECT b.k, b.e, coalesce(m.x, b.x) AS x FROM b{r - 1} b LEFT JOIN m{r} m ON m.k = b.k AND m.e = b.e)"""


OP11 = f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS i, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT i, k, q[16 * k + 1:16 * k + 16] AS x FROM v, unnest(range(0, 4)) t(k)),
b0 AS MATERIALIZED (SELECT k, i AS e, x FROM p WHERE i < 256),
{_round(0)}, {", ".join(f"{_books(r)}, {_round(r)}" for r in range(1, 5))},
c AS (SELECT i, string_agg(lpad(lower(to_hex(best % 256)), 2, '0'), '' ORDER BY k) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
(SELECT sha256(string_agg(array_to_string(list_transform(x, lambda z: CAST(CAST(z AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY k, e)) FROM b4) AS codebooks_sha256 FROM c JOIN v USING (i)"""

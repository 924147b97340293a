"""DuckDB SQL for the text and vector operators that SQL can express: the rounds written out one after another."""

from __future__ import annotations

WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _clusters(rounds: int = 3) -> str:
    steps = [f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {WHOLE} AND len(embedding) = 64),
rows_ AS (SELECT vec_id, unnest(v) AS x, unnest(range(64)) AS i FROM kept),
c0 AS (SELECT k, unnest(v) AS x, unnest(range(64)) AS i FROM (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM kept ORDER BY k LIMIT 16))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, min(struct_pack(d := d, k := k)) AS near FROM (SELECT vec_id, k, sum((rows_.x - c{r}.x) * (rows_.x - c{r}.x))::BIGINT AS d FROM rows_ JOIN c{r} USING (i) GROUP BY vec_id, k) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT near.k AS k, i, sum(x)::BIGINT AS s, count(*) AS n FROM rows_ JOIN a{r} USING (vec_id) GROUP BY near.k, i),
c{r + 1} AS (SELECT c{r}.k, i, CASE WHEN n IS NULL THEN c{r}.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} LEFT JOIN m{r} USING (k, i))""")
    steps.append(f"prints AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS p FROM c{rounds} GROUP BY k)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, near.k::INTEGER AS cluster, near.d AS distance, sum(near.d) OVER (PARTITION BY near.k)::BIGINT AS cluster_inertia, sum(near.d) OVER ()::BIGINT AS inertia, p AS centroid_sha256
FROM a{rounds} JOIN prints ON prints.k = near.k"""


def _codes(rounds: int = 4) -> str:
    steps = [f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {WHOLE} AND len(embedding) = 64),
flat AS (SELECT vec_id, unnest(v) AS x, unnest(range(64)) AS spot FROM kept),
rows_ AS (SELECT vec_id, x, spot // 16 AS part, spot % 16 AS i FROM flat),
c0 AS (SELECT rows_.*, k FROM rows_ JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT 256) USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, part, min(struct_pack(d := d, k := k)) AS near FROM (SELECT rows_.vec_id, part, k, sum((rows_.x - c{r}.x) * (rows_.x - c{r}.x))::BIGINT AS d FROM rows_ JOIN c{r} USING (part, i) GROUP BY rows_.vec_id, part, k) GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT part, near.k AS k, i, sum(x)::BIGINT AS s, count(*) AS n FROM rows_ JOIN a{r} USING (vec_id, part) GROUP BY part, near.k, i),
c{r + 1} AS (SELECT part, k, i, CASE WHEN n IS NULL THEN c{r}.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} LEFT JOIN m{r} USING (part, k, i))""")
    steps.append(f"""coded AS (SELECT vec_id, string_agg(printf('%02x', near.k), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, k, i)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


CLUSTERS = _clusters()
CODES = _codes()
PAGES = """WITH held AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
led AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS leader FROM held)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> leader THEN leader END AS refers_to FROM led"""

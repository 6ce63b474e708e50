"""SQL twins of the queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT r, ['', ''] || w AS p, unnest(range(1, len(w) + 1)) AS k FROM d),
g AS (SELECT r, p[k] AS a, p[k + 1] AS b, p[k + 2] AS c FROM p),
s AS (SELECT r, ln(count(*) OVER (PARTITION BY a, b, c)) - ln(count(*) OVER (PARTITION BY a, b)) AS v FROM g),
t AS (SELECT r, sum(v) AS v FROM s GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(v, 0), 6) AS log_score, CASE WHEN len(w) > 0 THEN round(v / len(w), 6) END AS mean_log_score
FROM d LEFT JOIN t USING (r)"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1),
b AS (SELECT p.page_id, f.first, CAST(octet_length(encode(p.h)) AS BIGINT) AS n, CAST(CAST(unhex(sha1(p.h)) AS BIT) AS VARCHAR) AS bits FROM p JOIN f USING (h))
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_reduce(list_transform(range(5), lambda k: CAST(substr(bits, 5 * i + k + 1, 1) AS INT)), lambda x, y: 2 * x + y), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b"""

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT item_id, w[k:k + 9] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i WHERE len(w) >= 10) UNION ALL SELECT item_id, w FROM i WHERE len(w) BETWEEN 1 AND 9),
s AS (SELECT DISTINCT array_to_string(g, ' ') AS g, len(g) AS n, item_id FROM g),
t AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM s) WHERE len(w) >= n)),
m AS (SELECT r, k, t.n, item_id FROM t JOIN s ON s.g = t.g AND s.n = t.n),
h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM m) GROUP BY 1),
c AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN c USING (r)"""


def _lloyd(rounds: int) -> str:
    """Rounds of Lloyd's algorithm as a chain of common tables: c<i> are the centroids of round i, n<i> each vector's nearest."""
    parts = [
        """v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS c, q FROM v WHERE vec_id IS NOT NULL QUALIFY c < 40)",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""n{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v.q) AS q, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), c := c.c)) AS m
  FROM v CROSS JOIN c{i} AS c GROUP BY r)"""
        )
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(q) AS x, unnest(range(64)) AS k FROM n{i}) GROUP BY 1, 2)")
            parts.append(
                f"c{i + 1} AS (SELECT c.c, coalesce(t.q, c.q) AS q FROM c{i} AS c LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k) AS q FROM s{i} GROUP BY 1) AS t USING (c))"
            )
    return "WITH " + ",\n".join(parts)


OP12 = f"""{_lloyd(5)}
SELECT vec_id, CAST(m.c AS INT) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM n5 JOIN c5 AS c ON c.c = m.c"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
b AS (SELECT row_number() OVER () AS q, item_id, {_TERMS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT q, t, count(*) AS qtf FROM (SELECT q, unnest(w) AS t FROM b) GROUP BY 1, 2),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p CROSS JOIN c GROUP BY t, n_docs),
s AS (SELECT q, r, CAST(sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN f USING (t) JOIN d USING (r) CROSS JOIN c GROUP BY 1, 2),
k AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k JOIN b USING (q) WHERE rank <= 20"""

"""DuckDB SQL for the queries that SQL can express."""

#: Twenty bits of the digest (five hex digits) are four letters of base 32.
OP7 = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM hashed
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6 = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + 9], ' ') AS k
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(p) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS rn, doc_id, {_WORDS} AS w FROM documents),
hits AS (
  SELECT rn, p, n, item_id
  FROM (SELECT rn, p, l.n, array_to_string(w[p:p + l.n - 1], ' ') AS k
        FROM d, (SELECT DISTINCT n FROM windows) l, unnest(range(1, len(w) - l.n + 2)) t(p) WHERE len(w) >= l.n) x
  JOIN windows USING (n, k)),
places AS (SELECT rn, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + n)) t(q) GROUP BY rn),
found AS (SELECT rn, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rn) LEFT JOIN found USING (rn)
"""
#: Texts as hexadecimal digits, two for each byte; a run of removed bytes goes on while starts lie no more than 200 apart.
OP8 = """
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT rn, o, length(h) // 2 - 200 - o AS most, substr(h, CAST(2 * o + 1 AS BIGINT), 1400) AS part FROM d, unnest(range(0, length(h) // 2 - 199, 500)) t(o) WHERE length(h) >= 400),
w AS (SELECT rn, o + q AS p, md5(substr(part, CAST(2 * q + 1 AS BIGINT), 400)) AS k FROM b, unnest(range(0, least(most, 499) + 1)) t(q)),
r AS (SELECT rn, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
m AS (SELECT rn, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rn ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT rn, min(p) AS a, max(p) + 200 AS b FROM (SELECT rn, p, sum(new) OVER (PARTITION BY rn ORDER BY p) AS g FROM m) GROUP BY rn, g),
kept AS (
  SELECT rn, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(part, '' ORDER BY a) AS front
  FROM (SELECT rn, a, b, substr(h, CAST(2 * coalesce(lag(b) OVER (PARTITION BY rn ORDER BY a), 0) + 1 AS BIGINT), CAST(2 * (a - coalesce(lag(b) OVER (PARTITION BY rn ORDER BY a), 0)) AS BIGINT)) AS part FROM s JOIN d USING (rn))
  GROUP BY rn)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN kept USING (rn)
"""

def _rounds(k: int = 40, rounds: int = 5) -> str:
    """The rounds of op12 one after the other: a<r> has each vector's centroid, c<r> the centroids; inner products of whole numbers are exact."""
    d = "CAST(list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS BIGINT)"
    assigned = f"SELECT rn, min({d} * 64 + k) // 64 AS distance, min({d} * 64 + k) % 64 AS k FROM v, c{{r}} GROUP BY rn"
    parts = [
        """WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({assigned.format(r=r)})")
        means = f"SELECT k, i, floor(sum(x[i]) / count(*)) AS mean FROM v JOIN a{r} USING (rn), unnest(range(1, 65)) t(i) GROUP BY k, i"
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, old.c) AS c FROM c{r} old LEFT JOIN (SELECT k, list(mean ORDER BY i) AS c FROM ({means}) GROUP BY k) m USING (k))")
    parts.append(f"a AS MATERIALIZED ({assigned.format(r=rounds)})")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c, lambda e: CAST(e AS BIGINT)), ',')) AS centroid_sha256
FROM a JOIN v USING (rn) JOIN c{rounds} USING (k)
"""


OP12 = _rounds()

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, {_TERMS} AS w FROM documents),
q AS MATERIALIZED (SELECT it, item_id, t, count(*) AS times FROM (SELECT row_number() OVER () AS it, item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
f AS MATERIALIZED (SELECT rn, t, count(*) AS tf FROM (SELECT rn, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY rn, t),
x AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, s GROUP BY t, n),
p AS (
  SELECT it, item_id, rn, CAST(sum(times * weight * (1000000000 * tf // (1000 * tf + 12 * (75 + 25 * len(w) * n // total)))) AS BIGINT) AS score
  FROM q JOIN x USING (t) JOIN f USING (t) JOIN d USING (rn), s GROUP BY it, item_id, rn)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, row_number() OVER (PARTITION BY it ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM p JOIN d USING (rn) WHERE score > 0) WHERE rank <= 20
"""

ORACLES: dict[str, str] = {"op6_decontamination": OP6, "op7_warc_revisits": OP7, "op8_suffix_dedup": OP8, "op12_kmeans": OP12, "op13_lexical_search": OP13}

"""The queries of this subpackage, each over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import branch_merge, centroids, fingerprints, jaccard_join, line_quality, packing, sentencepiece, sharding, substring_dedup, suffix_dedup, token_counts, token_files, warc
from vellum.llm.encoders import tokenizer_path


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_documents(spark, d), tokenizer_path("word_bpe_49k.json"))


def op2_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, d))


def op3_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return sentencepiece.digests(_documents(spark, d), tokenizer_path("piece_bpe_32k.model"))


def op4_token_files(spark: SparkSession, d: str) -> DataFrame:
    return token_files.write_and_read(_documents(spark, d), tokenizer_path("byte_bpe_50k.json"))


def op5_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, d))


def op6_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.write_and_read(spark.read.parquet(f"{d}/pages.parquet"))


def op7_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.compare(_documents(spark, d))


def op8_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard(_documents(spark, d))


def op9_line_quality(spark: SparkSession, d: str) -> DataFrame:
    return line_quality.verdicts(line_quality.facts(_documents(spark, d))).drop("rid", "places")


def op10_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.join(_documents(spark, d))


def op11_centroids(spark: SparkSession, d: str) -> DataFrame:
    return centroids.clustered(spark.read.parquet(f"{d}/embeddings.parquet"))


def op12_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, d), tokenizer_path("byte_bpe_50k.json"))


def op13_branch_merge(spark: SparkSession, d: str) -> DataFrame:
    return branch_merge.digests(_documents(spark, d))


QUERIES = {f.__name__: f for f in (op1_packing, op2_substring_dedup, op3_sentencepiece, op4_token_files, op5_suffix_dedup, op6_warc, op7_fingerprints, op8_sharding, op9_line_quality, op10_jaccard_join, op11_centroids, op12_token_counts, op13_branch_merge)}

def _rounds_sql(k: int = 40, rounds: int = 5) -> str:
    """Plain rounds of assignment and floored means."""
    squared = "CAST(list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q) AS BIGINT)"
    parts = [
        f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS c, q FROM v QUALIFY c < {k})"""
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, m % {k} AS c, m // {k} AS d FROM (SELECT v.r, min({squared} * {k} + c.c) AS m FROM v, c{i} c GROUP BY v.r))")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, i, CAST(sum(CAST(q[i] AS BIGINT)) AS HUGEINT) AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, 65) t(i) GROUP BY c, i)")
            parts.append(f"n{i} AS (SELECT c, list(CAST((s - (s % n + n) % n) // n AS DOUBLE) ORDER BY i) AS q FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN n{i} USING (c))")
    parts.append(f"h AS (SELECT c, sha256(array_to_string(list_transform(q, lambda x: CAST(x AS BIGINT)), ',')) AS h FROM c{rounds})")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN h USING (c)
"""


ORACLE_SQL = {
    "op11_centroids": _rounds_sql(),
    "op13_branch_merge": r"""
WITH t AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM range(256) x(i))),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
u AS (SELECT r, b, unnest(list_concat(['row', 'lang', 'source'], list_transform(range(len(w)), lambda i: CAST(i AS VARCHAR)))) AS name,
             unnest(list_concat([NULL, lang, source], w)) AS base, unnest(range(-3, len(w))) AS i, b || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS p
      FROM d, (VALUES ('L'), ('R')) x(b)),
z AS MATERIALIZED (SELECT r, b, i, base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(p || name, ''), lambda y: CAST(ascii(y) AS BIGINT))),
             lambda c, y: xor(c // 256, tab[CAST(xor(c % 256, y) + 1 AS INTEGER)])), 4294967295) % 7 AS k FROM u, t),
s AS (SELECT r, b, i, base, k, CASE WHEN k = 0 AND i < 0 THEN '' WHEN k = 0 THEN NULL WHEN k = 1 THEN base || '!' WHEN k = 2 THEN base || '?' ELSE base END AS x,
             CASE WHEN i >= 0 AND k = 3 THEN '!' WHEN i >= 0 AND k = 4 THEN '?' END AS g FROM z WHERE i > -3),
p AS MATERIALIZED (SELECT r, i, l.base, l.x AS lx, q.x AS rx, l.g AS lg, q.g AS rg FROM (SELECT * FROM s WHERE b = 'L') l JOIN (SELECT * FROM s WHERE b = 'R') q USING (r, i)),
m AS (SELECT r, i, base, lx, rx, lg, rg, lx IS DISTINCT FROM base AS a, rx IS DISTINCT FROM base AS c, lx IS DISTINCT FROM rx AS o FROM p),
f AS (SELECT r, bool_or(a OR lg IS NOT NULL) AS lch, bool_or(c OR rg IS NOT NULL) AS rch,
             sum(CASE WHEN (a OR c) AND NOT (a AND c AND o) THEN 1 ELSE 0 END + CASE WHEN coalesce(lg, rg) IS NOT NULL AND NOT coalesce(lg <> rg, false) THEN 1 ELSE 0 END) AS clean,
             count(*) FILTER (WHERE a AND c AND o AND lx IS NOT NULL AND rx IS NOT NULL) AS ee,
             count(*) FILTER (WHERE a AND c AND o AND (lx IS NULL OR rx IS NULL)) AS ed, count(*) FILTER (WHERE lg <> rg) AS ii,
             max(CASE WHEN i = -2 THEN CASE WHEN c THEN rx ELSE lx END END) AS mlang, max(CASE WHEN i = -1 THEN CASE WHEN c THEN rx ELSE lx END END) AS msource,
             max(CASE WHEN i = -2 THEN rx END) AS rlang, max(CASE WHEN i = -1 THEN rx END) AS rsource FROM m GROUP BY r),
o AS (SELECT r, i, 0 AS j, CASE WHEN c THEN rx ELSE lx END AS x, rx FROM m WHERE i >= 0 UNION ALL SELECT r, i, 1, coalesce(rg, lg), rg FROM m WHERE i >= 0),
txt AS (SELECT r, string_agg(x, chr(10) ORDER BY i, j) FILTER (WHERE x IS NOT NULL) AS t, string_agg(rx, chr(10) ORDER BY i, j) FILTER (WHERE rx IS NOT NULL) AS rt FROM o GROUP BY r),
k AS (SELECT r, max(CASE WHEN b = 'L' THEN k END) AS lk, max(CASE WHEN b = 'R' THEN k END) AS rk FROM z WHERE i = -3 GROUP BY r),
y AS (SELECT *, lk = 0 OR rk = 0 AS whole, (lk = 0 AND rk <> 0 AND rch) OR (rk = 0 AND lk <> 0 AND lch) AS fight FROM d JOIN f USING (r) JOIN txt USING (r) JOIN k USING (r))
SELECT doc_id, CASE WHEN NOT whole THEN mlang WHEN fight AND rk <> 0 THEN rlang END AS lang, CASE WHEN NOT whole THEN msource WHEN fight AND rk <> 0 THEN rsource END AS source,
       CASE WHEN NOT whole THEN sha256(coalesce(t, '')) WHEN fight AND rk <> 0 THEN sha256(coalesce(rt, '')) END AS text_sha256,
       CAST(CASE WHEN NOT whole THEN clean WHEN fight THEN 0 ELSE 1 END AS BIGINT) AS n_clean, CAST(CASE WHEN whole THEN 0 ELSE ee END AS BIGINT) AS n_edit_edit,
       CAST(CASE WHEN NOT whole THEN ed WHEN fight THEN 1 ELSE 0 END AS BIGINT) AS n_edit_delete, CAST(CASE WHEN whole THEN 0 ELSE ii END AS BIGINT) AS n_insert_insert FROM y
UNION ALL
SELECT -1 - doc_id, lang, source, sha256(CASE WHEN rk IN (3, 4) THEN chr(CASE rk WHEN 3 THEN 33 ELSE 63 END) ELSE chr(CASE lk WHEN 3 THEN 33 ELSE 63 END) END),
       CASE WHEN lk IN (3, 4) AND rk IN (3, 4) AND lk <> rk THEN 0 ELSE 1 END, 0, 0, CASE WHEN lk IN (3, 4) AND rk IN (3, 4) AND lk <> rk THEN 1 ELSE 0 END
FROM d JOIN k USING (r) WHERE lk IN (3, 4) OR rk IN (3, 4)
""",
    "op9_line_quality": r"""
WITH d AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY coalesce(source, chr(1)), coalesce(text, '')) AS u,
                               coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
u AS MATERIALIZED (SELECT u, any_value(host) AS host, any_value(text) AS text FROM d GROUP BY u),
ul AS (SELECT u, host, unnest(string_split(lower(text), chr(10))) AS line FROM u),
un AS (SELECT u, host, array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ') AS line,
              len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM ul),
uf AS MATERIALIZED (SELECT u, host, line, sum(w) AS w FROM un WHERE w > 0 GROUP BY ALL),
above AS (SELECT host, line FROM uf GROUP BY host, line HAVING count(*) > 6),
gone AS (SELECT u, sum(w) AS g FROM uf JOIN above USING (host, line) GROUP BY u),
ws AS MATERIALIZED (SELECT u, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM u),
pos AS (SELECT u, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM ws),
win AS (SELECT u, i, a, lead(a) OVER (PARTITION BY u ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY u ORDER BY i) AS c FROM pos),
cnt AS (SELECT u, i, count(*) OVER (PARTITION BY u, a, b, c) AS n FROM win WHERE c IS NOT NULL),
rep AS (SELECT u, count(DISTINCT p) AS r FROM (SELECT u, unnest([i, i + 1, i + 2]) AS p FROM cnt WHERE n >= 2) GROUP BY u),
dl AS (SELECT u, count(*) - count(DISTINCT line) AS dup FROM (SELECT u, unnest(string_split(text, chr(10))) AS line FROM u)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY u),
x AS (SELECT d.doc_id, CAST(len(ws.w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dl.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.r, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(gone.g, 0) AS BIGINT) AS n_removed_words
      FROM d JOIN ws USING (u) LEFT JOIN dl USING (u) LEFT JOIN rep USING (u) LEFT JOIN gone USING (u)),
y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT *, NOT base_failed AND (n_words - n_removed_words) >= 0.75 * n_words AS kept FROM y
""",
    "op2_substring_dedup": r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
low AS (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win),
gone AS MATERIALIZED (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM low WHERE m < doc_id),
pos AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (r, p) GROUP BY r),
n AS (SELECT r, count(*) AS g FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
x AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
y AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM y
""",
    "op10_jaccard_join": r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE m >= 0.8 * (x.n + y.n - m)),
t(r, o) AS (SELECT r, r FROM d UNION SELECT t.r, e.b FROM t JOIN e ON e.a = t.o),
k AS (SELECT t.r, min(d.doc_id) AS class_id FROM t JOIN d ON d.r = t.o GROUP BY t.r),
l AS (SELECT a AS r, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, k.class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM d JOIN k USING (r) LEFT JOIN l USING (r)
""",
}

"""The registered queries of the operators: ``QUERIES`` (name -> callable) and
``ORACLE_SQL`` (name -> DuckDB SQL, where SQL expresses the result)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from medialake.llm import (clustering, decontaminate, fingerprints, html, licenses, line_dedup, mixing, near_dup, ngram_join,
                           prefix_trie, quality, sharding, warc)
from medialake.llm.rows import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn
    return add


LINE_DEDUP_SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
wins AS (
  SELECT doc_id, text, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS w
  FROM (SELECT doc_id, text, l, unnest(range(0, len(l) - 2)) AS p FROM docs WHERE len(l) >= 3)),
ranked AS (
  SELECT doc_id, text, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, md5(text), p) AS rk
  FROM wins WHERE regexp_matches(w, '[^\n\t\r ]')),
gone AS (
  SELECT doc_id, list_distinct(flatten(list([p, p + 1, p + 2]))) AS g
  FROM ranked WHERE rk > 1 GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN g IS NULL THEN text
            ELSE array_to_string([l[i + 1] FOR i IN range(0, len(l)) IF NOT list_contains(g, i)], chr(10)) END AS text,
       coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed
FROM docs d LEFT JOIN gone USING (doc_id)"""


@_query(LINE_DEDUP_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


FINGERPRINTS_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ring AS (
  SELECT doc_id, text, length(text) AS n, length(text) // 3 AS take,
         coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt
  FROM docs),
edit AS (SELECT doc_id, n, text AS t0, substr(text, 1, n - take) || substr(nxt, 1, take) AS t1, nxt AS t2 FROM ring),
texts AS (SELECT doc_id, unnest([0, 1, 2]) AS k, unnest([t0, t1, t2]) AS t FROM edit),
words AS (
  SELECT doc_id, k, list_filter(regexp_split_to_array(lower(t), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM texts),
sketches AS (
  SELECT doc_id, k, substr(md5(array_to_string(w, ' ')), 1, 8) AS head,
         list_sort(list_distinct(list_filter(
           CASE WHEN len(w) = 0 THEN []::VARCHAR[]
                ELSE [substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 16) FOR i IN range(1, greatest(len(w) - 4, 1) + 1)] END,
           lambda h: h < '8000000000000000'))) AS s
  FROM words),
wide AS (
  SELECT doc_id,
         max(head || ':' || array_to_string(s, '')) FILTER (k = 0) AS f0, max(head || ':' || array_to_string(s, '')) FILTER (k = 1) AS f1,
         max(head || ':' || array_to_string(s, '')) FILTER (k = 2) AS f2,
         any_value(s) FILTER (k = 0) AS s0, any_value(s) FILTER (k = 1) AS s1, any_value(s) FILTER (k = 2) AS s2
  FROM sketches GROUP BY doc_id)
SELECT e.doc_id, e.n AS n_chars, sha256(t1) AS edited_sha256, f0 AS fingerprint, f1 AS edited_fingerprint,
       CASE WHEN f0 = f1 THEN 1.0::DOUBLE WHEN len(s0) = 0 OR len(s1) = 0 THEN 0.0::DOUBLE
            ELSE len(list_intersect(s0, s1))::DOUBLE / least(len(s0), len(s1)) END AS near_edited,
       CASE WHEN f0 = f2 THEN 1.0::DOUBLE WHEN len(s0) = 0 OR len(s2) = 0 THEN 0.0::DOUBLE
            ELSE len(list_intersect(s0, s2))::DOUBLE / least(len(s0), len(s2)) END AS near_next
FROM edit e JOIN wide USING (doc_id)"""


@_query(FINGERPRINTS_SQL)
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.tail_edit_fingerprints(table(spark, sf_dir, "documents"))


@_query()
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Poisson counts at temperature 0.5 over as many documents as the table has.
MIXED_SQL = r"""
WITH RECURSIVE src AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, n, sqrt(n) / (SELECT sum(sqrt(n)) FROM src) * (SELECT sum(n) FROM src) / n AS rate FROM src),
pieces AS (SELECT source, greatest(ceil(rate / 16), 1)::INT AS pieces, rate / greatest(ceil(rate / 16), 1) AS mean FROM rates),
pmf(source, mean, k, p, c) AS (
  SELECT source, mean, 0, exp(-mean), exp(-mean) FROM pieces
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM pmf WHERE k < ceil(mean + 12 * sqrt(mean) + 24)),
cdf AS (SELECT source, list(c ORDER BY k) AS cdf FROM pmf GROUP BY source),
keys AS (
  SELECT d.*, '17' || chr(31) || d.doc_id || chr(31) || md5(coalesce(d.text, chr(30))) AS key, pieces, cdf
  FROM documents d JOIN pieces USING (source) JOIN cdf USING (source)),
drawn AS (
  SELECT *, list_sum([len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5(key || chr(31) || piece), 1, 13))::BIGINT / 4503599627370496.0))
                      FOR piece IN range(1, pieces + 1)])::INT AS m
  FROM keys)"""


@_query(MIXED_SQL + """
SELECT doc_id, source, text, unnest(range(0, m))::INT AS copy FROM drawn""")
def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.poisson_mix(docs, with_copy=True)


#: Shards over a relation ``docs(doc_id, text)``; recursion splits oversized prefixes.
SHARDS_CTE = r"""
hashed AS (
  SELECT *, [('0x' || substr(md5(doc_id || chr(31) || coalesce(text, chr(30))), 1 + 8 * i, 8))::BIGINT FOR i IN range(0, 4)] AS q,
         coalesce(strlen(text), 0) AS size
  FROM docs),
bits AS (
  SELECT *, lpad(bin(q[1]), 32, '0') || lpad(bin(q[2]), 32, '0') AS bits FROM hashed),
nodes AS (
  SELECT d, substr(bits, 1, d) AS node, sum(size) AS b FROM (SELECT bits, size, unnest(range(0, 48)) AS d FROM bits) GROUP BY d, node)"""


@_query("""WITH docs AS (SELECT doc_id, text FROM documents),""" + SHARDS_CTE + """,
deep AS (
  SELECT doc_id, coalesce(max(n.d) + 1, 0) AS depth
  FROM bits LEFT JOIN nodes n ON n.b > 1048576 AND starts_with(bits.bits, n.node) GROUP BY doc_id)
SELECT doc_id, size::BIGINT AS n_bytes, substr(bits, 1, depth) AS shard, depth::INT AS shard_depth, size > 1048576 AS shard_oversize
FROM bits JOIN deep USING (doc_id)""")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", n_bytes)
    return sharding.shard_rows(docs, carry=["doc_id", "n_bytes"])


NEAR_DUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END)) AS s FROM words),
classes AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT c, n, unnest(s) AS x FROM classes),
links AS (
  SELECT a.c AS a, b.c AS b FROM items a JOIN items b ON a.x = b.x AND a.c < b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(c, r) AS (SELECT c, c FROM classes UNION SELECT reach.c, b FROM reach JOIN both_ways ON reach.r = a),
heads AS (SELECT c, min(r) AS h FROM reach GROUP BY c)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(h, d.doc_id) AS component_id, d.doc_id = coalesce(h, d.doc_id) AS kept
FROM sets d LEFT JOIN classes k ON d.s = k.s LEFT JOIN heads ON heads.c = k.c"""


@_query(NEAR_DUP_SQL)
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


@_query()
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@_query()
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query()
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


@_query()
def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.build_derivatives(warc.page_responses(table(spark, sf_dir, "pages")), id_col="page_id")


def _clusters_sql(rounds: int = 3) -> str:
    """Integer k-means, one pair of CTEs per round."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i])))"
    parts = [r"""
vecs AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v AS c FROM vecs
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= 16)"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS (
  SELECT vec_id, any_value(v.v) AS v, min(({distance}, cluster)) AS near
  FROM vecs v, c{i} c GROUP BY vec_id)""")
        if i < rounds:
            parts.append(f"""
s{i} AS (
  SELECT cluster, list(m ORDER BY i) AS c
  FROM (SELECT near[2] AS cluster, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m
        FROM (SELECT near, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY ALL) GROUP BY cluster),
c{i + 1} AS (SELECT c{i}.cluster, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} USING (cluster))""")
    return "WITH" + ",".join(parts) + f"""
SELECT vec_id, near[2]::INT AS cluster, near[1]::BIGINT AS distance,
       sum(near[1]) OVER (PARTITION BY near[2])::BIGINT AS cluster_inertia, sum(near[1]) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON cluster = near[2]"""


@_query(_clusters_sql())
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = clustering.cluster_vectors(table(spark, sf_dir, "embeddings"), dims=64, k=16, rounds=3, scale=64)
    return got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                      clustering.centroid_digest(got["centroid"]).alias("centroid_sha256"))


#: CRC-32 bit by bit; nodes are the distinct lists of (role, text).
TRIE_SQL = r"""
WITH own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS l
  FROM conversations GROUP BY conv_id),
starts AS (
  SELECT *, (4294967295 - list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda crc, b:
    list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(crc, b)), 4294967295)) % 6 AS h
  FROM own),
convs AS (
  SELECT s.conv_id, list_concat(coalesce(b.l, [])[1:s.h], s.l[s.h + 1:]) AS l
  FROM starts s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 100),
steps AS (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM convs),
nodes AS (
  SELECT d, l[1:d] AS p, min(conv_id) AS c, count(*) AS n, (count(*) - 1) * coalesce(any_value(length(l[d].t)), 0) AS saved,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(l) = d), '') AS ends
  FROM steps GROUP BY d, l[1:d]),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (p, d)),
tops AS (SELECT unnest(range(0, d + 1)) AS d0, p, saved, k FROM full_nodes),
subtrees AS (SELECT d0 AS d, p[1:d0] AS p, sum(saved) AS saved, count(*) FILTER (k = 0) AS leaves FROM tops GROUP BY d0, p[1:d0])
SELECT a.c::BIGINT AS conv_id, a.d::BIGINT AS depth, up.c::BIGINT AS parent_conv_id, a.n::BIGINT AS n_convs, a.k::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM full_nodes a JOIN subtrees s USING (p, d) LEFT JOIN full_nodes up ON up.d = a.d - 1 AND up.p = a.p[1:a.d - 1]"""


@_query(TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@_query(NEAR_DUP_SQL.replace(">= 85 *", ">= 90 *").replace(", d.doc_id = coalesce(h, d.doc_id) AS kept", ""))
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), words=3, percent=90)

"""The operators over the supplied tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthcast.llm import archive, bpe, exact_dedup, langid, lm, merkle, mixing, near_dedup, neighbours, periodic
from monthcast.llm import quality, substrings, whitening
from monthcast.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql.strip()
        return build

    return register


@query("op1_lm_scores")
def op1_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return lm.scored(docs, ~lm.held_out(docs["doc_id"]))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identified(table(spark, sf, "documents"))


@query(
    "op3_warc_archive",
    r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
r AS (SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM first AS again FROM f),
w AS (
  SELECT *, 'WARC/1.1' || n || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END || n
    || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none') || '>' || n
    || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\r\n]+', ' ', 'g') || n
    || 'WARC-Date: 1970-01-01T00:00:00Z' || n || 'WARC-Payload-Digest: sha256:' || payload_digest || n
    || CASE WHEN again THEN 'WARC-Refers-To: <urn:page:' || coalesce(CAST(first AS VARCHAR), 'none') || '>' || n
         || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || n ELSE '' END
    || 'Content-Type: text/html' || n
    || 'Content-Length: ' || CASE WHEN again THEN 0 ELSE payload_bytes END || n || n
    || CASE WHEN again THEN '' ELSE body END || n || n AS record
  FROM r, (SELECT chr(13) || chr(10) AS n))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to, strlen(record) AS record_bytes, sha256(record) AS record_sha256
FROM w""",
)
def op3_warc_archive(spark: SparkSession, sf: str) -> DataFrame:
    return archive.archived_pages(spark, sf)


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.scored(docs, quality.fit(docs))


@query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)


@query(
    "op6_source_mix",
    r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         len(regexp_extract_all(coalesce(text, ''), '[!$%&#*|]')) AS signs
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5)
             / 4503599627370496.0)
         / greatest((size + 1)::DOUBLE / (size + 1 + 8 * signs), 1e-9) AS key
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM k GROUP BY source),
rounds AS (
  SELECT 0 AS step, source, source_size, weight, false AS stops FROM s
  UNION ALL
  SELECT step + 1, source, source_size, weight,
         stops OR 3 * source_size < weight * (t - stopped) / nullif(free, 0)
  FROM (SELECT *, sum(source_size) OVER () AS t, sum(CASE WHEN stops THEN 3 * source_size ELSE 0 END) OVER () AS stopped,
               sum(CASE WHEN stops THEN 0 ELSE weight END) OVER () AS free FROM rounds)
  WHERE step < 100),
last AS (
  SELECT source, source_size, stops, weight, sum(source_size) OVER () AS t,
         sum(CASE WHEN stops THEN 3 * source_size ELSE 0 END) OVER () AS stopped,
         sum(CASE WHEN stops THEN 0 ELSE weight END) OVER () AS free
  FROM rounds WHERE step = 100),
g AS (
  SELECT source, source_size,
         CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE ((t - stopped) * weight)::DOUBLE / free::DOUBLE END AS target
  FROM last),
r AS (
  SELECT k.*, g.source_size, g.target, floor(target)::BIGINT AS whole,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS epochs FROM r),
q AS (SELECT *, greatest(0, least(size, whole - epochs * source_size - before))::BIGINT AS part FROM e)
SELECT doc_id, size, source_size, target, (epochs * size + part)::BIGINT AS taken, epochs, part FROM q""",
)
def op6_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(table(spark, sf, "documents"))


@query("op7_near_dedup")
def op7_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf, "documents"))


@query("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


@query(
    "op9_exact_dedup",
    """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf, "documents"))


@query(
    "op10_merkle_fingerprints",
    rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
o AS (
  SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC, t), first_value(t) OVER (ORDER BY doc_id DESC, t)) AS nx
  FROM d),
e AS (SELECT *, left(t, n - n // 2) || left(nx, n // 2) AS ed FROM o),
l AS (
  SELECT doc_id, n, ed,
         list_transform(regexp_extract_all(t, '{merkle.PIECES}'), lambda x: md5(x)[1:16]) AS a,
         list_transform(regexp_extract_all(ed, '{merkle.PIECES}'), lambda x: md5(x)[1:16]) AS b,
         list_transform(regexp_extract_all(nx, '{merkle.PIECES}'), lambda x: md5(x)[1:16]) AS c
  FROM e),
m AS (
  SELECT *, list_filter(range(1, len(a) + 1), lambda i: a[i][1] = '{merkle.ENDS}' OR i = len(a)) AS ea,
         list_filter(range(1, len(b) + 1), lambda i: b[i][1] = '{merkle.ENDS}' OR i = len(b)) AS eb
  FROM l),
s AS (
  SELECT *,
         list_transform(range(1, len(ea) + 1), lambda k:
           sha256(list_aggregate(a[CASE WHEN k > 1 THEN ea[k - 1] ELSE 0 END + 1:ea[k]], 'string_agg', ''))) AS sa,
         list_transform(range(1, len(eb) + 1), lambda k:
           sha256(list_aggregate(b[CASE WHEN k > 1 THEN eb[k - 1] ELSE 0 END + 1:eb[k]], 'string_agg', ''))) AS sb
  FROM m),
x AS (SELECT *, list_filter(range(len(sb)), lambda i: NOT list_contains(sa, sb[i + 1])) AS news FROM s)
SELECT doc_id, n AS n_chars, sha256(ed) AS edited_sha256,
       sha256(coalesce(list_aggregate(sa, 'string_agg', ''), '')) AS fingerprint,
       sha256(coalesce(list_aggregate(sb, 'string_agg', ''), '')) AS edited_fingerprint,
       CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE
         2.0::DOUBLE * len(list_intersect(a, b)) / (len(list_distinct(a)) + len(list_distinct(b))) END AS near_edited,
       CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE
         2.0::DOUBLE * len(list_intersect(a, c)) / (len(list_distinct(a)) + len(list_distinct(c))) END AS near_next,
       CAST(len(list_distinct(list_transform(news, lambda i: sb[i + 1]))) AS INTEGER) AS n_edited_sections,
       array_to_string(news, ',') AS edited_sections
FROM x""",
)
def op10_merkle_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    rows = merkle.edited_fingerprints(table(spark, sf, "documents"))
    return rows.withColumn("edited_sections", F.array_join("edited_sections", ","))


@query(
    "op11_nearest_neighbours",
    """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, list_reduce(list_transform(e, lambda x: x * x), lambda x, y: x + y) AS square FROM v),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda x, y: x + y)
           / sqrt(q.square * c.square) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
)
def op11_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op12_whitened_embeddings")
def op12_whitened_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(table(spark, sf, "embeddings"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    changed = docs.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text")))
    return periodic.digests(periodic.without_runs(changed))

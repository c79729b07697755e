"""Queries: data quality and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthcast.catalogue.registry import (
    FACT,
    LINES,
    SNAPSHOT_END,
    SPARSE,
    fact,
    query,
    sales_lines,
    shown,
    sparse_fact,
    table,
)
from monthcast.operators import quality as Q
from monthcast.session import materialize
from monthcast.sources.snapshots import snapshot_freshness


REPORTED = ("product_id", "product_category_id", "MONAT", "anz_produkt", "unit_preis")
SQL_TYPES = "CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date' WHEN 'DOUBLE' THEN 'double' END"


def _missing_sql(c: str) -> str:
    share = f"100.0 * count_if({c} IS NULL) / count(*)"
    return f"SELECT 'missing_pct', '{c}', CAST(CAST(round_even({share}, 2) AS DOUBLE) AS VARCHAR) FROM sparse"


@query(
    "q1_quality_report",
    SPARSE
    + f""",
types AS (
  SELECT unnest(['{"', '".join(REPORTED)}']) AS column_name,
         unnest([{", ".join(f"any_value(typeof({c}))" for c in REPORTED)}]) AS data_type FROM sparse)
SELECT 'total_rows' AS measure, CAST(NULL AS VARCHAR) AS column_name, CAST(count(*) AS VARCHAR) AS value FROM sparse
UNION ALL SELECT 'duplicate_rows', NULL, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM sparse)) AS VARCHAR)
          FROM sparse
UNION ALL {" UNION ALL ".join(_missing_sql(c) for c in REPORTED)}
UNION ALL SELECT 'start', 'MONAT', CAST(min(MONAT) AS VARCHAR) FROM sparse
UNION ALL SELECT 'end', 'MONAT', CAST(max(MONAT) AS VARCHAR) FROM sparse
UNION ALL SELECT 'span_months', 'MONAT', CAST((max(MONAT) - min(MONAT)) // 30 AS VARCHAR) FROM sparse
UNION ALL SELECT 'data_type', column_name, {SQL_TYPES} FROM types
UNION ALL SELECT 'missing_column', c, NULL FROM (VALUES ('product_id'), ('stock')) r(c)
          WHERE c NOT IN (SELECT column_name FROM types)
UNION ALL SELECT 'wrong_type', column_name, {SQL_TYPES} FROM types
          WHERE column_name = 'anz_produkt' AND {SQL_TYPES} <> 'bigint'""",
)
def q1(spark, sf):
    """Every measure of the monthly fact; it has no stock column, and its quantities are no whole numbers."""
    return Q.quality_report(sparse_fact(spark, sf), ["product_id", "stock"], {"anz_produkt": "bigint", "MONAT": "date"})


@query(
    "q2_missing_share",
    SPARSE
    + """
SELECT 'product_id' AS column_name, round_even(100.0 * count_if(product_id IS NULL) / count(*), 2) AS missing_pct FROM sparse
UNION ALL SELECT 'product_category_id', round_even(100.0 * count_if(product_category_id IS NULL) / count(*), 2) FROM sparse
UNION ALL SELECT 'MONAT', round_even(100.0 * count_if(MONAT IS NULL) / count(*), 2) FROM sparse
UNION ALL SELECT 'anz_produkt', round_even(100.0 * count_if(anz_produkt IS NULL) / count(*), 2) FROM sparse
UNION ALL SELECT 'unit_preis', round_even(100.0 * count_if(unit_preis IS NULL) / count(*), 2) FROM sparse""",
)
def q2(spark, sf):
    return Q.missing_share(sparse_fact(spark, sf))


@query(
    "q3_duplicate_rows",
    """
SELECT CAST(sum(c - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_partkey, l_returnflag, l_quantity)""",
)
def q3(spark, sf):
    return Q.duplicate_rows(table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_quantity"))


@query(
    "q5_date_range",
    LINES
    + """
SELECT CAST(min(day) AS VARCHAR) AS "start", CAST(max(day) AS VARCHAR) AS "end",
       CAST(floor((max(day) - min(day)) / 30) AS BIGINT) AS span_months
FROM lines""",
)
def q5(spark, sf):
    df = sales_lines(spark, sf).withColumn("MONAT", F.col("MONAT").cast("string"))
    return shown(Q.date_range(df), dates=("start", "end"))


@query(
    "q6_duplicate_months",
    LINES
    + """
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, count(*) AS rows
FROM lines GROUP BY product_id, MONAT HAVING count(*) > 1""",
)
def q6(spark, sf):
    monthly_lines = sales_lines(spark, sf).withColumn("MONAT", F.trunc("MONAT", "MM"))
    return shown(Q.duplicate_months(monthly_lines))


@query(
    "q7_dataset_profile",
    FACT
    + """
SELECT count(DISTINCT product_id) AS num_products, count(*) AS num_records,
       CAST(min(MONAT) AS VARCHAR) AS "start", CAST(max(MONAT) AS VARCHAR) AS "end"
FROM fact""",
)
def q7(spark, sf):
    return shown(Q.dataset_profile(fact(spark, sf)), dates=("start", "end"))


def _lane_sql(i: int) -> str:
    return f"CAST(sum(CAST('0x' || substr(h, {4 + 7 * i}, 7) AS BIGINT)) AS BIGINT) AS s{i}"


def _marked_sql(c: str) -> str:
    return f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


FINGERPRINT = (
    LINES
    + f""",
hashes AS (
  SELECT md5({" || ".join(_marked_sql(c) for c in ("product_id", "day", "MENGE", "l_returnflag"))}) AS h FROM lines),
buckets AS (
  SELECT substr(h, 1, 3) AS bucket, count(*) AS n, {", ".join(_lane_sql(i) for i in range(4))}
  FROM hashes GROUP BY bucket)
SELECT md5(string_agg(bucket || ':' || n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3, ','
           ORDER BY bucket)) AS fingerprint
FROM buckets"""
)


@query("q8_content_fingerprint", FINGERPRINT)
def q8(spark, sf):
    columns = ["product_id", "MONAT", "MENGE", "l_returnflag"]
    return Q.content_fingerprint(sales_lines(spark, sf), columns)


@query("q8_fingerprint_of_arrivals", FINGERPRINT)
def q8_arrivals(spark, sf):
    """Sums kept for the lines before a date, and those of the lines since, give the fingerprint of all."""
    columns = ["product_id", "MONAT", "MENGE", "l_returnflag"]
    lines, later = sales_lines(spark, sf), F.col("MONAT") >= F.lit(SNAPSHOT_END).cast("date")
    kept = materialize(Q.fingerprint_sums(lines.where(~later), columns), "sums")
    return Q.fingerprint_of(Q.added_sums(kept.unionByName(Q.fingerprint_sums(lines.where(later), columns))))


@query(
    "q9_snapshot_freshness",
    """
SELECT CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS newest,
       max(o_orderdate) >= TIMESTAMP '2001-08-05 00:00:00' - INTERVAL 7 DAY AS is_fresh
FROM orders""",
)
def q9(spark, sf):
    """Order dates stand in for the training dates of a snapshot log."""
    log = table(spark, sf, "orders").select(F.col("o_orderdate").alias("training_date"))
    as_of = F.lit("2001-08-05").cast("timestamp_ntz")
    return shown(snapshot_freshness(log, as_of), dates=("newest",))

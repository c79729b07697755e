"""Queries: files written from the tables and read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from monthcast import settings as S
from monthcast.catalogue.registry import (
    FACT,
    descriptions,
    fact,
    master,
    product_key,
    query,
    rnd,
    sales_lines,
    shown,
    supplier_regions,
    table,
)
from monthcast.catalogue.reports import EXPORT, REGIONAL, level_forecast, written_months
from monthcast.functions.skew import salted_lookup
from monthcast.plans.forecasts import export_all
from monthcast.session import scratch_path
from monthcast.sources import exports, sales
from monthcast.sources.snapshots import SnapshotStore


# Headers of the regional files: columns in any order, further ones, and the monthly names.
HEADERS = {
    "F01": ("product_id", "product_category_id", "MONAT", "MENGE", "PREIS"),
    "F02": ("MONAT", "PREIS", "note", "MENGE", "product_id", "product_category_id"),
    "F03": ("product_id", "product_category_id", "MONAT", "anz_produkt", "unit_preis"),
    "F04": ("note", "MENGE", "MONAT", "PREIS", "product_id"),
}


def write_regional_files(spark, sf) -> str:
    """The sales lines as regional CSV folders below a scratch root."""
    root = scratch_path(spark, "regional")
    lines = salted_lookup(
        sales_lines(spark, sf), supplier_regions(spark, sf), ["l_suppkey"], ["product_id", "MONAT"], how="inner"
    )
    lines = lines.select(
        "product_id",
        F.concat(F.lit("file "), F.substring("product_id", -1, 1)).alias("product_category_id"),
        F.col("MONAT").cast("string").alias("MONAT"),
        "MENGE",
        "PREIS",
        F.col("MENGE").alias("anz_produkt"),
        F.col("PREIS").alias("unit_preis"),
        F.lit("7,5").alias("note"),
        "region",
    )
    for region, header in HEADERS.items():
        lines.where(F.col("region") == region).select(*header).write.csv(f"{root}/CSV={region}", header=True)
    return root


FOLDER = "/CSV=(F[0-9]{2})/"


def regional_sales(spark, sf):
    root = write_regional_files(spark, sf)
    paths = [f"{root}/CSV={r}" for r in S.REGIONS]
    return sales.read_regional_sales(spark, paths, region_pattern=FOLDER)


@query(
    "s1_regional_sales_scan",
    REGIONAL
    + f"""
SELECT product_id, region, CAST(day AS VARCHAR) AS MONAT, MENGE, {rnd("PREIS", 5)} AS "PREIS" FROM regional""",
)
def s1(spark, sf):
    df = regional_sales(spark, sf).select("product_id", "region", "MONAT", "MENGE", "PREIS")
    return shown(df, dates=())


@query(
    "s1_monthly_by_region",
    REGIONAL
    + f"""
SELECT product_id, region, CAST(MONAT AS VARCHAR) AS MONAT, sum(MENGE) AS anz_produkt,
       {rnd("avg(PREIS)", 5)} AS unit_preis
FROM regional GROUP BY product_id, region, MONAT""",
)
def s1_monthly(spark, sf):
    return shown(sales.monthly_by_region(regional_sales(spark, sf)))


@query(
    "s2_integrated_dataset",
    REGIONAL
    + f""",
named AS (
  SELECT product_id, min('file ' || right(product_id, 1)) FILTER (region <> 'F04') AS own FROM regional GROUP BY product_id),
joined AS (
  SELECT r.product_id, p.p_brand, r.MONAT, r.MENGE, r.PREIS FROM regional r
  LEFT JOIN part p ON printf('A%07d', p.p_partkey) = r.product_id AND p.p_brand <> 'Brand#3')
SELECT product_id, coalesce(min(p_brand), min(own)) AS product_category_id, CAST(MONAT AS VARCHAR) AS MONAT,
       sum(MENGE) AS anz_produkt, {rnd("avg(PREIS)", 5)} AS unit_preis
FROM joined JOIN named USING (product_id) GROUP BY product_id, MONAT""",
)
def s2(spark, sf):
    """Regional files and an article master file that lacks one brand, read and integrated."""
    path = scratch_path(spark, "master")
    master(spark, sf).where(F.col("product_category_id") != "Brand#3").select(
        F.concat(F.lit(" "), "product_id").alias("BANUMMER"), F.col("product_category_id").alias("WARENGR")
    ).write.csv(path, header=True)
    return shown(
        sales.integrated_dataset(regional_sales(spark, sf), sales.read_article_master(spark, path))
    )


@query(
    "s3_description_scan",
    """
SELECT printf('A%07d', p_partkey) AS "NUMMER", p_name || ' groß' AS "BANAME1"
FROM part WHERE p_name IS NOT NULL AND p_size > 3""",
)
def s3(spark, sf):
    """Latin-1 text with padding, incomplete rows, and columns in another order."""
    path = scratch_path(spark, "descriptions")
    table(spark, sf, "part").select(
        F.col("p_size").alias("ID"),
        F.when(F.col("p_size") > 3, F.concat(F.lit("  "), "p_name", F.lit(" groß "))).alias("BANAME1"),
        F.col("p_type").alias("BANAME2"),
        F.concat(F.lit(" "), product_key("p_partkey"), F.lit(" ")).alias("NUMMER"),
    ).write.option("encoding", "ISO-8859-1").csv(path, header=True)
    return sales.read_descriptions(spark, path)


@query(
    "s3_last_description_wins",
    """
SELECT CAST(p_size AS VARCHAR) AS "NUMMER", arg_max(p_name, p_partkey) AS "BANAME1" FROM part GROUP BY p_size""",
)
def s3_last(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_size").cast("string").alias("NUMMER"), F.col("p_name").alias("BANAME1"), "p_partkey"
    )
    return sales.latest_descriptions(raw, "p_partkey")


def written_snapshot(spark, sf) -> tuple[SnapshotStore, int]:
    store = SnapshotStore(spark, scratch_path(spark, "store"))
    version = store.next_version()
    store.write_part(version, "base", fact(spark, sf))
    store.commit(version, datetime(2001, 12, 1), S.MODEL_FEATURES, {"global_model": 1})
    return store, version


@query(
    "s4_snapshot_write",
    FACT
    + f"""
SELECT CAST(1 AS BIGINT) AS version, count(DISTINCT product_id) AS num_products, count(*) AS num_records,
       CAST(min(MONAT) AS VARCHAR) AS first_month, CAST(max(MONAT) AS VARCHAR) AS last_month,
       CAST({len(S.MODEL_FEATURES)} AS INTEGER) AS features, CAST(1 AS BIGINT) AS global_model
FROM fact""",
)
def s4(spark, sf):
    store, _ = written_snapshot(spark, sf)
    log = store.log().select(
        "version",
        "num_products",
        "num_records",
        F.col("date_range.start").alias("first_month"),
        F.col("date_range.end").alias("last_month"),
        F.size("feature_columns").alias("features"),
        F.col("model_counts.global_model").alias("global_model"),
    )
    return shown(log, dates=("first_month", "last_month"))


@query(
    "s5_snapshot_read",
    FACT
    + f"""
SELECT product_id, product_category_id, CAST(MONAT AS VARCHAR) AS MONAT, anz_produkt,
       {rnd("unit_preis", 5)} AS unit_preis
FROM fact""",
)
def s5(spark, sf):
    store, version = written_snapshot(spark, sf)
    return shown(store.read_part("base", version, S.SALES_MONTH))


EXPORT_SCHEMA = (
    "Month string, Sales_Volume double, Data_Type string, Product_ID string, Product_Name string, "
    "Stamm_Product string"
)


@query("s6_analysis_export", EXPORT + "SELECT * FROM export")
def s6(spark, sf):
    path = scratch_path(spark, "export")
    months = written_months(spark, sf)
    rows = export_all(months, level_forecast(months), descriptions(spark, sf))
    exports.write_export(rows, path)
    return shown(spark.read.schema(EXPORT_SCHEMA).csv(path, header=True))

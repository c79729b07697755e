"""Queries: joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthcast.catalogue.registry import (
    DESCRIPTIONS,
    FACT,
    SNAPSHOT,
    UNCATEGORIZED,
    VARIANTS,
    descriptions,
    fact,
    query,
    rnd,
    shown,
    snapshot,
    uncategorized_fact,
    variants,
)
from monthcast.operators import merge
from monthcast.operators.ensemble import most_specific
from monthcast.operators.search import with_product_names
from monthcast.operators.series import join_calendar, year_over_year_join
from monthcast.plans.build import updated_base


@query(
    "j1_new_records",
    SNAPSHOT
    + f"""
SELECT f.product_id, CAST(f.MONAT AS VARCHAR) AS MONAT, f.anz_produkt, {rnd("f.unit_preis", 5)} AS unit_preis
FROM fact f LEFT JOIN snapshot s ON f.product_id = s.product_id AND f.MONAT = s.MONAT
WHERE s.product_id IS NULL""",
)
def j1(spark, sf):
    df = merge.new_records(fact(spark, sf), snapshot(spark, sf))
    return shown(df.select("product_id", "MONAT", "anz_produkt", "unit_preis"))


MERGED = SNAPSHOT + """,
merged AS (
  SELECT product_id, MONAT, anz_produkt + 1000 AS anz_produkt FROM snapshot
  UNION ALL
  SELECT product_id, MONAT, anz_produkt FROM fact
  WHERE (product_id, MONAT) NOT IN (SELECT (product_id, MONAT) FROM snapshot))"""


@query(
    "j2_delta_merge",
    MERGED + "SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, anz_produkt FROM merged",
)
def j2(spark, sf):
    """The snapshot's own values differ, so it shows which side won."""
    columns = ["product_id", "MONAT", "anz_produkt"]
    old = snapshot(spark, sf).withColumn("anz_produkt", F.col("anz_produkt") + 1000)
    return shown(merge.merge_first_wins(old.select(columns), fact(spark, sf).select(columns)))


@query(
    "j2_updated_base",
    FACT
    + f"""
SELECT product_id, product_category_id, CAST(MONAT AS VARCHAR) AS MONAT, anz_produkt,
       {rnd("unit_preis", 5)} AS unit_preis
FROM fact""",
)
def j2_base(spark, sf):
    return shown(updated_base(snapshot(spark, sf), fact(spark, sf)))


@query(
    "j3_new_products",
    SNAPSHOT
    + """
SELECT DISTINCT product_id FROM fact WHERE product_id NOT IN (SELECT product_id FROM snapshot)""",
)
def j3(spark, sf):
    return merge.new_products(fact(spark, sf), snapshot(spark, sf))


@query(
    "j4_calendar_join",
    FACT
    + """,
calendar AS (
  SELECT product_id, CAST(unnest(generate_series(min(MONAT), max(MONAT), INTERVAL 1 MONTH)) AS DATE) AS MONAT
  FROM fact GROUP BY product_id)
SELECT c.product_id, CAST(c.MONAT AS VARCHAR) AS MONAT, f.anz_produkt
FROM calendar c LEFT JOIN fact f ON f.product_id = c.product_id AND f.MONAT = c.MONAT""",
)
def j4(spark, sf):
    return shown(join_calendar(fact(spark, sf).select("product_id", "MONAT", "anz_produkt")))


@query(
    "j5_year_over_year_join",
    FACT
    + """
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, anz_produkt,
       max(anz_produkt) OVER (PARTITION BY product_id ORDER BY MONAT
         RANGE BETWEEN INTERVAL 1 YEAR PRECEDING AND INTERVAL 1 YEAR PRECEDING) AS last_year_sales
FROM fact""",
)
def j5(spark, sf):
    return shown(year_over_year_join(fact(spark, sf).select("product_id", "MONAT", "anz_produkt")))


@query(
    "j6_description_lookup",
    f"""
WITH {VARIANTS}, {DESCRIPTIONS}
SELECT product_id, substr(product_id, 1, 8) AS stem, BANAME1 AS product_name
FROM variants LEFT JOIN names ON NUMMER = substr(product_id, 1, 8)""",
)
def j6(spark, sf):
    return with_product_names(variants(spark, sf).select("product_id"), descriptions(spark, sf))


@query(
    "j7_model_level",
    UNCATEGORIZED
    + """,
products AS (SELECT product_id FROM loose GROUP BY product_id HAVING count(*) >= 6),
categories AS (
  SELECT product_category_id FROM loose WHERE product_category_id IS NOT NULL
  GROUP BY product_category_id HAVING count(*) >= 6)
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT,
       CASE WHEN product_id IN (SELECT * FROM products) THEN 'product'
            WHEN product_category_id IN (SELECT * FROM categories) THEN 'category' ELSE 'global' END
         AS model_level,
       CASE WHEN product_id IN (SELECT * FROM products) THEN product_id
            WHEN product_category_id IN (SELECT * FROM categories) THEN product_category_id ELSE 'all' END
         AS model_key
FROM loose""",
)
def j7(spark, sf):
    rows = uncategorized_fact(spark, sf)

    def keys(level, column, least):
        counted = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        return counted.where(F.col("n") >= least).select(F.lit(level).alias("level"), F.col(column).alias("key"))

    overall = rows.agg(F.count("*").alias("n")).select(F.lit("global").alias("level"), F.lit("all").alias("key"))
    models = keys("product", "product_id", 6).unionByName(keys("category", "product_category_id", 6))
    df = most_specific(rows, models.unionByName(overall))
    return shown(df.select("product_id", "MONAT", "model_level", "model_key"))

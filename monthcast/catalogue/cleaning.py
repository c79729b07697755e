"""Queries: cleaning, outliers, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthcast.catalogue.registry import (
    DESCRIPTIONS,
    FACT,
    LINES,
    SPARSE,
    VARIANTS,
    descriptions,
    fact,
    product_key,
    query,
    rnd,
    sales_lines,
    shown,
    sparse_fact,
    table,
    variants,
)
from monthcast.functions.scalars import index_stem, product_stem
from monthcast.operators import cleaning as C
from monthcast.operators import search
from monthcast.operators.outliers import filter_outliers
from monthcast.sources.sales import integrated_dataset

COVID = ("1998-01-01", "1998-12-31")


@query("c1_product_id_normalized", "SELECT printf('A%07d', p_partkey) AS product_id, p_size FROM part")
def c1(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit(" \t"), product_key("p_partkey"), F.lit("\n  "))
    return C.normalize_product_id(table(spark, sf, "part").select(padded.alias("product_id"), "p_size"))


@query("c2_stock_article_id", f"WITH {VARIANTS} SELECT art_nr, groesse, farbe, product_id FROM variants")
def c2(spark, sf):
    return variants(spark, sf)


@query(
    "c3_covid_flag",
    FACT
    + """
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT,
       MONAT BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AS is_covid FROM fact""",
)
def c3(spark, sf):
    df = fact(spark, sf).withColumn("is_covid", C.covid_flag("MONAT", *COVID))
    return shown(df.select("product_id", "MONAT", "is_covid"))


@query(
    "c4_covid_normalized_sales",
    FACT
    + f"""
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT,
       {rnd("CASE WHEN MONAT BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' THEN anz_produkt / 0.8 ELSE anz_produkt END")}
         AS normalized
FROM fact""",
)
def c4(spark, sf):
    df = fact(spark, sf).withColumn("is_covid", C.covid_flag("MONAT", *COVID))
    normalized = C.covid_normalized("anz_produkt", "is_covid").alias("normalized")
    return shown(df.select("product_id", "MONAT", normalized))


@query(
    "c5_stock_outs",
    SPARSE
    + """
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, anz_produkt,
       coalesce(anz_produkt = 0 AND k = 3 AND around > overall * 0.05, false) AS stock_out
FROM (SELECT *, avg(anz_produkt) OVER w3 AS around, count(*) OVER w3 AS k,
             avg(anz_produkt) OVER (PARTITION BY product_id) AS overall
      FROM sparse
      WINDOW w3 AS (PARTITION BY product_id ORDER BY MONAT ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))""",
)
def c5(spark, sf):
    df = C.detect_stock_outs(sparse_fact(spark, sf))
    return shown(df.select("product_id", "MONAT", "anz_produkt", "stock_out"))


@query(
    "c5_stock_outs_from_stock",
    FACT
    + """
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, anz_produkt - 10 <= 0 AS stock_out FROM fact""",
)
def c5_stock(spark, sf):
    df = fact(spark, sf).withColumn("stock", F.col("anz_produkt") - 10)
    return shown(C.detect_stock_outs(df, stock="stock").select("product_id", "MONAT", "stock_out"))


@query(
    "c6_price_changes",
    SPARSE
    + """,
known AS (
  SELECT product_id, MONAT, last_value(unit_preis IGNORE NULLS) OVER (
           PARTITION BY product_id ORDER BY MONAT ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p
  FROM sparse),
pairs AS (SELECT *, lag(p) OVER (PARTITION BY product_id ORDER BY MONAT) AS q FROM known)
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT,
       coalesce(CASE WHEN q = 0 THEN p <> 0 ELSE abs(p / q - 1) > 0.1 END, false) AS price_change
FROM pairs""",
)
def c6(spark, sf):
    df = C.detect_price_changes(sparse_fact(spark, sf))
    return shown(df.select("product_id", "MONAT", "price_change"))


RAW_CATEGORY = """CASE WHEN p_size <= 5 THEN ' none ' WHEN p_size <= 8 THEN '  '
     WHEN p_size <= 11 THEN 'NaN' ELSE concat('  ', lower(p_brand), ' ') END"""


@query(
    "c7_clean_categories",
    """
SELECT printf('A%07d', p_partkey) AS product_id,
       CASE WHEN p_size > 11 THEN upper(p_brand) END AS category, upper(p_type) AS kind
FROM part""",
)
def c7(spark, sf):
    df = table(spark, sf, "part").select(
        product_key("p_partkey").alias("product_id"),
        F.expr(RAW_CATEGORY).alias("category"),
        F.lower("p_type").alias("kind"),
    )
    return C.clean_categories(df, ["category", "kind", "not there"])


@query(
    "c8_aggregate_sales",
    LINES
    + f"""
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT,
       coalesce(sum(CASE WHEN l_linestatus = 'F' OR l_linenumber > 2 THEN MENGE END), 0.0) AS anz_produkt,
       {rnd("avg(PREIS)", 5)} AS unit_preis
FROM lines WHERE l_linenumber <> 7 AND l_returnflag <> 'R' GROUP BY product_id, MONAT""",
)
def c8(spark, sf):
    """Raw lines with unreadable dates, unknown products and unknown quantities."""
    raw = sales_lines(spark, sf).select(
        F.when(F.col("l_returnflag") != "R", F.col("product_id")).alias("product_id"),
        F.when(F.col("l_linenumber") == 7, F.lit("not a date"))
        .otherwise(F.col("MONAT").cast("string"))
        .alias("MONAT"),
        F.when((F.col("l_linestatus") == "F") | (F.col("l_linenumber") > 2), F.col("MENGE")).alias("MENGE"),
        "PREIS",
    )
    return shown(C.aggregate_sales(raw, ["product_id"]))


def text_dates(spark, sf):
    """Sales lines whose dates are text in four forms, and in one that names no day."""
    form = {2: "dd.MM.yyyy", 3: "yyyyMMdd", 4: "yyyy/MM/dd", 5: "MMMM"}
    text = F.date_format("MONAT", "yyyy-MM-dd")
    for line, pattern in form.items():
        text = F.when(F.col("l_linenumber") == line, F.date_format("MONAT", pattern)).otherwise(text)
    return sales_lines(spark, sf).withColumn("MONAT", F.when(F.col("l_linenumber") != 6, text))


@query(
    "c8_text_dates",
    LINES
    + f"""
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, sum(MENGE) AS anz_produkt, {rnd("avg(PREIS)", 5)} AS unit_preis
FROM lines WHERE l_linenumber NOT IN (5, 6) GROUP BY product_id, MONAT""",
)
def c8_text(spark, sf):
    return shown(integrated_dataset(text_dates(spark, sf), None, ("dd.MM.yyyy", "yyyyMMdd", "yyyy/MM/dd")))


@query(
    "c8_unreadable_dates",
    LINES
    + """
SELECT count(*) AS rows, count_if(l_linenumber = 6) AS without_date, count_if(l_linenumber = 5) AS unreadable FROM lines""",
)
def c8_unreadable(spark, sf):
    return C.unreadable_dates(text_dates(spark, sf))


@query(
    "c9_outliers_iqr",
    FACT
    + f"""
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, anz_produkt, {rnd("unit_preis", 5)} AS unit_preis
FROM fact, (SELECT quantile_cont(anz_produkt, 0.25) AS q1, quantile_cont(anz_produkt, 0.75) AS q3 FROM fact)
WHERE anz_produkt BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
)
def c9(spark, sf):
    df = filter_outliers(fact(spark, sf), "anz_produkt")
    return shown(df.select("product_id", "MONAT", "anz_produkt", "unit_preis"))


@query(
    "c9_outliers_iqr_per_category",
    FACT
    + f"""
SELECT f.product_id, CAST(f.MONAT AS VARCHAR) AS MONAT, f.anz_produkt, {rnd("f.unit_preis", 5)} AS unit_preis
FROM fact f JOIN (
  SELECT product_category_id, quantile_cont(unit_preis, 0.25) AS q1, quantile_cont(unit_preis, 0.75) AS q3
  FROM fact GROUP BY product_category_id) q ON f.product_category_id = q.product_category_id
WHERE f.unit_preis BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)""",
)
def c9_category(spark, sf):
    df = filter_outliers(fact(spark, sf), "unit_preis", factor=0.5, keys=["product_category_id"])
    return shown(df.select("product_id", "MONAT", "anz_produkt", "unit_preis"))


@query(
    "c10_outliers_zscore",
    FACT
    + """
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, anz_produkt
FROM fact
WHERE abs((anz_produkt - (SELECT avg(anz_produkt) FROM fact)) / (SELECT stddev_samp(anz_produkt) FROM fact)) <= 2""",
)
def c10(spark, sf):
    df = filter_outliers(fact(spark, sf), "anz_produkt", "zscore", 2)
    return shown(df.select("product_id", "MONAT", "anz_produkt"))


@query(
    "c10_outliers_zscore_per_product",
    FACT
    + """
SELECT f.product_id, CAST(f.MONAT AS VARCHAR) AS MONAT, f.anz_produkt
FROM fact f JOIN (SELECT product_id, avg(anz_produkt) AS m, stddev_samp(anz_produkt) AS s
                  FROM fact GROUP BY product_id) q ON f.product_id = q.product_id
WHERE s > 0 AND abs((anz_produkt - m) / s) <= 1.5""",
)
def c10_product(spark, sf):
    df = filter_outliers(fact(spark, sf), "anz_produkt", "zscore", 1.5, keys=["product_id"], salts=1)
    return shown(df.select("product_id", "MONAT", "anz_produkt"))


@query(
    "c11_product_stem",
    f"""
WITH {VARIANTS}
SELECT product_id, trim(substr(product_id, 1, 8)) AS stem, trim(substr(product_id, 1, 8)) AS index_stem,
       groesse AS short_id, groesse AS short_stem
FROM variants""",
)
def c11(spark, sf):
    """Stem of long ids, and of ids too short to have one."""
    return variants(spark, sf).select(
        "product_id",
        product_stem("product_id").alias("stem"),
        index_stem("product_id").alias("index_stem"),
        F.col("groesse").alias("short_id"),
        product_stem("groesse").alias("short_stem"),
    )


@query(
    "c12_product_labels",
    f"""
WITH {VARIANTS}, {DESCRIPTIONS}
SELECT v.product_id,
       CASE WHEN BANAME1 IS NULL THEN v.product_id
            ELSE CASE WHEN length(BANAME1) > 50 THEN substr(BANAME1, 1, 47) || '...' ELSE BANAME1 END
                 || ' (' || v.product_id || ')' END AS label
FROM variants v LEFT JOIN names ON NUMMER = substr(v.product_id, 1, 8)""",
)
def c12(spark, sf):
    labels = search.product_labels(variants(spark, sf).select("product_id"), descriptions(spark, sf))
    return labels.select("product_id", "label")


TERM = """
concat(' ', lower(CASE
  WHEN p_size <= 20 THEN substring(key, 1, 2 + p_size % 7)
  WHEN p_size <= 30 THEN concat(key, left(CAST(p_size AS VARCHAR(9)), 1))
  WHEN p_size <= 40 THEN concat(key, p_size, '  R')
  ELSE concat('B', substring(key, 2, 7)) END), '  ')"""


def terms(spark, sf):
    """Search texts of every kind: prefixes, whole ids, partial long ids, misses."""
    part = table(spark, sf, "part").withColumn("key", product_key("p_partkey"))
    return part.select(F.expr(TERM).alias("term")).distinct()


TERMS_SQL = f"""
terms AS (SELECT DISTINCT {TERM} AS term FROM (SELECT *, printf('A%07d', p_partkey) AS key FROM part)),
needles AS (SELECT term, upper(trim(term)) AS needle FROM terms),
ids AS (SELECT DISTINCT product_id FROM variants),
hits AS (
  SELECT term, min(product_id) AS product_id FROM needles JOIN ids ON starts_with(product_id, needle)
  WHERE length(needle) <= 8 GROUP BY term
  UNION ALL
  SELECT term, product_id FROM needles JOIN ids ON product_id = needle WHERE length(needle) > 8)"""


@query(
    "c13_product_search",
    f"WITH {VARIANTS}, {TERMS_SQL} SELECT term, product_id FROM needles LEFT JOIN hits USING (term)",
)
def c13(spark, sf):
    return search.search_products(search.product_index(variants(spark, sf)), terms(spark, sf))


@query(
    "c14_search_suggestions",
    f"""
WITH {VARIANTS}, {TERMS_SQL}
SELECT term, position, product_id FROM (
  SELECT term, product_id, row_number() OVER (PARTITION BY term ORDER BY product_id) AS position
  FROM needles JOIN ids ON starts_with(product_id, needle)
  WHERE term NOT IN (SELECT term FROM hits) AND length(term) >= 3)
WHERE position <= 5""",
)
def c14(spark, sf):
    return search.suggest_products(search.product_index(variants(spark, sf)), terms(spark, sf))


@query(
    "c15_product_filter",
    FACT
    + f"""
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, anz_produkt, {rnd("unit_preis", 5)} AS unit_preis
FROM fact WHERE product_id = 'A0000042'""",
)
def c15(spark, sf):
    df = search.product_rows(fact(spark, sf), "A0000042")
    return shown(df.select("product_id", "MONAT", "anz_produkt", "unit_preis"))


@query(
    "c16_product_index",
    f"WITH {VARIANTS} SELECT DISTINCT product_id, trim(substr(product_id, 1, 8)) AS stem FROM variants",
)
def c16(spark, sf):
    return search.product_index(variants(spark, sf))


@query(
    "c16_distinct_stems",
    f"WITH {VARIANTS} SELECT DISTINCT trim(substr(product_id, 1, 8)) AS stem FROM variants",
)
def c16_stems(spark, sf):
    return search.distinct_stems(variants(spark, sf))

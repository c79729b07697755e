"""Registration of queries and their SQL, and the shared input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthcast.functions.scalars import half_up, stock_article_id
from monthcast.operators.series import fill_month_gaps
from monthcast.sources.sales import integrated_dataset

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


def rnd(expression: str, digits: int = 4) -> str:
    """SQL form of ``half_up``."""
    return f"floor(({expression}) * 1e{digits} + 0.5) / 1e{digits}"


def day(c: Column | str = "MONAT") -> Column:
    """Dates leave the queries as ISO text, alike in both engines."""
    return F.date_format(c, "yyyy-MM-dd")


# Mean prices end in halves of the fourth decimal, where the order of a sum shows.
PRICES = dict.fromkeys(("unit_preis", "PREIS", "last_price", "price_rolling_mean_3"), 5)


def shown(df: DataFrame, digits: int = 4, dates: tuple[str, ...] = ("MONAT",), **rounding: int) -> DataFrame:
    """Result form: dates as text, doubles rounded."""
    out = []
    for name, kind in df.dtypes:
        if name in dates:
            out.append(day(name).alias(name))
        elif kind == "double":
            out.append(half_up(name, ({**PRICES, **rounding}).get(name, digits)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


# --- the supplied tables as sales tables ---------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def product_key(part: str) -> Column:
    """'A' and the part number, padded to seven digits and never cut."""
    text = F.col(part).cast("string")
    return F.concat(F.lit("A"), F.lpad(text, F.greatest(F.lit(7), F.length(text)), F.lit("0")))


def sales_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        product_key("l_partkey").alias("product_id"),
        F.col("l_shipdate").cast("date").alias("MONAT"),
        F.col("l_quantity").alias("MENGE"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("PREIS"),
        "l_suppkey",
        "l_linenumber",
        "l_returnflag",
        "l_linestatus",
    )


def supplier_regions(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    region = F.concat(F.lit("F0"), (F.col("n_regionkey") % 4 + 1).cast("string"))
    return (
        table(spark, sf, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), region.alias("region"))
    )


def master(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        product_key("p_partkey").alias("product_id"), F.col("p_brand").alias("product_category_id")
    )


def fact(spark: SparkSession, sf: str) -> DataFrame:
    return integrated_dataset(sales_lines(spark, sf), master(spark, sf))


def descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Names by product; a few long ones, and none for one product type."""
    name = F.when(
        F.col("p_size") > 40, F.concat_ws(" ", "p_name", "p_type", "p_brand", F.lit("in a large outer package"))
    ).otherwise(F.col("p_name"))
    return (
        table(spark, sf, "part")
        .where(F.col("p_type") != "SMALL")
        .select(product_key("p_partkey").alias("NUMMER"), name.alias("BANAME1"))
    )


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """Stock articles: product x size x colour, with their component columns."""
    colours = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag").distinct()
    size = F.when(F.col("p_size") > 45, F.concat(F.lit("SIZE"), "p_size")).otherwise(
        F.col("p_size").cast("string")
    )
    return (
        colours.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            product_key("p_partkey").alias("art_nr"),
            size.alias("groesse"),
            F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("farbe"),
        )
        .withColumn("product_id", stock_article_id("art_nr", "groesse", "farbe"))
    )


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """The fact without categories, which the forecasts do not need."""
    return integrated_dataset(sales_lines(spark, sf), None)


def filled(spark: SparkSession, sf: str) -> DataFrame:
    return fill_month_gaps(monthly(spark, sf))


def sparse_fact(spark: SparkSession, sf: str) -> DataFrame:
    """The fact with months of no sales and unknown or zero prices worked in."""
    last = F.substring("product_id", -1, 1)
    month = F.month("MONAT")
    return (
        fact(spark, sf)
        .withColumn("anz_produkt", F.when((month == 8) & (last == "7"), 0.0).otherwise(F.col("anz_produkt")))
        .withColumn(
            "unit_preis",
            F.when((month == 2) & (last == "3"), None)
            .when((month == 3) & (last == "3"), 0.0)
            .otherwise(F.col("unit_preis")),
        )
    )


# Products whose series end early, by the end of their id: too short for a
# model of their own, and for a calendar profile.
ENDS = {"01": "1995-06-01", "51": "1996-02-01"}


def shortened(df: DataFrame) -> DataFrame:
    kept = F.lit(True)
    for digits, end in ENDS.items():
        kept = kept & ((F.substring("product_id", -2, 2) != digits) | (F.col("MONAT") < F.lit(end).cast("date")))
    return df.where(kept)


def uncategorized_fact(spark: SparkSession, sf: str) -> DataFrame:
    """The fact with one category unknown and some series cut short."""
    return shortened(fact(spark, sf)).withColumn(
        "product_category_id",
        F.when(F.col("product_category_id") != "Brand#3", F.col("product_category_id")),
    )


# Snapshot: months before 2001 of every category but one, which is new.
SNAPSHOT_END = "2001-01-01"
NEW_CATEGORY = "Brand#7"


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return fact(spark, sf).where(
        (F.col("MONAT") < F.lit(SNAPSHOT_END).cast("date")) & (F.col("product_category_id") != NEW_CATEGORY)
    )


# --- the same in SQL ---------------------------------------------------------------

LINES = """
WITH lines AS (
  SELECT printf('A%07d', l_partkey) AS product_id,
         CAST(l_shipdate AS DATE) AS day,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS MONAT,
         l_quantity AS MENGE, l_extendedprice / l_quantity AS PREIS,
         l_suppkey, l_linenumber, l_returnflag, l_linestatus
  FROM lineitem)"""

FACT = LINES + """,
monthly AS (
  SELECT product_id, MONAT, sum(MENGE) AS anz_produkt, avg(PREIS) AS unit_preis
  FROM lines GROUP BY product_id, MONAT),
fact AS (
  SELECT m.product_id, p.p_brand AS product_category_id, m.MONAT, m.anz_produkt, m.unit_preis
  FROM monthly m LEFT JOIN part p ON printf('A%07d', p.p_partkey) = m.product_id)"""

FILLED = FACT + """,
span AS (SELECT product_id, min(MONAT) AS a, max(MONAT) AS b FROM fact GROUP BY product_id),
calendar AS (
  SELECT product_id, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS MONAT FROM span),
filled AS (
  SELECT c.product_id, c.MONAT,
         last_value(f.anz_produkt IGNORE NULLS) OVER (PARTITION BY c.product_id ORDER BY c.MONAT
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x
  FROM calendar c LEFT JOIN fact f ON f.product_id = c.product_id AND f.MONAT = c.MONAT),
pos AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY MONAT) - 1 AS t,
         count(*) OVER (PARTITION BY product_id) AS n FROM filled),
steps AS (SELECT unnest(range(6)) AS step)"""

SPARSE = FACT + """,
sparse AS (
  SELECT product_id, product_category_id, MONAT,
         CASE WHEN month(MONAT) = 8 AND right(product_id, 1) = '7' THEN 0.0 ELSE anz_produkt END AS anz_produkt,
         CASE WHEN month(MONAT) = 2 AND right(product_id, 1) = '3' THEN NULL
              WHEN month(MONAT) = 3 AND right(product_id, 1) = '3' THEN 0.0 ELSE unit_preis END AS unit_preis
  FROM fact)"""

SHORTENED = FACT + f""",
short AS (
  SELECT * FROM fact WHERE {" AND ".join(f"(right(product_id, 2) <> '{d}' OR MONAT < DATE '{e}')" for d, e in ENDS.items())})"""

UNCATEGORIZED = SHORTENED + """,
loose AS (
  SELECT product_id, CASE WHEN product_category_id <> 'Brand#3' THEN product_category_id END
           AS product_category_id, MONAT, anz_produkt, unit_preis
  FROM short)"""

SNAPSHOT = FACT + f""",
snapshot AS (
  SELECT * FROM fact WHERE MONAT < DATE '{SNAPSHOT_END}' AND product_category_id <> '{NEW_CATEGORY}')"""

DESCRIPTIONS = """
names AS (
  SELECT printf('A%07d', p_partkey) AS NUMMER,
         CASE WHEN p_size > 40 THEN p_name || ' ' || p_type || ' ' || p_brand || ' in a large outer package'
              ELSE p_name END AS BANAME1
  FROM part WHERE p_type <> 'SMALL')"""

VARIANTS = """
parts AS (
  SELECT printf('A%07d', p_partkey) AS art_nr,
         CASE WHEN p_size > 45 THEN 'SIZE' || p_size ELSE CAST(p_size AS VARCHAR) END AS groesse,
         CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS farbe
  FROM (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem) JOIN part ON l_partkey = p_partkey),
variants AS (
  SELECT *, trim(
    CASE WHEN length(art_nr) >= 8 THEN art_nr ELSE rpad(art_nr, 8, ' ') END ||
    CASE WHEN length(groesse) >= 4 THEN groesse ELSE rpad(groesse, 4, ' ') END ||
    rpad(coalesce(farbe, ''), 2, ' ')) AS product_id
  FROM parts)"""

"""Regional sales files, article master, descriptions and the integrated dataset."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthcast import settings as S
from monthcast.functions.scalars import strip
from monthcast.operators.cleaning import aggregate_sales, normalize_product_id

REGION_IN_PATH = r"/(F[0-9]{2})/"


def region_paths(root: str, regions: Sequence[str] = S.REGIONS) -> list[str]:
    """``<root>/CSV/<region>/`` and the name of the sales file, of every region."""
    return [f"{root.rstrip('/')}/CSV/{r}/{S.SALES_FILE}" for r in regions]


def _by_name(raw: DataFrame, names: Sequence[str], path: str) -> Column:
    """The first of ``names`` the file has, white space around its header aside; absent ones are an error."""
    found = {c.strip(): c for c in raw.columns}
    for name in names:
        if name in found:
            return F.col(f"`{found[name]}`")
    raise ValueError(f"{path} has no column {' or '.join(names)}")


def read_regional_sales(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType = S.SALES_RAW,
    region_pattern: str = REGION_IN_PATH,
    optional: Sequence[str] = ("product_category_id",),
    **options,
) -> DataFrame:
    """All regional files as one table; the region is read off each file's path.

    Columns are taken by the names in the header of each path, in any order;
    further columns are ignored. Quantity and price may have their monthly
    names. A column that is absent is an error, null if it is ``optional``.
    Files in one folder must have the same header.
    """
    parts = []
    for path in paths:
        raw = spark.read.options(**{"header": True, "enforceSchema": False, **options}).csv(path)
        columns = []
        for field in schema:
            names = S.SALES_COLUMNS.get(field.name, (field.name,))
            if field.name in optional and not {c.strip() for c in raw.columns} & set(names):
                value = F.lit(None)
            else:
                value = _by_name(raw, names, path).try_cast(field.dataType)
            columns.append(value.cast(field.dataType).alias(field.name))
        region = F.regexp_extract(F.col("_metadata.file_path"), region_pattern, 1).alias("region")
        parts.append(raw.select(*columns, region))
    return reduce(DataFrame.unionByName, parts)


def read_article_master(spark: SparkSession, path: str, **options) -> DataFrame:
    """Product group per article: columns product_id and product_category_id."""
    raw = spark.read.options(**{"header": True, **options}).csv(path)
    return raw.select(
        strip("BANUMMER").alias("product_id"), strip("WARENGR").alias("product_category_id")
    )


def read_descriptions(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", **options) -> DataFrame:
    """Product names by number; a file that is not there yields no rows.

    Columns are taken by name. Of several rows for a number the last in file
    order counts: later files, later blocks, later rows.
    """
    options = {"header": True, "enforceSchema": False, "encoding": encoding, **options}
    try:
        raw = spark.read.options(**options).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "NUMMER string, BANAME1 string")
    place = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    )
    named = [_by_name(raw, (c,), path).alias(c) for c in ("NUMMER", "BANAME1")]
    return latest_descriptions(raw.select(*named, place.alias("seq")))


def latest_descriptions(raw: DataFrame, order: str = "seq") -> DataFrame:
    """Complete rows, both texts stripped, the last per number by ``order``."""
    return (
        raw.where(F.col("NUMMER").isNotNull() & F.col("BANAME1").isNotNull())
        .select(strip("NUMMER").alias("NUMMER"), strip("BANAME1").alias("BANAME1"), order)
        .groupBy("NUMMER")
        .agg(F.max_by("BANAME1", order).alias("BANAME1"))
    )


def integrated_dataset(
    sales: DataFrame, master: DataFrame | None, date_formats: tuple[str, ...] = S.DATE_FORMATS
) -> DataFrame:
    """Monthly sales fact: aggregated first, then joined with the article master.

    Aggregating first leaves one row per product and month, so the join sees
    no product with more rows than months. A product the master does not know
    has the least category the sales files name for it.
    """
    own = ["product_category_id"] if "product_category_id" in sales.columns else []
    monthly = aggregate_sales(normalize_product_id(sales), ["product_id"], date_formats=date_formats, least=own)
    if own:
        category = F.min("product_category_id").over(Window.partitionBy("product_id"))
        monthly = monthly.withColumn("product_category_id", category)
    columns = ["product_id", "product_category_id", "MONAT", "anz_produkt", "unit_preis"]
    if master is None:
        return monthly.select(*[c for c in columns if c in monthly.columns])
    groups = master.groupBy("product_id").agg(F.min("product_category_id").alias("_group"))
    known = monthly.join(groups, "product_id", "left")
    category = F.coalesce("_group", *own)
    return known.withColumn("product_category_id", category).select(*columns)


def monthly_by_region(sales: DataFrame, date_formats: tuple[str, ...] = S.DATE_FORMATS) -> DataFrame:
    """Monthly fact that keeps the region, for late regional deliveries."""
    return aggregate_sales(normalize_product_id(sales), ["product_id", "region"], date_formats=date_formats)

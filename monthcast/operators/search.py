"""Product lookup: labels, index, prefix search and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthcast import settings as S
from monthcast.functions.scalars import index_stem, product_stem, strip


def with_product_names(
    products: DataFrame, descriptions: DataFrame, product: str = "product_id"
) -> DataFrame:
    """Columns ``stem`` and ``product_name`` (null without a description)."""
    names = descriptions.select(
        F.col("NUMMER").alias("stem"), F.col("BANAME1").alias("product_name")
    )
    return products.withColumn("stem", product_stem(product)).join(names, "stem", "left")


def product_labels(products: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``name (id)`` per product, long names cut to 47 characters and dots."""
    name = F.col("product_name")
    short = F.when(
        F.length(name) > S.LABEL_LENGTH,
        F.concat(F.substring(name, 1, S.LABEL_LENGTH - 3), F.lit("...")),
    ).otherwise(name)
    label = F.when(name.isNull(), F.col("product_id")).otherwise(
        F.concat(short, F.lit(" ("), F.col("product_id"), F.lit(")"))
    )
    return with_product_names(products, descriptions).withColumn("label", label)


def product_rows(df: DataFrame, product_id: str) -> DataFrame:
    """The rows of one product; the predicate reaches the file scan."""
    return df.where(F.col("product_id") == product_id)


def product_index(df: DataFrame) -> DataFrame:
    """Distinct ids with their stems."""
    return df.select("product_id").distinct().withColumn("stem", index_stem("product_id"))


def distinct_stems(df: DataFrame) -> DataFrame:
    return df.select(index_stem("product_id").alias("stem")).distinct()


def _terms(terms: DataFrame) -> DataFrame:
    return terms.select("term").distinct().withColumn("_needle", F.upper(strip("term")))


def _prefixes(index: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, product_id) for the prefixes of every id, in the lengths that occur among the needles.

    This turns the prefix test into an equal join. A short prefix can cover
    most ids, so rows are reduced to a few per prefix before they meet the
    needles.
    """
    lengths = needles.agg(F.collect_set(F.length("_needle"))).scalar()
    own = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("product_id")))
    cut = index.select("product_id", F.explode(F.array_intersect(lengths, own)).alias("_len"))
    return cut.select(F.expr("substring(product_id, 1, _len)").alias("_needle"), "product_id")


def search_products(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The product each term selects, null where none does.

    Up to eight characters select the first id with that prefix; a longer
    term must be a whole id.
    """
    needles = _terms(terms)
    short = F.length("_needle") <= S.STEM_LENGTH
    first = (
        _prefixes(index, needles.where(short))
        .groupBy("_needle")
        .agg(F.min("product_id").alias("product_id"))
    )
    exact = (
        index.where(F.length("product_id") > S.STEM_LENGTH)
        .select(F.col("product_id").alias("_needle"), "product_id")
        .distinct()
    )
    hits = first.unionByName(exact)
    return needles.join(hits, "_needle", "left").select("term", "product_id")


def suggest_products(
    index: DataFrame, terms: DataFrame, limit: int = S.SUGGESTIONS
) -> DataFrame:
    """First ids with the term as prefix, for terms that select no product."""
    open_terms = (
        search_products(index, terms)
        .where(F.col("product_id").isNull() & (F.length("term") >= S.MIN_SUGGESTION_LENGTH))
        .select("term")
    )
    needles = _terms(open_terms)
    order = Window.partitionBy("_needle").orderBy("product_id")
    ranked = (
        _prefixes(index.select("product_id").distinct(), needles)
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
    )
    return needles.join(ranked, "_needle").select("term", "position", "product_id")

"""Document fingerprints: a Merkle tree over pieces of paragraphs and sections, in SQL functions only."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthcast.llm.tables import partitions

#: A paragraph is a line. A longer one is cut after a space that follows one of these letters, so an edit moves no
#: later cut; a stretch without such a place is cut after MOST code points.
CUTS = "aeost"
MOST = 128
PIECES = rf"[^\n]{{0,{MOST - 2}}}?(?:[{CUTS}] |\n)|[^\n]{{1,{MOST}}}"
#: A section ends after a leaf whose digest starts so: one of 16 leaves, chosen by content.
ENDS = "0"


def leaves(text: Column) -> Column:
    """Digests of the paragraphs in order, long ones in pieces. Empty or null text has none."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(0))
    return F.transform(pieces, lambda p: F.substring(F.md5(p.cast("binary")), 1, 16))


def sections(leaf: Column) -> Column:
    """Digests of runs of leaves, each up to a leaf that ends a section or the last one."""
    places = F.transform(leaf, lambda x, i: F.when(x.startswith(ENDS) | (i == F.size(leaf) - 1), i + 1))
    ends = F.filter(places, lambda i: i.isNotNull())
    starts = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(ends))
    return F.zip_with(starts, ends, lambda s, e: F.sha2(F.array_join(F.slice(leaf, s + 1, e - s), ""), 256))


def root(section: Column) -> Column:
    """The digest of the whole text: equal exactly where texts are."""
    return F.sha2(F.array_join(section, ""), 256)


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct leaves two trees have in common (Dice), 0 to 1; two empty texts are alike."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, 1.0).otherwise(2.0 * both / total)


def differing_sections(section: Column, absent: Column) -> Column:
    """Numbers, from 0, of the sections that are among ``absent``: with those another tree lacks, where the two differ."""
    places = F.transform(section, lambda x, i: F.when(F.array_contains(absent, x), i))
    return F.filter(places, lambda i: i.isNotNull())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, leaves, sections and fingerprint of every row. Null text counts as empty."""
    out = docs.select(F.col(id_col), leaves(F.col(text_col)).alias("leaves"))
    out = out.withColumn("sections", sections(F.col("leaves")))
    return out.withColumn("fingerprint", root(F.col("sections")))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and next_text, the text of the next row in descending order of the id.

    After the last row comes the first. Null ids are last; equal ids stand in
    order of their texts. Rows are cut into ranges of the id at approximate
    quantiles, as many as shuffle partitions, and each range gets one more
    row, the first of the next range; no other row leaves its range.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("id"), text)
    number = F.col("id").cast("double")
    count = max(2, partitions(docs.sparkSession))
    cuts = rows.select(number.alias("n")).approxQuantile("n", [i / count for i in range(1, count)], 0.1 / count)
    ranged = Bucketizer(
        splits=[float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")], inputCol="n", outputCol="range"
    )
    known = ranged.transform(rows.where("id is not null").withColumn("n", number)).drop("n")
    rows = known.union(rows.where("id is null").withColumn("range", F.lit(-1.0)))

    # The first row of each range, and the range it follows; at most one row for each range.
    tops = rows.groupBy("range").agg(F.max("id").alias("top"))
    follows = F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.partitionBy()))
    tops = tops.select(F.col("range").alias("of"), "top", follows.alias("follows"))
    heads = rows.join(F.broadcast(tops), (F.col("range") == F.col("of")) & F.col("id").eqNullSafe(F.col("top")))
    heads = heads.groupBy("follows").agg(F.min("text").alias("text"))
    heads = heads.select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "text", "follows", F.lit(True))

    every = rows.withColumn("head", F.lit(False)).union(heads)
    order = Window.partitionBy("range").orderBy("head", F.col("id").desc_nulls_last(), "text")
    every = every.withColumn("next_text", F.lead("text").over(order))
    return every.where(~F.col("head")).select("id", "text", "next_text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of edited texts, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by
    the first as many, or all, of the next row's text (``with_next``).
    Columns: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_edited_sections (distinct sections of the edited
    text that the original lacks), edited_sections (their numbers in the
    edited text, from 0). Null text counts as empty, and empty texts are alike; a single
    row is its own next. Repeated rows each give a row.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half)
    rows = rows.withColumn("edited", F.concat(kept, F.substring("next_text", F.lit(1), half)))
    rows = rows.select(
        "id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        leaves(F.col("text")).alias("a"),
        leaves(F.col("edited")).alias("b"),
        leaves(F.col("next_text")).alias("c"),
    )
    rows = rows.select(
        "*", sections(F.col("a")).alias("sa"), sections(F.col("b")).alias("sb")
    )
    # A column of its own: inside the function over sections it would be found anew for each.
    rows = rows.withColumn("absent", F.array_except("sb", "sa"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        root(F.col("sa")).alias("fingerprint"),
        root(F.col("sb")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
        F.size("absent").alias("n_edited_sections"),
        differing_sections(F.col("sb"), F.col("absent")).alias("edited_sections"),
    )

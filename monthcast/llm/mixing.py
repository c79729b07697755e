"""Mixing sources to target weights by weighted random order (Efraimidis and Spirakis)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthcast.llm.tables import stored, words_of

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
#: Aim for the rows of one cell, the unit that is sorted in one task.
CELL_ROWS = 2_000


def quality_weight(text: Column) -> Column:
    """A document's weight, 1 for text without mark-up signs, towards 0 the more of them it has a word."""
    text = F.coalesce(text, F.lit(""))
    signs = F.regexp_count(text, F.lit(r"[!$%&#*|]"))
    return (words_of(text) + 1) / (words_of(text) + 1 + 8 * signs)


def uniform(id_: Column, seed: int, text: Column | None = None) -> Column:
    """A number in (0, 1) fixed by id and seed, for a null id by its text: 52 bits of an md5 digest."""
    other = F.lit("") if text is None else F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), other)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets of sources: (source, source_size) to (source, source_size, target).

    The sources, by code point and null last, weigh ``weights`` in turn and
    share the sum of all sizes. A target stops at ``most`` times its source's
    size, and the excess is shared again by weight. Sorted by size for weight,
    the sources that stop are a prefix, so running sums find the shares at
    once. The windows see one row a source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    share = left * F.col("weight") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("stops", F.col("limit") < share)
    free = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("stops"), F.col("limit"))).over(everything), F.lit(0))
    target = F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(rest * F.col("weight") / free)
    return rows.select("source", "source_size", target.alias("target"))


#: Decisions of so many sources at most are sent to all tasks; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def _keys(docs: DataFrame, cells: int, weight: Column | None, id_col: str, text_col: str, source_col: str, seed: int) -> dict[str, Column]:
    """Columns of a document by which it is ordered: id, source, size, key and the cell of the key."""
    id_, text = F.col(id_col), F.col(text_col)
    weight = quality_weight(text) if weight is None else weight
    weight = F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-9))
    key = -F.log(uniform(id_, seed, text)) / weight
    cell = F.least(F.lit(cells - 1), F.floor(key / (key + 1) * cells)).cast("int")
    return {"id": id_, "source": F.col(source_col), "size": words_of(text), "key": key, "cell": cell}


def _cells(docs: DataFrame) -> int:
    return max(64, docs.count() // CELL_ROWS)


def _starts(rows: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """What each cell of a source starts at: (of, at, cell_size, start, source_size, target)."""
    totals = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    in_order = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("cell_size").over(in_order), F.lit(0)))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    return starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("of"), F.col("cell").alias("at"), "cell_size", "start", "source_size", "target"
    )


def _epochs() -> Column:
    whole = F.floor(F.col("target")).cast("long")
    return F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")


def mixed(
    docs: DataFrame,
    weight: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: int = 17,
) -> DataFrame:
    """How often the mix takes each document: id_col, size, source_size, target, taken, epochs, part.

    Size is the number of words. A source goes through all its documents
    ``floor(target / source_size)`` times; what is left of its target is
    filled in the order of the keys -ln(uniform) / weight, and the document
    on the border gives only its first ``part`` words, so a source's taken
    words are its target rounded down. ``taken`` = epochs * size + part.

    Keys follow from id and seed, so reruns agree. A source is cut into cells
    by key / (key + 1), whose running sums give each cell its start; only a
    cell is sorted, whatever share of all rows its source has.

    Null text has size 0, a null source is a source of its own, the key of a
    null id follows from its text. Repeated rows are documents of their
    own. A weight that is null or not above 0 counts as the smallest positive
    weight. Sources of size 0 take nothing. No rows give no rows.
    """
    names = _keys(docs, _cells(docs), weight, id_col, text_col, source_col, seed)
    rows = stored(docs.select(*[c.alias(n) for n, c in names.items()]), "keys")
    starts = _starts(rows, weights, most)
    within = Window.partitionBy("source", "cell").orderBy("key", "id", "size")
    rows = rows.withColumn("before", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at")))
    rest = F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size") - F.col("start") - F.coalesce("before", F.lit(0))
    rows = rows.withColumn("epochs", _epochs())
    rows = rows.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest)))
    return rows.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
        "epochs",
        "part",
    )


def _decisions(rows: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """What decides on every document of a source: its epochs, and the place in its order where the last one ends.

    ``rows`` are documents by source, cell, key, id, size and mark. Only the
    cell on the border is put in order, equal documents as one: ``last`` is
    the border document, ``many`` of its copies count once more and the next
    one gives ``part`` words.
    """
    starts = stored(_starts(rows, weights, most).withColumn("epochs", _epochs()), "starts")
    rest = F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    starts = starts.withColumn("rest", rest)
    border = starts.where((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("cell_size")))
    border = border.select("of", "at", (F.col("rest") - F.col("start")).alias("rest"))
    same = rows.join(border, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at")))
    same = same.groupBy("of", "at", "rest", "key", "id", "size", "mark").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("of").orderBy("key", "id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0)))
    left = F.col("rest") - F.col("before")
    last = same.where((left > 0) & (left <= F.col("size") * F.col("copies"))).select(
        F.col("of").alias("ends"), F.struct(F.col("at").alias("cell"), "key", "id", "size", "mark").alias("last"),
        F.floor(left / F.col("size")).alias("many"), (left % F.col("size")).alias("part"),
    )
    sources = starts.select("of", "epochs").distinct()
    return sources.join(last, F.col("of").eqNullSafe(F.col("ends")), "left").drop("ends")


def repeated(
    docs: DataFrame,
    weight: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: int = 17,
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its source's target asks, all columns as they are.

    Targets, keys and order are those of ``mixed``; documents of one key, id
    and size stand by a hash of all their columns. A document on a source's
    border appears once more with its first ``part`` words joined by one
    space; n_chars, where there is such a column, is that of the shorter
    text. So each source's words come to its target rounded down, whatever
    ids are null or repeated, and reruns agree.

    Every row decides for itself, in the scan, from its source's epochs and
    border document: texts are not shuffled but for the rows that equal the
    border document, which are gathered into one and counted. Null ids,
    sources and texts, repeated rows and no rows are as in ``mixed``.
    Columns may have any names.
    """
    names = docs.columns
    own = _keys(docs, _cells(docs), weight, id_col, text_col, source_col, seed)
    own["mark"] = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in names])
    ends = stored(_decisions(stored(docs.select(*[c.alias(n) for n, c in own.items()]), "keys"), weights, most), "decisions")
    if ends.count() <= BROADCAST_SOURCES:
        ends = F.broadcast(ends)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.struct(*[c.alias(n) for n, c in own.items()]).alias("own"))
    rows = rows.join(ends, F.col("own.source").eqNullSafe(F.col("of")))
    place = F.struct("own.cell", "own.key", "own.id", "own.size", "own.mark")
    times = F.col("epochs") + F.when(place < F.col("last"), 1).otherwise(0)  # a source that ends with an epoch has no last
    whole = rows.where(~place.eqNullSafe(F.col("last"))).select(
        "row", F.explode(F.array_repeat(F.lit(1).cast("long"), times.cast("int"))).alias("copy"), F.lit(None).cast("long").alias("part"),
    )
    equal = rows.where(place.eqNullSafe(F.col("last"))).groupBy("of", "epochs", "many", "part").agg(
        F.count("*").alias("copies"), F.first("row").alias("row")
    )
    total = F.col("epochs") * F.col("copies") + F.col("many") + (F.col("part") > 0).cast("long")
    equal = equal.withColumn("total", total).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "total")))
    equal = equal.select("row", "copy", F.when((F.col("part") > 0) & (F.col("copy") == F.col("total")), F.col("part")).alias("part"))
    both = whole.union(equal)
    words = F.regexp_extract_all(F.col("row")[text_col], F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    short = F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), " ")
    out = []
    for name in names:
        value = F.col("row")[name]
        if name == text_col:
            value = F.when(F.col("part").isNotNull(), short).otherwise(value)
        elif name == "n_chars":
            value = F.when(F.col("part").isNotNull(), F.char_length(short).cast(docs.schema[name].dataType)).otherwise(value)
        out.append(value.alias(name))
    return both.select(*out)

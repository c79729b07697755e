"""Column expressions used across the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from monthcast import settings as S

# Characters that count as white space at either end of a text.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      "
    "          　"
)


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Text without white space at either end (``trim`` only drops blanks)."""
    return F.btrim(as_column(c).cast("string"), F.lit(WHITESPACE))


def pad_right(c: Column | str, width: int) -> Column:
    """Blank-padded to ``width``; longer text is kept whole (``rpad`` cuts it)."""
    c = as_column(c)
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, " "))


def flag(condition: Column) -> Column:
    """A condition whose unknown outcome counts as false."""
    return F.coalesce(condition, F.lit(False))


def product_stem(product_id: Column | str = "product_id") -> Column:
    """Parent article: the stripped first eight characters of a full id."""
    c = as_column(product_id)
    return F.when(F.length(c) >= S.STEM_LENGTH, strip(F.substring(c, 1, S.STEM_LENGTH))).otherwise(c)


def index_stem(product_id: Column | str = "product_id") -> Column:
    """Stem as the product index builds it: always cut and stripped."""
    return strip(F.substring(as_column(product_id), 1, S.STEM_LENGTH))


def stock_article_id(art_nr: Column | str, size: Column | str, colour: Column | str) -> Column:
    """Article number (8) + size (4) + colour (2), padded but never cut."""
    size = F.coalesce(strip(size), F.lit(""))
    colour = F.coalesce(strip(colour), F.lit(""))
    return strip(
        F.concat(
            pad_right(as_column(art_nr).cast("string"), S.STEM_LENGTH),
            pad_right(size, S.SIZE_LENGTH),
            pad_right(colour, S.COLOUR_LENGTH),
        )
    )


def lenient_date(c: Column | str, formats: tuple[str, ...] = ()) -> Column:
    """Date of a column of any type; text that is no date becomes null."""
    c = as_column(c)
    parsed = [c.try_cast("date")]
    parsed += [F.try_to_timestamp(c.cast("string"), F.lit(f)).cast("date") for f in formats]
    return F.coalesce(*parsed)


def month_start(c: Column | str) -> Column:
    return F.trunc(as_column(c), "MM")


def month_number(c: Column | str) -> Column:
    """Months since year 0, so that differences count calendar months."""
    c = as_column(c)
    return F.year(c) * 12 + F.month(c)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(as_column(a), as_column(b))


def half_up(c: Column | str, digits: int) -> Column:
    """Rounded with plain floating arithmetic, alike in every SQL engine."""
    scale = float(10**digits)
    return F.floor(as_column(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def signed_percent(c: Column | str) -> Column:
    """+12.3% form, ties to even, keeping the sign of tiny negatives."""
    c = as_column(c)
    rounded = F.bround(c, 1)
    return F.when((c < 0) & (rounded == 0), F.lit("-0.0%")).otherwise(
        F.format_string("%+.1f%%", rounded)
    )

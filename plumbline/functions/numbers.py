"""Column expressions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def as_double(col: Column, kind: T.DataType) -> Column:
    """A numeric, boolean, interval or text column as a double; what doesn't parse is null.

    Intervals count in seconds. Text must look like a number as a whole: casts alone would
    take a trailing type letter.
    """
    if isinstance(kind, T.DayTimeIntervalType):
        return (F.unix_micros(F.timestamp_micros(F.lit(0)) + col) / 1e6).cast("double")
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        text = F.trim(col)
        return F.when(looks_numeric(text), text.try_cast("double"))
    return col.cast("double")


def looks_numeric(text: Column) -> Column:
    return text.rlike(r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?inf(inity)?$|^nan$")


def is_missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def is_infinite(x: Column) -> Column:
    return F.coalesce(F.abs(x) == F.lit(INF), F.lit(False))


def finite(x: Column) -> Column:
    """``x``, or null where it is missing or infinite."""
    return F.when(~(is_missing(x) | is_infinite(x)), x)


def is_integral(x: Column) -> Column:
    return F.abs(x - F.rint(x)) < 1e-10


def ten_billionths(x: Column) -> Column:
    """A value below 900,000 in whole ten-billionths; else null."""
    return F.when(F.abs(x) < 900_000, F.rint(F.abs(x) * 1e10).cast("long"))


def is_heaped(x: Column, tiny: Column) -> Column:
    """Whether the last significant digit of a value, rounded to ten decimals, is 0 or 5; zero is.

    ``tiny`` is ``ten_billionths(x)``, whose last digit that isn't zero is looked for down
    to the units; where it is null the decimal text is looked at, and a value too large
    for that has trailing zeros, as doubles print.
    """
    found = F.when(tiny % 10 != 0, tiny % 10 == 5)
    for k in range(1, 10):
        found = found.when(tiny % 10 ** (k + 1) != 0, tiny % 10 ** (k + 1) == 5 * 10**k)
    found = found.otherwise((tiny % 10**11).isin(0, 5 * 10**10))
    text = F.coalesce(F.round(F.abs(x), 10).try_cast("decimal(38,10)").cast("string"), F.lit("0"))
    digits = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.", "")
    return F.when(tiny.isNotNull(), found).when(x.isNotNull(), F.right(digits, F.lit(1)).isin("0", "5"))


def rounded(x: Column, digits: int = 9) -> Column:
    """A double to so many significant digits, so that sums in another order compare equal."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF), F.format_string(f"%.{digits - 1}e", x).cast("double")).otherwise(x)

"""What statistics say in words: verdicts on levels, lengths, tails and bins, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import numbers as N

#: Gaps of lengths that count: share of the span, share of the rows and rows on the smaller side. Fixed values.
GAP_SPAN, GAP_MASS, GAP_ROWS = 0.12, 0.02, 5
#: Top-five coverage and distinct ratio of a column of too many levels for a chart, and the ratio of an identifier.
LOW_COVERAGE, MANY_DISTINCT, NEARLY_ALL = 0.02, 0.5, 0.9
#: Share of an axis within which marks merge.
NEAR = 0.02

Named = dict[str, Column]


def level_verdicts(top: DataFrame, facts: DataFrame) -> DataFrame:
    """(column_name, levels, show_entropy, show_rare, show_top5, chart, even_share): which statistics of levels say something.

    Of all levels known, five or fewer make the top five all of them, and two or fewer
    make entropy and rare levels plain from the shares; entropy of levels seen once each
    is their number. ``top`` are frequent values, ``facts`` has count and unique.
    """
    seen = top.groupBy("column_name").agg(F.sum("n").alias("tracked"), F.max("n").alias("most"), F.sum(F.when(F.col("rank") <= 5, F.col("n"))).alias("five"))
    rows = facts.select("column_name", "count", "unique").join(F.broadcast(seen), "column_name")  # a row for each column
    whole, few = F.col("tracked") == F.col("count"), F.col("unique")
    ratio, five = F.col("unique") / F.col("count"), F.col("five") / F.col("count")
    chart = F.when(ratio >= NEARLY_ALL, "identifier-like").when((five <= LOW_COVERAGE) | (ratio >= MANY_DISTINCT), "too many levels").otherwise("bars")
    return rows.select(
        "column_name", few.alias("levels"), (~((F.col("most") == 1) | (whole & (few <= 2)))).alias("show_entropy"), (~(whole & (few <= 2))).alias("show_rare"), (~(whole & (few <= 5))).alias("show_top5"),
        chart.alias("chart"), (100.0 / few).alias("even_share"),
    )


def length_gaps(counted_lengths: DataFrame) -> DataFrame:
    """(column_name, below, above, rows_below, rows_above): gaps in the lengths of texts that look like two formats in one column."""
    order = Window.partitionBy("column_name").orderBy("length")
    whole = Window.partitionBy("column_name")
    rows = counted_lengths.select(
        "column_name", F.col("length").alias("below"), F.lead("length").over(order).alias("above"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("rows_below"),
        F.sum("n").over(whole).alias("total"), (F.max("length").over(whole) - F.min("length").over(whole)).alias("span"),
    ).filter("above is not null")
    step = F.min(F.col("above") - F.col("below")).over(whole)
    gaps = rows.withColumn("step", step).withColumn("rows_above", F.col("total") - F.col("rows_below"))
    smaller = F.least("rows_below", "rows_above")
    width = F.col("above") - F.col("below")
    wide = (width > F.col("step")) & (width / F.greatest("span", F.lit(1)) >= GAP_SPAN) & (smaller / F.col("total") >= GAP_MASS) & (smaller >= GAP_ROWS)
    return gaps.filter(wide).select("column_name", "below", "above", "rows_below", "rows_above")


def tails(ends: DataFrame, fences: DataFrame) -> DataFrame:
    """(column_name, side, tracked, beyond, ties, verdict) of tracked extremes (column_name, side, value) against fences (column_name, lo, hi)."""
    rows = ends.join(F.broadcast(fences), "column_name")  # a row for each column
    beyond = F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
    n = F.count("*")
    facts = rows.groupBy("column_name", "side").agg(n.alias("tracked"), beyond.alias("beyond"), (n - F.count_distinct("value")).alias("ties"))
    return facts.withColumn("verdict", F.when(F.col("beyond") == 0, "inside").when(F.col("beyond") == F.col("tracked"), "all beyond").otherwise("some beyond"))


def clusters(marks: DataFrame, lo: float, hi: float) -> DataFrame:
    """(cluster, first, last, n) of marks (value), few enough for a drawing: neighbours nearer than NEAR of the axis are one."""
    order = Window.orderBy("value")  # over the marks of one drawing
    gap = (F.col("value") - F.lag("value").over(order)) / F.lit(max(hi - lo, 1e-300))
    rows = marks.withColumn("new", F.when(F.coalesce(gap, F.lit(1.0)) >= NEAR, 1).otherwise(0))
    rows = rows.withColumn("cluster", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("cluster").agg(F.min("value").alias("first"), F.max("value").alias("last"), F.count("*").alias("n"))


def common_values(top: DataFrame, k: int = 10) -> DataFrame:
    """The first k frequent values of each column, but none of a column in which nothing repeats."""
    repeats = top.groupBy("column_name").agg(F.max("n").alias("most")).filter("most > 1").select("column_name")
    return top.filter(F.col("rank") <= k).join(F.broadcast(repeats), "column_name", "left_semi")  # a row for each column


def rebinned(df: DataFrame, x: Column, lo: float, hi: float, bins: int, log: bool = False) -> DataFrame:
    """(bin, n): an exact histogram of another number of bins, of the values or of the decimal logarithms of those above zero; lo and hi bound what is binned."""
    v = N.finite(x)
    y = F.when(v > 0, F.log10(v)) if log else v
    at = F.least(F.floor((y - lo) / F.lit(hi - lo) * bins), F.lit(bins - 1)) if hi > lo else F.lit(0)
    return df.select(F.when(y.isNotNull(), at).cast("int").alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def indicators(stats: DataFrame) -> DataFrame:
    """(column_name, indicator, severity, advice) for numeric statistics (count, missing, skew, outliers_iqr, zeros, cv)."""
    n = F.col("count")
    miss, out, zero = F.try_divide(100.0 * F.col("missing"), n + F.col("missing")), F.try_divide(100.0 * F.col("outliers_iqr"), n), F.try_divide(100.0 * F.col("zeros"), n)
    grade = lambda v, *limits: F.when(v >= limits[2], "critical").when(v >= limits[1], "high").when(v >= limits[0], "medium")
    found = [
        ("missing", grade(miss, 5, 20, 50), "find out why values are missing, or fill them"),
        ("outliers", grade(out, 1, 5, 10), "look at the values beyond the fence before averaging"),
        ("skew", grade(F.abs("skew"), 1, 2, 5), "compare medians, or take logarithms"),
        ("zeros", grade(zero, 30, 50, 90), "tell zero from missing"),
    ]
    items = [F.struct(F.lit(name).alias("indicator"), level.alias("severity"), F.lit(advice).alias("advice")) for name, level, advice in found]
    return stats.select("column_name", F.inline(F.array(*items))).filter("severity is not null")

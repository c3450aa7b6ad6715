"""Statistics of whole tables: rows, missing cells, duplicates, correlations, and missingness by position."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import numbers as N

Named = dict[str, Column]


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    c = F.col(f"`{name}`")
    return N.is_missing(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def missing(df: DataFrame) -> DataFrame:
    """(column_name, position, missing, rows, pct) of each column, in one scan."""
    names = df.columns
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, position int, missing long, rows long, pct double")
    flat = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)])
    long = flat.select("rows", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(names)])))
    return long.select("column_name", "position", "missing", "rows", F.coalesce(F.try_divide(100.0 * F.col("missing"), F.col("rows")), F.lit(0.0)).alias("pct"))


def top_missing(df: DataFrame, k: int = 5) -> DataFrame:
    """The k columns with the highest share of missing values, zeros included; equal shares in column order."""
    return missing(df).orderBy(F.desc("pct"), "position").limit(k).select("column_name", "pct", F.col("missing").alias("count"))


def overview(df: DataFrame) -> DataFrame:
    """(rows, cols, missing_cells, missing_cells_pct) of the table."""
    cols = len(df.columns)
    if not cols:
        return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(0).alias("cols"), F.lit(0).cast("long").alias("missing_cells"), F.lit(0.0).alias("missing_cells_pct"))
    cells = sum((F.col("m").getItem(i) for i in range(cols)), F.lit(0).cast("long"))
    flat = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*[F.count_if(is_missing(df, c)) for c in df.columns]).alias("m")).withColumn("missing_cells", cells)
    return flat.select("rows", F.lit(cols).alias("cols"), "missing_cells", F.coalesce(F.try_divide(100.0 * F.col("missing_cells"), F.col("rows") * cols), F.lit(0.0)).alias("missing_cells_pct"))


def row_key(df: DataFrame) -> list[Column]:
    """128 bits that tell rows apart: nulls count by column, NaNs are equal, and so are both zeros."""
    parts: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit("NaN").cast("double")).otherwise(c.cast("double") + 0.0)
        elif isinstance(f.dataType, (T.MapType, T.VariantType)):
            c = F.to_json(c)
        parts += [c.isNull(), c]
    return [F.xxhash64(F.lit(salt), *parts) for salt in (0, 1)]


def duplicates(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(rows, distinct, duplicates, lo, hi, pct): rows beyond the first of equal ones.

    Exact counts group 128-bit row keys, so rows themselves aren't shuffled. The
    approximate count is of a HyperLogLog sketch; below three of its standard deviations
    it is 0, with those three as the upper bound.
    """
    a, b = row_key(df) if df.columns else (F.lit(0), F.lit(0))
    keys = df.select(a.alias("a"), b.alias("b"))
    if not approximate:
        counted = keys.groupBy("a", "b").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct"))
        dup = F.col("rows") - F.col("distinct")
        lo = hi = dup
    else:
        counted = keys.agg(F.count("*").alias("rows"), F.least(F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64("a", "b"), F.lit(14))), F.count("*")).alias("distinct"))
        error = F.ceil(F.col("distinct") * (1.04 / math.sqrt(1 << 14)))
        raw = F.col("rows") - F.col("distinct")
        low = raw <= 3 * error
        dup = F.when(low, 0).otherwise(raw)
        lo, hi = F.when(low, 0).otherwise(F.greatest(raw - error, F.lit(0))), F.when(low, F.least(3 * error, F.col("rows"))).otherwise(F.least(raw + error, F.col("rows")))
    pct = F.coalesce(F.try_divide(100.0 * dup, F.col("rows")), F.lit(0.0))
    return counted.select("rows", "distinct", dup.cast("long").alias("duplicates"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), pct.alias("pct"))


def sample_rows(df: DataFrame, seed: int = 0, k: int = 10) -> DataFrame:
    """k rows in an order that the seed and their content decide."""
    a, b = row_key(df)
    return df.orderBy(F.xxhash64(F.lit(seed), a, b), a).limit(k)


def correlations(df: DataFrame, columns: Named, most: int = 50) -> DataFrame:
    """(a, b, r) of each pair of the first ``most`` columns: Pearson's r over rows finite in both, 0 for fewer than two rows or no variance.

    One aggregate over all pairs, in batches of 300 pairs so that generated code stays small.
    """
    names = list(columns)[:most]
    clean = {c: N.finite(columns[c]) for c in names}
    pairs = list(combinations(names, 2))
    schema = "a string, b string, r double"
    out = None
    for lo in range(0, len(pairs), 300):
        part = pairs[lo : lo + 300]
        aggregates = []
        for i, (a, b) in enumerate(part):
            both = clean[a].isNotNull() & clean[b].isNotNull()
            x, y = F.when(both, clean[a]), F.when(both, clean[b])
            r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
            aggregates.append(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)))).alias(f"r{i}"))
        flat = df.agg(*aggregates)
        long = flat.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(part)])))
        out = long if out is None else out.unionByName(long)
    return out if out is not None else df.sparkSession.createDataFrame([], schema)


def correlation_partners(pairs: DataFrame) -> DataFrame:
    """(column_name, rank, partner, r): every column's partners, the strongest first, equal ones by name."""
    both = pairs.select(F.col("a").alias("column_name"), F.col("b").alias("partner"), "r").unionByName(pairs.select(F.col("b").alias("column_name"), F.col("a").alias("partner"), "r"))
    order = Window.partitionBy("column_name").orderBy(F.desc(F.abs("r")), "partner")
    return both.select("column_name", F.row_number().over(order).alias("rank"), "partner", "r")


def correlation_strength(r: Column) -> Column:
    return F.when(F.abs(r) >= 0.9, "very strong").when(F.abs(r) >= 0.7, "strong").when(F.abs(r) >= 0.5, "moderate").otherwise("weak")


def correlation_section(pairs: DataFrame, threshold: float = 0.5, weak: int = 10, most: int = 100) -> DataFrame:
    """(a, b, r, strength): the pairs at or above the threshold, at most ``most``; if there are none, the ``weak`` strongest."""
    strong = pairs.filter(F.abs("r") >= threshold)
    any_strong = pairs.agg(F.coalesce(F.max(F.abs("r")), F.lit(0.0)).alias("best"))
    chosen = pairs.crossJoin(F.broadcast(any_strong)).filter((F.abs("r") >= threshold) | (F.col("best") < threshold))  # one row
    order = [F.desc(F.abs("r")), F.asc("a"), F.asc("b")]
    n = most if strong.limit(1).count() else weak
    return chosen.orderBy(*order).limit(n).select("a", "b", "r", correlation_strength(F.col("r")).alias("strength"))


def missing_by_chunk(df: DataFrame, index: Column, chunk: int, names: list[str] | None = None) -> DataFrame:
    """(column_name, start_row, end_row, missing) of each run of ``chunk`` rows."""
    names = names or df.columns
    rows = df.select((F.floor(index / chunk) * chunk).cast("long").alias("start_row"), *[is_missing(df, c).alias(f"m{i}") for i, c in enumerate(names)])
    flat = rows.groupBy("start_row").agg(F.count("*").alias("k"), *[F.count_if(f"m{i}").alias(f"n{i}") for i in range(len(names))])
    long = flat.select("start_row", (F.col("start_row") + F.col("k") - 1).alias("end_row"), F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("missing")) for i, c in enumerate(names)])))
    return long.select("column_name", "start_row", "end_row", "missing")


def missing_concentration(by_chunk: DataFrame) -> DataFrame:
    """(column_name, chunks, rows_share, missing_share, finding): the fewest densest chunks that hold half of a column's missing values.

    They are a gap if their share of the missing values is at least 1.5 times their share of the rows, else the missing values are spread.
    """
    size = F.col("end_row") - F.col("start_row") + 1
    order = Window.partitionBy("column_name").orderBy(F.desc(F.col("missing") / size), "start_row")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("column_name")
    rows = by_chunk.select("column_name", F.sum("missing").over(upto).alias("m"), F.sum(size).over(upto).alias("r"), F.row_number().over(order).alias("k"), F.sum("missing").over(whole).alias("all_m"), F.sum(size).over(whole).alias("all_r"))
    enough = rows.filter("all_m > 0 and 2 * m >= all_m")
    first = enough.groupBy("column_name").agg(F.min(F.struct("k", "m", "r", "all_m", "all_r")).alias("f"))
    ms, rs = F.col("f.m") / F.col("f.all_m"), F.col("f.r") / F.col("f.all_r")
    return first.select("column_name", F.col("f.k").alias("chunks"), rs.alias("rows_share"), ms.alias("missing_share"), F.when(ms >= 1.5 * rs, "gap").otherwise("spread").alias("finding"))


def missing_strip(by_chunk: DataFrame, segments: int = 60) -> DataFrame:
    """(column_name, segment, missing, rows): chunks put together to at most ``segments`` stretches."""
    n = by_chunk.groupBy("column_name").agg(F.count("*").alias("k"))
    order = Window.partitionBy("column_name").orderBy("start_row")
    rows = by_chunk.withColumn("nth", F.row_number().over(order) - 1).join(F.broadcast(n), "column_name")
    stride = F.ceil(F.col("k") / segments)
    return rows.groupBy("column_name", F.floor(F.col("nth") / stride).alias("segment")).agg(F.sum("missing").alias("missing"), F.sum(F.col("end_row") - F.col("start_row") + 1).alias("rows"))


def severity(pct: Column) -> Column:
    """low below 5 %, medium up to 20 %, high above."""
    return F.when(pct < 5, "low").when(pct <= 20, "medium").otherwise("high")


def missing_context(df: DataFrame) -> DataFrame:
    """(column_name, pct, rank, of, previous, next): where each column with missing values stands among them."""
    having = missing(df).filter("missing > 0")
    order = Window.orderBy(F.desc("pct"), "position")  # a row for each column
    return having.select("column_name", "pct", F.row_number().over(order).alias("rank"), F.count("*").over(Window.partitionBy()).alias("of"), F.lag("column_name").over(order).alias("previous"), F.lead("column_name").over(order).alias("next"))


def largest_remainder(counts: dict[str, int], total: int = 100) -> dict[str, int]:
    """Shares of ``total`` in whole numbers that add up to it; leftovers go to the largest remainders, of equal ones to the earlier."""
    whole = sum(counts.values())
    if not whole:
        return dict.fromkeys(counts, 0)
    exact = {k: v * total / whole for k, v in counts.items()}
    out = {k: math.floor(v) for k, v in exact.items()}
    left = total - sum(out.values())
    for k in sorted(counts, key=lambda k: -(exact[k] - out[k]))[:left]:
        out[k] += 1
    return out

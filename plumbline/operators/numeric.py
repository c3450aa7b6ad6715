"""Statistics of numeric columns.

Everything that one scan can give is one wide aggregate over all columns. What needs the
result of that scan (deviations, outliers, bins) is a second aggregate with literals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import numbers as N
from plumbline.operators import quantiles as Q
from plumbline.plans.spread import kept, spread
from plumbline.plans.together import together
from plumbline.shared import durable, release

#: Fences, the normal quantile of a 95 % interval, MAD's scale and limit, bins of a histogram, kept extremes.
IQR_FENCE, Z95, MAD_SCALE, MAD_LIMIT, BINS, EXTREMES = 1.5, 1.96, 0.6745, 3.5, 25, 5
#: Distinct values up to which a numeric column's frequent values are tracked: k levels, or k in at least this share of the levels.
TOP_SHARE = 0.02

Named = dict[str, Column]


def scan_aggregates(v: Column, missing: Column, infinite: Column, heaped: Column) -> Named:
    """Aggregates of one scan over a column: its finite values, and whether each is missing, infinite or heaped."""
    n = F.count(v)
    deep = n > 2
    m2 = F.coalesce(F.var_pop(v), F.lit(0.0))
    return {
        "count": n,
        "missing": F.count_if(missing),
        "inf": F.count_if(infinite),
        "zeros": F.count_if(v == 0),
        "negatives": F.count_if(v < 0),
        "int_like": F.coalesce(F.bool_and(N.is_integral(v)), F.lit(True)),
        "mean": F.avg(v),
        "variance": F.when(n > 0, F.coalesce(F.var_samp(v), F.lit(0.0))),
        "std": F.when(n > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))),
        "skew": F.when(n > 0, F.when(deep & (m2 > 0), F.skewness(v)).otherwise(0.0)),
        "kurtosis": F.when(n > 0, F.when(deep & (m2 > 0), F.kurtosis(v)).otherwise(0.0)),
        "gmean": F.when(n > 0, F.coalesce(F.exp(F.avg(F.when(v > 0, F.log(v)))), F.lit(0.0))),
        "min_positive": F.min(F.when(v > 0, v)),
        "min": F.min(v),
        "max": F.max(v),
        "heap_pct": F.try_divide(100.0 * F.count_if(heaped), n),
        "mem_bytes": 8 * F.count(F.lit(1)),
    }


def derived(n: Column, mean: Column, std: Column, skew: Column, kurtosis: Column) -> Named:
    """Statistics that follow from those of the scan."""
    se = F.when(n > 0, std / F.sqrt(n))
    half = F.when((n > 1) & (se > 0), Z95 * se)
    return {
        "se": se,
        "cv": F.when(n > 0, F.coalesce(F.try_divide(std, F.abs(mean)), F.lit(0.0))),
        "jb_chi2": F.when(n > 0, F.when(n >= 3, n * (skew * skew / 6 + kurtosis * kurtosis / 24)).otherwise(0.0)),
        "ci_lo": mean - half,
        "ci_hi": mean + half,
    }


#: What a column of an empty table has.
_OF_NOTHING = {"count": 0, "missing": 0, "inf": 0, "zeros": 0, "negatives": 0, "int_like": True, "mem_bytes": 0}


def scan(df: DataFrame, columns: Named) -> DataFrame:
    """A row for each of ``columns`` (name: double expression) with the statistics of one scan.

    Columns are unpivoted, so that the generated code is that of one column however many
    there are; sums are partial before the shuffle, which is a row for each column and task.
    """
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "column_name string")
    raw = spread(df.select(*[x.alias(f"x{i}") for i, x in enumerate(columns.values())]))
    parts = [F.struct(F.lit(i).alias("c"), F.col(f"x{i}").alias("x")) for i in range(len(columns))]
    long = raw.select(F.explode(F.array(*parts)).alias("r")).select("r.c", "r.x")
    x = F.col("x")
    v = N.finite(x)
    inputs = long.select("c", v.alias("v"), N.is_missing(x).alias("m"), N.is_infinite(x).alias("i"), N.ten_billionths(v).alias("t"))
    aggregates = scan_aggregates(F.col("v"), F.col("m"), F.col("i"), N.is_heaped(F.col("v"), F.col("t")))
    found = inputs.groupBy("c").agg(*[a.alias(k) for k, a in aggregates.items()])
    names = spark.createDataFrame(list(enumerate(columns)), "k int, column_name string")
    kept_ = [F.coalesce(k, F.lit(_OF_NOTHING[k])).alias(k) if k in _OF_NOTHING else F.col(k) for k in aggregates]
    rows = names.join(F.broadcast(found), F.col("k") == F.col("c"), "left").select("column_name", *kept_)  # a row for each column
    return rows.select("*", *[c.alias(k) for k, c in derived(*[F.col(k) for k in ("count", "mean", "std", "skew", "kurtosis")]).items()])


QUARTILES = (0.25, 0.5, 0.75)
TAILS = (0.01, 0.05, 0.10, 0.90, 0.95, 0.99)


LIMITS = Q.Limits(IQR_FENCE, MAD_SCALE, MAD_LIMIT)


def deviations(df: DataFrame, columns: Named, quartiles: dict[str, tuple[float | None, ...]] | None = None, exact: bool = True) -> DataFrame:
    """(column_name, q1, median, q3, mad, outliers_iqr, outliers_mod_zscore): exact over all rows, or read from sketches. Columns without values have no row."""
    known = {name: x for name, x in columns.items() if quartiles is None or quartiles[name][1] is not None}
    found = Q.deviations(df, known, LIMITS, quartiles, exact) if known else {}
    rows = [(name, *[float(d[k]) for k in ("q1", "median", "q3", "mad")], int(d["iqr_outliers"]), int(d["mad_outliers"])) for name, d in found.items()]
    return df.sparkSession.createDataFrame(rows, "column_name string, q1 double, median double, q3 double, mad double, outliers_iqr long, outliers_mod_zscore long")


def level_rows(df: DataFrame, columns: Named) -> DataFrame:
    """(c, v, n) of each distinct finite value of each column, by its number."""
    inputs = df.select(*[N.finite(x).alias(f"v{i}") for i, x in enumerate(columns.values())])
    parts = [F.struct(F.lit(i).alias("c"), (F.col(f"v{i}") + 0.0).alias("v")) for i in range(len(columns))]
    rows = inputs.select(F.explode(F.array(*parts)).alias("r")).select("r.c", "r.v").filter("v is not null")
    return rows.groupBy("c", "v").agg(F.count("*").alias("n"))


def level_counts(df: DataFrame, columns: Named) -> DataFrame:
    """(column_name, unique, mode_n): distinct finite values and the rows of the commonest, in one job whatever the number of columns."""
    names = F.array(*[F.lit(c) for c in columns])
    return level_rows(df, columns).groupBy("c").agg(F.count("*").alias("unique"), F.max("n").alias("mode_n")).select(F.get(names, F.col("c")).alias("column_name"), "unique", "mode_n")


def facts(df: DataFrame, columns: Named) -> DataFrame:
    """A row for each column with the statistics of ``scan``, ``level_counts`` and ``deviations``; a small input is read once."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string")
    raw = df.select(*[x.alias(f"x{i}") for i, x in enumerate(columns.values())])
    with kept(raw) as held:
        own = {name: F.col(f"x{i}") for i, name in enumerate(columns)}

        def told(rows: DataFrame) -> DataFrame:
            return held.sparkSession.createDataFrame(rows.collect(), rows.schema)  # a row for each column

        moments, levels, spreads = together(held.sparkSession, lambda: told(scan(held, own)), lambda: told(level_counts(held, own)), lambda: deviations(held, own))
        return moments.join(levels, "column_name", "left").join(spreads, "column_name", "left")


def bounds(df: DataFrame, columns: Named) -> dict[str, tuple[float | None, float | None]]:
    aggregates = [f(N.finite(x)).alias(f"{i}_{k}") for i, x in enumerate(columns.values()) for k, f in (("lo", F.min), ("hi", F.max))]
    found = df.agg(*aggregates).first() if aggregates else {}
    return {name: (found[f"{i}_lo"], found[f"{i}_hi"]) for i, name in enumerate(columns)}


def bin_edges(lo: float, hi: float, bins: int = BINS) -> list[float]:
    """Edges of equal bins; a constant has one bin around it."""
    if hi <= lo:
        return [lo - 0.5, lo + 0.5]
    return [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]


def histogram(df: DataFrame, columns: Named, limits: dict[str, tuple[float | None, float | None]], bins: int = BINS) -> DataFrame:
    """(column_name, bin, lower, upper, n) for the occupied bins; the last bin holds its upper edge."""
    inputs = spread(df.select(*[N.finite(columns[name]).alias(f"v{i}") for i, name in enumerate(limits)]))
    parts = []
    for i, (name, (lo, hi)) in enumerate(limits.items()):
        if lo is None:
            continue
        v = F.col(f"v{i}")
        width = (hi - lo) / bins
        index = F.least(F.floor((v - lo) / F.lit(hi - lo) * bins), F.lit(bins - 1)) if hi > lo else F.lit(0)
        low = F.lit(lo) + index * width if hi > lo else F.lit(lo - 0.5)
        high = F.when(index == bins - 1, F.lit(hi)).otherwise(F.lit(lo) + (index + 1) * width) if hi > lo else F.lit(lo + 0.5)
        item = F.struct(F.lit(name).alias("column_name"), index.cast("int").alias("bin"), low.cast("double").alias("lower"), high.cast("double").alias("upper"))
        parts.append(F.when(v.isNotNull(), item))
    if not parts:
        return df.sparkSession.createDataFrame([], "column_name string, bin int, lower double, upper double, n long")
    rows = inputs.select(F.explode(F.array(*parts)).alias("h")).filter("h is not null")
    return rows.groupBy("h").agg(F.count("*").alias("n")).select("h.*", "n")


_ENDS = pa.schema([("c", pa.int32()), ("side", pa.string()), ("value", pa.float64()), ("row_index", pa.int64())])


def _ends(columns: int, k: int):
    """The k smallest and largest values of each column in a task's rows (row index, then the columns), of equal ones those of the earliest rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # values, negated for the largest, and row indexes, in order
        for batch in batches:
            index = batch.column(0).fill_null(_NO_ROW).to_numpy(zero_copy_only=False)
            for c in range(columns):
                v = batch.column(c + 1).to_numpy(zero_copy_only=False)
                for sign in (1, -1):
                    x, rows = sign * v, index
                    best, at = kept_.get((c, sign), (np.zeros(0), np.zeros(0, np.int64)))
                    near = (x < best[-1]) | ((x == best[-1]) & (rows < at[-1])) if len(best) == k else ~np.isnan(x)
                    if near.any():
                        x, rows = np.concatenate([best, x[near]]), np.concatenate([at, rows[near]])
                        first = np.lexsort((rows, x))[:k]
                        kept_[c, sign] = x[first], rows[first]
        for (c, sign), (x, rows) in kept_.items():
            n = len(x)
            row_index = pa.array(rows, mask=rows == _NO_ROW)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(["min" if sign > 0 else "max"] * n), pa.array(sign * x + 0.0), row_index], schema=_ENDS)

    return run


#: Stands for the index of a row without a place.
_NO_ROW = -(1 << 63)


def extremes(df: DataFrame, columns: Named, index: Column, k: int = EXTREMES) -> DataFrame:
    """(column_name, side, rank, value, row_index) of the k smallest and largest values; of equal values the earlier row comes first.

    Each task keeps its own, in one scan for all columns and both sides; only these are ranked.
    """
    inputs = spread(df.select(index.cast("long").alias("row_index"), *[N.finite(x).cast("double").alias(f"v{i}") for i, x in enumerate(columns.values())]))
    found = inputs.mapInArrow(_ends(len(columns), k), "c int, side string, value double, row_index long")
    sign = F.when(F.col("side") == "min", 1.0).otherwise(-1.0)
    w = Window.partitionBy("c", "side").orderBy(sign * F.col("value"), F.asc("row_index"))  # k rows for each task
    names = F.array(*[F.lit(name) for name in columns]).cast("array<string>")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.get(names, F.col("c")).alias("column_name"), "side", "rank", "value", "row_index")


def top_values_tracked(distinct: int, k: int) -> bool:
    """Whether a numeric column has so few levels that its frequent values say something."""
    return distinct <= k or k / distinct >= TOP_SHARE


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted distinct values (c, v): how often each distance of neighbours occurs (c, d, n), and each column's first and last value here (c, part, first, last)."""
    from pyspark import TaskContext

    part, last, first, found = TaskContext.get().partitionId(), {}, {}, {}
    for batch in batches:
        c, v = batch.column("c").to_numpy(), batch.column("v").to_numpy()
        for k in np.unique(c).tolist():
            own = v[c == k]
            first.setdefault(k, float(own[0]))
            gaps = np.diff(np.concatenate([[last[k]], own]) if k in last else own)
            last[k] = float(own[-1])
            sizes, times = np.unique(gaps[gaps > 0], return_counts=True)
            known = found.setdefault(k, [np.zeros(0), np.zeros(0, np.int64)])
            known[0], known[1] = np.concatenate([known[0], sizes]), np.concatenate([known[1], times])
    rows = []
    for k, (sizes, times) in found.items():
        merged, where = np.unique(sizes, return_inverse=True)
        counts = np.bincount(where, times, len(merged)).astype(np.int64) if len(merged) else times
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(merged), k), pa.int32()), pa.array(merged, pa.float64()), pa.array(counts, pa.int64()), *[pa.nulls(len(merged), t) for t in (pa.int32(), pa.float64(), pa.float64())]], _GAP_NAMES
        )
        rows.append((k, part, first[k], last[k]))
    nulls = [pa.nulls(len(rows), pa.float64()), pa.nulls(len(rows), pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *nulls, *[pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int32()), (2, pa.float64()), (3, pa.float64()))]], _GAP_NAMES)


_GAP_NAMES = ["c", "d", "n", "part", "first", "last"]


def _decimals(step: float) -> int | None:
    """The least power of ten, up to ten, that makes a step whole."""
    return next((k for k in range(10) if abs(step * 10**k - round(step * 10**k)) <= 1e-10), 10)


def granularity(df: DataFrame, columns: Named, sample: int | None = None) -> DataFrame:
    """(column_name, gran_step, gran_decimals): the commonest distance of neighbouring distinct values, and the decimals that write it.

    All distinct values are sorted, over range partitions, for all columns at once; with
    ``sample`` about so many of each column, those of the lowest hash. The distances fall
    into at most 50 bins, and the step is the middle of the fullest one, the first of
    equals; if they barely differ it is the middle of them all. Fewer than two values give nulls.
    """
    spark, schema = df.sparkSession, "column_name string, gran_step double, gran_decimals int"
    if not columns:
        return spark.createDataFrame([], schema)
    levels = level_rows(df, columns).select("c", "v")
    if sample:
        order = Window.partitionBy("c").orderBy(F.xxhash64("v"), "v")
        share = levels.groupBy("c").agg(F.approx_count_distinct("v").alias("k"))
        near = levels.join(F.broadcast(share), "c").filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= 2.0 * sample / F.col("k") * (1 << 30))
        levels = near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= sample).select("c", "v")
    found = durable(levels.repartitionByRange("c", "v").sortWithinPartitions("c", "v").mapInArrow(_gaps, "c int, d double, n long, part int, first double, last double"))
    border = Window.partitionBy("c").orderBy("part")  # a row for each partition
    jumps = found.filter("part is not null").select("c", (F.col("first") - F.lag("last").over(border)).alias("d"), F.lit(1).cast("long").alias("n")).filter("d > 0")
    gaps = found.filter("part is null").select("c", "d", "n").unionByName(jumps)
    spans = {r["c"]: r for r in gaps.groupBy("c").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.sum("n").alias("n")).collect()}  # a row for each column
    steps = {}
    at = F.lit(None).cast("int")
    for c, r in spans.items():
        bins = min(50, r["n"])
        if r["hi"] - r["lo"] <= abs(r["hi"]) * 1e-9:
            steps[c] = (r["lo"] + r["hi"]) / 2
        else:
            at = F.when(F.col("c") == c, F.least(F.floor((F.col("d") - r["lo"]) / (r["hi"] - r["lo"]) * bins), F.lit(bins - 1)).cast("int")).otherwise(at)
    if len(steps) < len(spans):
        tallies: dict[int, list[tuple[int, int]]] = {}
        for r in gaps.groupBy("c", at.alias("at")).agg(F.sum("n").alias("n")).filter("at is not null").collect():  # at most 50 rows for each column
            tallies.setdefault(r["c"], []).append((-r["n"], r["at"]))
        for c, own in tallies.items():
            lo, width = spans[c]["lo"], (spans[c]["hi"] - spans[c]["lo"]) / min(50, spans[c]["n"])
            steps[c] = lo + (min(own)[1] + 0.5) * width
    release(found)
    rows = [(name, steps.get(i), _decimals(steps[i]) if i in steps else None) for i, name in enumerate(columns)]
    return spark.createDataFrame(rows, schema)

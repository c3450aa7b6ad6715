"""Mergeable sketches: distinct counts, quantiles and frequent values in one scan and bounded memory."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import numbers as N
from plumbline.operators.dataset import row_key

#: Bits of a HyperLogLog sketch's size, and entries of a frequent-values sketch for each value asked for.
HLL_BITS, TRACKED = 14, 10
HLL_ERROR = 1.04 / math.sqrt(1 << HLL_BITS)

Named = dict[str, Column]


def _unpivot(flat: DataFrame, names: list[str], columns: dict[str, str]) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{prefix}{i}").alias(name) for name, prefix in columns.items()]) for i, c in enumerate(names)]
    return flat.select(F.inline(F.array(*rows)))


def distinct_sketches(df: DataFrame, columns: Named, bits: int = HLL_BITS) -> DataFrame:
    """(column_name, count, hll): counts and HyperLogLog sketches, which merge by union."""
    flat = df.agg(*[a for i, c in enumerate(columns.values()) for a in (F.count(c).alias(f"n{i}"), F.hll_sketch_agg(c.cast("string"), F.lit(bits)).alias(f"h{i}"))])
    return _unpivot(flat, list(columns), {"count": "n", "hll": "h"})


def distinct(df: DataFrame, columns: Named, bits: int = HLL_BITS) -> DataFrame:
    """(column_name, unique, error): estimated distinct values, never above the count, and one standard error."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, unique long, error long")
    n = F.coalesce(F.least(F.hll_sketch_estimate("hll"), F.col("count")), F.lit(0))
    return distinct_sketches(df, columns, bits).select("column_name", n.alias("unique"), F.ceil(n * (1.04 / math.sqrt(1 << bits))).alias("error"))


def quantile_sketches(df: DataFrame, columns: Named) -> DataFrame:
    """(column_name, kll): quantile sketches of finite values, which merge."""
    return _unpivot(df.agg(*[F.kll_sketch_agg_double(N.finite(x.cast("double"))).alias(f"k{i}") for i, x in enumerate(columns.values())]), list(columns), {"kll": "k"})


def quantiles(df: DataFrame, columns: Named, at: tuple[float, ...]) -> DataFrame:
    """(column_name, p, value) from quantile sketches; null for a column without values."""
    some = F.kll_sketch_get_n_double("kll") > 0
    parts = [F.struct(F.lit(p).alias("p"), F.when(some, F.kll_sketch_get_quantile_double(F.col("kll"), F.lit(p))).alias("value")) for p in at]
    return quantile_sketches(df, columns).select("column_name", F.inline(F.array(*parts)))


def frequent_values(df: DataFrame, columns: Named, k: int = 50) -> DataFrame:
    """(column_name, rank, value, n) of about the k commonest values, from frequent-items sketches, which merge."""
    flat = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns.values())]).agg(*[F.expr(f"approx_top_k(c{i}, {k}, {max(1000, TRACKED * k)})").alias(f"t{i}") for i in range(len(columns))])

    def labelled(name: str):
        return lambda e: F.struct(F.lit(name).alias("column_name"), e["item"].cast("string").alias("value"), e["count"].alias("n"))

    parts = [F.transform(F.col(f"t{i}"), labelled(c)) for i, c in enumerate(columns)]
    rows = flat.select(F.inline(F.concat(*parts))).filter("value is not null")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))).select("column_name", "rank", "value", "n")


def reservoir(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows chosen evenly, the same ones for the same seed and content: those of the lowest hash."""
    a, b = row_key(df)
    return df.orderBy(F.xxhash64(F.lit(seed), a, b), a, b).limit(k)


def moments(df: DataFrame, columns: Named) -> DataFrame:
    """(column_name, n, mean, m2, m3, m4): central moments as sums, which merge by ``merge_moments``."""
    asks = []
    for i, x in enumerate(columns.values()):
        v = N.finite(x)
        asks += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.var_pop(v).alias(f"v{i}"), F.when(F.var_pop(v) > 0, F.skewness(v)).alias(f"s{i}"), F.when(F.var_pop(v) > 0, F.kurtosis(v)).alias(f"k{i}")]
    long = _unpivot(df.agg(*asks), list(columns), {"n": "n", "mean": "a", "var": "v", "skew": "s", "kurt": "k"})
    var = F.coalesce("var", F.lit(0.0))
    return long.select(
        "column_name", "n", F.coalesce("mean", F.lit(0.0)).alias("mean"), (F.col("n") * var).alias("m2"), F.coalesce(F.col("skew") * F.col("n") * F.pow(var, F.lit(1.5)), F.lit(0.0)).alias("m3"),
        F.coalesce((F.col("kurt") + 3) * F.col("n") * var * var, F.lit(0.0)).alias("m4"),
    )


def merge_moments(parts: DataFrame) -> DataFrame:
    """One row for each column of ``moments`` rows, by the binomial sums about the common mean."""
    total = parts.groupBy("column_name").agg(F.sum("n").alias("_n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("_mean"))
    rows = parts.join(F.broadcast(total), "column_name")  # a row for each column
    n, d = F.col("n"), F.col("mean") - F.coalesce("_mean", F.lit(0.0))
    merged = rows.groupBy("column_name").agg(
        F.sum("n").alias("n"), F.coalesce(F.max("_mean"), F.lit(0.0)).alias("mean"), F.sum(F.col("m2") + n * d * d).alias("m2"), F.sum(F.col("m3") + 3 * d * F.col("m2") + n * d * d * d).alias("m3"),
        F.sum(F.col("m4") + 4 * d * F.col("m3") + 6 * d * d * F.col("m2") + n * d * d * d * d).alias("m4"),
    )
    return merged

"""A stream's profile from mergeable state.

Each micro-batch adds one row of state for each column: counts, moments, bounds and
HyperLogLog and quantile sketches. The state table is the checkpoint: a query that starts
again goes on from it, and a batch that is run again replaces its own rows. The profile so
far is an aggregate of the state.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions import numbers as N
from plumbline.operators import sketches as S

Named = dict[str, Column]


def batch_state(df: DataFrame, numeric: Named, other: Named, batch: int) -> DataFrame:
    """(batch, column_name, rows, n, missing, inf, zeros, negatives, lo, hi, mean, m2, m3, m4, hll, kll): the state of one batch."""
    parts = []
    if numeric:
        moments = S.moments(df, numeric)
        bounds = df.agg(*[a for i, x in enumerate(numeric.values()) for a in (
            F.count(F.lit(1)).alias(f"r{i}"), F.count_if(N.is_missing(x)).alias(f"m{i}"), F.count_if(N.is_infinite(x)).alias(f"i{i}"), F.count_if(N.finite(x) == 0).alias(f"z{i}"), F.count_if(N.finite(x) < 0).alias(f"g{i}"),
            F.min(N.finite(x)).alias(f"l{i}"), F.max(N.finite(x)).alias(f"h{i}"), F.hll_sketch_agg((N.finite(x) + 0.0).cast("string"), F.lit(S.HLL_BITS)).alias(f"s{i}"), F.kll_sketch_agg_double(N.finite(x)).alias(f"k{i}"),
        )])
        long = S._unpivot(bounds, list(numeric), {"rows": "r", "missing": "m", "inf": "i", "zeros": "z", "negatives": "g", "lo": "l", "hi": "h", "hll": "s", "kll": "k"})
        parts.append(long.join(moments, "column_name"))
    if other:
        flat = df.agg(*[a for i, c in enumerate(other.values()) for a in (F.count(F.lit(1)).alias(f"r{i}"), F.count_if(c.isNull()).alias(f"m{i}"), F.count(c).alias(f"n{i}"), F.hll_sketch_agg(c.cast("string"), F.lit(S.HLL_BITS)).alias(f"s{i}"))])
        parts.append(S._unpivot(flat, list(other), {"rows": "r", "missing": "m", "n": "n", "hll": "s"}))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return out.withColumn("batch", F.lit(batch).cast("long"))


def current(state: DataFrame, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A row for each column with its statistics over all batches of the state; quantiles and distinct counts are estimates."""
    sums = state.groupBy("column_name").agg(
        *[F.sum(c).alias(c) for c in ("rows", "n", "missing", "inf", "zeros", "negatives") if c in state.columns],
        *([F.min("lo").alias("min"), F.max("hi").alias("max")] if "lo" in state.columns else []),
        F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct"),
    )
    out = sums.withColumn("unique_est", F.least("distinct", "n")).drop("distinct")
    if "mean" not in state.columns:
        return out
    merged = S.merge_moments(state.filter("mean is not null").select("column_name", "n", "mean", "m2", "m3", "m4"))
    n, m2 = F.col("n"), F.col("m2")
    shape = merged.select(
        "column_name", F.when(n > 0, F.col("mean")).alias("mean"), F.when(n > 1, m2 / (n - 1)).otherwise(F.when(n > 0, 0.0)).alias("variance"),
        F.when((n > 2) & (m2 > 0), F.col("m3") / n / F.pow(m2 / n, F.lit(1.5))).otherwise(0.0).alias("skew"), F.when((n > 2) & (m2 > 0), F.col("m4") / n / F.pow(m2 / n, F.lit(2.0)) - 3).otherwise(0.0).alias("kurtosis"),
    )
    kll = state.filter("kll is not null").groupBy("column_name").agg(F.kll_merge_agg_double("kll").alias("kll"))
    some = F.kll_sketch_get_n_double("kll") > 0
    quantiles = kll.select("column_name", *[F.when(some, F.kll_sketch_get_quantile_double(F.col("kll"), F.lit(p))).alias(f"p{round(100 * p)}") for p in at])
    return out.join(shape, "column_name", "left").join(quantiles, "column_name", "left")


def write_batch(df: DataFrame, batch: int, path: str, numeric: list[str], other: list[str]) -> None:
    """Adds a batch's rows to the state at ``path``; the same batch again replaces them."""
    state = batch_state(df, {c: F.col(f"`{c}`").cast("double") for c in numeric}, {c: F.col(f"`{c}`") for c in other}, batch)
    state.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path).drop("batch_id")


def profile_stream(stream: DataFrame, path: str, numeric: list[str], other: list[str] = (), progress: Callable[[dict[str, Any]], None] | None = None, **trigger: Any) -> StreamingQuery:
    """Starts a query that keeps the state of ``stream`` at ``path``; without a trigger it takes what there is and ends.

    ``progress`` gets {batch, rows} after each batch.
    """
    def each(df: DataFrame, batch: int) -> None:
        write_batch(df, batch, f"{path}/state", list(numeric), list(other))
        if progress:
            rows = read_state(df.sparkSession, f"{path}/state").groupBy("batch").agg(F.max("rows").alias("rows")).agg(F.sum("rows")).first()[0]
            progress({"batch": batch, "rows": rows})

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def windowed_profile(stream: DataFrame, time: str, value: str, window: str, late: str, slide: str | None = None, by: str | None = None) -> DataFrame:
    """(start, end[, by], n, missing, mean, std, min, max) of each tumbling or sliding window of event time; rows later than ``late`` are passed over."""
    x = F.col(value).cast("double")
    keys = [F.window(time, window, slide) if slide else F.window(time, window), *([F.col(by)] if by else [])]
    v = N.finite(x)
    grouped = stream.withWatermark(time, late).groupBy(*keys).agg(F.count(v).alias("n"), F.count_if(N.is_missing(x)).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *([by] if by else []), "n", "missing", "mean", "std", "min", "max")

"""Statistics of date and time columns, in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import sorted_gaps

#: What 64-bit nanoseconds can say, in microseconds; and hours of business.
LEAST_MICROS, MOST_MICROS = -9_223_372_036_854_775, 9_223_372_036_854_775
OPEN_HOUR, CLOSE_HOUR = 9, 17
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

Named = dict[str, Column]


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a date or timestamp; null outside what 64-bit nanoseconds can say."""
    us = F.unix_micros(ts.cast("timestamp"))
    return F.when((us >= LEAST_MICROS) & (us <= MOST_MICROS), us)


def valid(ts: Column) -> Column:
    return F.when(micros(ts).isNotNull(), ts.cast("timestamp"))


def scan_aggregates(ts: Column) -> Named:
    t = valid(ts)
    us = micros(ts)
    return {
        "count": F.count(t),
        "missing": F.count_if(t.isNull()),
        "min_ts": F.min(us) * 1000,
        "max_ts": F.max(us) * 1000,
        "time_span_days": (F.max(us) - F.min(us)) / F.lit(86_400_000_000.0),
        "weekend": F.count_if(F.weekday(t) >= 5),
        "open_hours": F.count_if((F.hour(t) >= OPEN_HOUR) & (F.hour(t) < CLOSE_HOUR)),
        "mem_bytes": 8 * F.count(F.lit(1)),
    }


def scan(df: DataFrame, columns: Named) -> DataFrame:
    """(column_name, count, missing, min_ts, max_ts, time_span_days, weekend_ratio, business_hours_ratio, mem_bytes): one pass.

    Business hours are the product of two shares, of hours from 9 to 17 and of Monday to Friday.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string")
    wide = {name: scan_aggregates(c) for name, c in columns.items()}
    flat = df.agg(*[a.alias(f"{i}_{k}") for i, own in enumerate(wide.values()) for k, a in own.items()])
    keys = list(next(iter(wide.values())))
    long = flat.select(F.inline(F.array(*[F.struct(F.lit(name).alias("column_name"), *[F.col(f"{i}_{k}").alias(k) for k in keys]) for i, name in enumerate(wide)])))
    weekend = F.try_divide(F.col("weekend"), F.col("count"))
    return long.select(
        "column_name", "count", "missing", "min_ts", "max_ts", "time_span_days", weekend.alias("weekend_ratio"),
        (F.try_divide(F.col("open_hours"), F.col("count")) * (1 - weekend)).alias("business_hours_ratio"), "mem_bytes",
    )


def calendar(df: DataFrame, columns: Named) -> DataFrame:
    """(column_name, part, bucket, n): rows by hour, weekday (Monday is 0), month and year, by grouping sets over one scan."""
    parts = [F.struct(F.lit(name).alias("column_name"), valid(c).alias("t")) for name, c in columns.items()]
    rows = df.select(F.explode(F.array(*parts)).alias("v")).select("v.*").filter("t is not null")
    keyed = rows.select("column_name", F.hour("t").alias("hour"), F.weekday("t").alias("dow"), F.month("t").alias("month"), F.year("t").alias("year"))
    sets = [[F.col("column_name"), F.col(p)] for p in ("hour", "dow", "month", "year")]
    grouped = keyed.groupingSets(sets, "column_name", "hour", "dow", "month", "year").agg(F.count("*").alias("n"))
    part = F.when(F.col("hour").isNotNull(), "hour").when(F.col("dow").isNotNull(), "dow").when(F.col("month").isNotNull(), "month").otherwise("year")
    return grouped.select("column_name", part.alias("part"), F.coalesce("hour", "dow", "month", "year").cast("int").alias("bucket"), "n")


def peaks(tallies: DataFrame) -> DataFrame:
    """(column_name, part, bucket, n): the fullest bucket of each part; of equally full ones the first."""
    best = tallies.groupBy("column_name", "part").agg(F.max(F.struct("n", (-F.col("bucket")).alias("minus"))).alias("b"))
    return best.select("column_name", "part", (-F.col("b.minus")).alias("bucket"), F.col("b.n").alias("n"))


def seasonal(tallies: DataFrame) -> DataFrame:
    """(column_name, seasonal_pattern): the month of the most rows if there is one such month."""
    months = tallies.filter("part = 'month'")
    most = months.groupBy("column_name").agg(F.max("n").alias("most"))
    full = months.join(F.broadcast(most), "column_name").filter("n = most").groupBy("column_name").agg(F.count("*").alias("k"), F.min("bucket").alias("month"))
    names = F.array(*[F.lit(m) for m in MONTHS])
    return full.select("column_name", F.when(F.col("k") == 1, F.concat(F.lit("Peak in "), F.get(names, F.col("month") - 1))).otherwise("Multiple peaks detected").alias("seasonal_pattern"))


def intervals(df: DataFrame, columns: Named) -> DataFrame:
    """(column_name, avg_interval_seconds, interval_std_seconds) of the gaps between each column's sorted values; the deviation is of the population."""
    gaps = sorted_gaps(df, {name: micros(c) for name, c in columns.items()})
    return gaps.select("column_name", (F.col("gap_mean") / 1e6).alias("avg_interval_seconds"), (F.col("gap_std") / 1e6).alias("interval_std_seconds"))


def timeline(df: DataFrame, column: Column, lo: int, hi: int, bins: int = 60) -> DataFrame:
    """(bin, n) of equal spans of time between two moments, in microseconds since 1970."""
    us = micros(column)
    at = F.least(F.floor((us - lo) / F.lit(float(hi - lo)) * bins), F.lit(bins - 1)) if hi > lo else F.lit(0)
    return df.select(F.when(us.isNotNull(), at).cast("int").alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def interval_sentence(mean: Column, std: Column) -> Column:
    """identical, regular (deviation below a tenth of the mean) or irregular."""
    return F.when(mean.isNull(), None).when(std == 0, "identical").when(F.try_divide(std, mean) < 0.1, "regular").otherwise("irregular")


#: Shares, in per cent, that a flat calendar has on weekends and in business hours, and what counts as near: fixed values.
FLAT_WEEKEND, FLAT_BUSINESS, FLAT_MARGIN = 28.57, 23.81, 3.0


def flat_verdict(pct: Column, flat: float) -> Column:
    """Whether a share is above, below or at that of a flat calendar."""
    return F.when(pct > flat + FLAT_MARGIN, "above flat").when(pct < flat - FLAT_MARGIN, "below flat").otherwise("flat")

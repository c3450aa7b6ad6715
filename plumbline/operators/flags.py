"""Quality flags: conditional expressions over tables of statistics, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import numbers as N

#: Thresholds: fixed values, in per cent unless a name says otherwise.
MISSING_BAD, NEGATIVE_WARN, ZERO_WARN, ZERO_BAD, SKEW, KURTOSIS, NORMAL_CHI2, DISCRETE_LEVELS = 20, 10, 30, 50, 1, 3, 5.99, 50
HEAPING, QUASI, MANY_OUTLIERS, SOME_OUTLIERS, IMBALANCED = 30, 0.95, 1, 0.3, 0.05
WEEKEND, BUSINESS, UNIQUE_TIMES, IRREGULAR = 0.35, 0.50, 0.95, 2


def _pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


def _flag(condition: Column, warn: str = "warn") -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), warn)


def numeric(stats: DataFrame) -> DataFrame:
    """(column_name, flag, severity, ratio) of the flags that are raised, over numeric statistics.

    Needs count, missing, inf, zeros, negatives, min, skew, kurtosis, jb_chi2, int_like,
    unique, heap_pct, outliers_iqr and mode_n; mono_inc and mono_dec if there are. ``ratio`` says how many times its limit a
    measured value is.
    """
    n = F.col("count")
    rows = n + F.col("missing") + F.col("inf")
    miss, neg, zero, out = _pct(F.col("missing"), rows), _pct(F.col("negatives"), n), _pct(F.col("zeros"), n), _pct(F.col("outliers_iqr"), n)
    enough = n * QUASI > 1
    constant = enough & (F.col("unique") == 1)
    skewed = F.col("skew") >= SKEW
    ordered = {f"monotonic_{k}": (_flag((n > 1) & F.col(c), "good"), F.lit(None)) for k, c in (("increasing", "mono_inc"), ("decreasing", "mono_dec")) if c in stats.columns}
    found = {
        **ordered,
        "missing": (F.when(miss > MISSING_BAD, "bad").when(miss > 0, "warn"), miss / MISSING_BAD),
        "infinite": (_flag(F.col("inf") > 0, "bad"), F.lit(None)),
        "negatives": (F.when(neg > NEGATIVE_WARN, "warn").when(neg > 0, "info"), neg / NEGATIVE_WARN),
        "zero_inflated": (F.when(zero >= ZERO_BAD, "bad").when(zero >= ZERO_WARN, "warn"), zero / ZERO_WARN),
        "positive_only": (_flag(F.col("min") > 0, "good"), F.lit(None)),
        "skewed_right": (_flag(skewed), F.col("skew") / SKEW),
        "skewed_left": (_flag(F.col("skew") <= -SKEW), -F.col("skew") / SKEW),
        "log_scale": (_flag((F.col("min") > 0) & skewed, "info"), F.lit(None)),
        "heavy_tailed": (_flag(F.abs("kurtosis") >= KURTOSIS), F.abs("kurtosis") / KURTOSIS),
        "normal": (_flag((n > 0) & (F.col("jb_chi2") <= NORMAL_CHI2), "good"), F.lit(None)),
        "discrete": (_flag(F.col("int_like") & (F.col("unique") > 0) & (F.col("unique") <= DISCRETE_LEVELS), "info"), F.lit(None)),
        "heaping": (_flag(F.col("heap_pct") >= HEAPING, "info"), F.col("heap_pct") / HEAPING),
        "constant": (_flag(constant, "bad"), F.lit(None)),
        "quasi_constant": (_flag(enough & ~constant & ((F.col("unique") <= 2) | (F.col("mode_n") >= QUASI * n))), F.lit(None)),
        "many_outliers": (_flag(out > MANY_OUTLIERS, "bad"), out / MANY_OUTLIERS),
        "some_outliers": (_flag((out > SOME_OUTLIERS) & (out <= MANY_OUTLIERS)), out / SOME_OUTLIERS),
    }
    return _raised(stats, found)


def categorical(stats: DataFrame) -> DataFrame:
    """The same over text statistics: needs count, missing, unique, mode_n, case_variants, trim_variants and empty_zero."""
    n, unique = F.col("count"), F.col("unique")
    miss = _pct(F.col("missing"), n + F.col("missing"))
    found = {
        "missing": (F.when(miss > MISSING_BAD, "bad").when(miss > 0, "warn"), miss / MISSING_BAD),
        "high_cardinality": (_flag(unique > F.greatest(F.lit(200.0), 0.5 * n)), unique / F.greatest(F.lit(200.0), 0.5 * n)),
        "dominant": (_flag((n * 0.7 > 1) & (F.col("mode_n") >= F.floor(0.7 * n))), _pct(F.col("mode_n"), n) / 70),
        "case_variants": (_flag((F.col("case_variants") > 0) & (unique > F.col("case_variants"))), F.lit(None)),
        "trim_variants": (_flag((F.col("trim_variants") > 0) & (unique > F.col("trim_variants"))), F.lit(None)),
        "empty_values": (_flag(F.col("empty_zero") > 0), F.lit(None)),
        "constant": (_flag((n * QUASI > 1) & (unique == 1), "bad"), F.lit(None)),
    }
    return _raised(stats, found)


def boolean(stats: DataFrame) -> DataFrame:
    n = F.col("true") + F.col("false")
    p = F.try_divide(F.col("true"), n)
    miss = _pct(F.col("missing"), n + F.col("missing"))
    one_sided = (n > 0) & ((F.col("true") == 0) | (F.col("false") == 0))
    found = {
        "missing": (F.when(miss > MISSING_BAD, "bad").when(miss > 0, "warn"), miss / MISSING_BAD),
        "constant": (_flag(one_sided, "bad"), F.lit(None)),
        "imbalanced": (_flag(~one_sided & ((p <= IMBALANCED) | (p >= 1 - IMBALANCED))), F.lit(None)),
    }
    return _raised(stats, found)


def temporal(stats: DataFrame) -> DataFrame:
    """Needs count, missing, unique, weekend_ratio, business_hours_ratio, avg_interval_seconds, interval_std_seconds and seasonal_pattern."""
    n = F.col("count")
    miss = _pct(F.col("missing"), n + F.col("missing"))
    found = {
        "missing": (F.when(miss > MISSING_BAD, "bad").when(miss > 0, "warn"), miss / MISSING_BAD),
        "weekend_heavy": (_flag(F.col("weekend_ratio") > WEEKEND, "info"), F.col("weekend_ratio") / WEEKEND),
        "business_hours": (_flag(F.col("business_hours_ratio") > BUSINESS, "info"), F.col("business_hours_ratio") / BUSINESS),
        "mostly_unique": (_flag(F.try_divide(F.col("unique"), n) > UNIQUE_TIMES, "info"), F.lit(None)),
        "irregular": (_flag(F.try_divide(F.col("interval_std_seconds"), F.col("avg_interval_seconds")) > IRREGULAR, "info"), F.lit(None)),
        "seasonal": (_flag(F.col("seasonal_pattern").startswith("Peak"), "info"), F.lit(None)),
    }
    return _raised(stats, found)


def _raised(stats: DataFrame, found: dict[str, tuple[Column, Column]]) -> DataFrame:
    items = [F.struct(F.lit(name).alias("flag"), level.cast("string").alias("severity"), ratio.cast("double").alias("ratio")) for name, (level, ratio) in found.items()]
    return stats.select("column_name", F.inline(F.array(*items))).filter("severity is not null")


#: Warnings of a defect in the data, which call for action; the others tell of the shape of a distribution: fixed values.
ACTIONABLE = ("missing", "zero_inflated", "constant", "quasi_constant", "imbalanced", "high_cardinality", "dominant", "many_rare", "case_variants", "trim_variants", "empty_values")


def triage(raised: DataFrame, k: int = 10) -> DataFrame:
    """(column_name, n_flags, worst, flags): columns with something to act on, the severest first, then by the largest multiple of a limit, the number of flags and the name."""
    acting = raised.filter((F.col("severity") == "bad") | (F.col("severity") == "warn") & F.col("flag").isin(*ACTIONABLE))
    ranked = acting.groupBy("column_name").agg(
        F.max(F.when(F.col("severity") == "bad", 2).otherwise(1)).alias("level"), F.coalesce(F.max("ratio"), F.lit(0.0)).alias("ratio"), F.count("*").alias("n_flags"), F.array_join(F.array_sort(F.collect_list("flag")), ",").alias("flags"),
    )
    best = ranked.orderBy(F.desc("level"), F.desc("ratio"), F.desc("n_flags"), "column_name").limit(k)
    return best.select("column_name", "n_flags", F.when(F.col("level") == 2, "bad").otherwise("warn").alias("worst"), "flags")


def fence_rows(df: DataFrame, x: Column, q1: float, q3: float, k: int = 12) -> DataFrame:
    """(value, n, side, distance, band) of the k most extreme values beyond the quartile fences: moderate, high from 2 and extreme from 3 interquartile ranges."""
    width = q3 - q1
    v = N.finite(x)
    beyond = F.when(v < q1 - 1.5 * width, (F.lit(q1) - v)).when(v > q3 + 1.5 * width, v - q3)
    distance = beyond / F.lit(width) if width else F.when(beyond.isNotNull(), F.lit(float("inf")))
    rows = df.select(v.alias("value"), distance.alias("distance"), F.when(v < q1, "low").otherwise("high").alias("side")).filter("distance is not null")
    top = rows.groupBy("value", "side", "distance").agg(F.count("*").alias("n")).orderBy(F.desc("distance"), "value").limit(k)
    band = F.when(F.col("distance") >= 3, "extreme").when(F.col("distance") >= 2, "high").otherwise("moderate")
    return top.select("value", "n", "side", "distance", band.alias("band"))


def is_identifier(stats: dict) -> bool:
    """``identifier`` of a column's finished statistics."""
    rows, n = stats["count"] + stats["missing"], stats["count"]
    return rows >= 100 and not stats["missing"] and bool(stats["int_like"]) and stats["unique_est"] >= 0.95 * n and bool(stats["mono_inc"] or stats["mono_dec"])


def identifier(count: Column, missing: Column, int_like: Column, unique: Column, inc: Column, dec: Column) -> Column:
    """Whether a numeric column numbers its rows: at least 100 of them, none missing, whole numbers, 95 % different, in order either way."""
    return F.coalesce((count + missing >= 100) & (missing == 0) & int_like & (unique >= 0.95 * count) & (inc | dec), F.lit(False))

"""Queries of the date and time operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import register
from plumbline.operators import categorical as C
from plumbline.operators import temporal as O
from plumbline.operators.ordered import ordered_summary
from plumbline.suite.common import table, tidy, tidy_sql

_RAW = """raw AS (SELECT 'ts' AS column_name, ts AS t FROM events UNION ALL SELECT 'gaps', CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END FROM events),
x AS (SELECT * FROM raw WHERE t IS NOT NULL)"""


def _times(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    df = table(spark, sf_dir, "events").select("ts", F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END").alias("gaps"))
    return df, {"ts": F.col("ts"), "gaps": F.col("gaps")}


@register("dt_bounds", tidy_sql(f"WITH {_RAW} SELECT column_name, count(t) AS count, count(*) - count(t) AS missing, epoch_us(min(t)) * 1000 AS min_ts, epoch_us(max(t)) * 1000 AS max_ts, (epoch_us(max(t)) - epoch_us(min(t))) / 86400000000.0 AS time_span_days FROM raw GROUP BY column_name", "time_span_days"))
def dt_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.scan(*_times(spark, sf_dir)).select("column_name", "count", "missing", "min_ts", "max_ts", "time_span_days"))


_PARTS = {"hour": "hour(t)", "dow": "isodow(t) - 1", "month": "month(t)", "year": "year(t)"}


def _by(part: str):
    @register(f"dt_by_{part}", f"WITH {_RAW} SELECT column_name, {_PARTS[part]} AS bucket, count(*) AS n FROM x GROUP BY ALL")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(O.calendar(*_times(spark, sf_dir)).filter(F.col("part") == part).drop("part"))

    return query


for _part in _PARTS:
    _by(_part)

_CALENDAR = f"{_RAW}, cal AS (" + " UNION ALL ".join(f"SELECT column_name, '{p}' AS part, {e} AS bucket, count(*) AS n FROM x GROUP BY ALL" for p, e in _PARTS.items()) + ")"


@register("dt_calendar_sets", f"WITH {_CALENDAR} SELECT * FROM cal")
def dt_calendar_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.calendar(*_times(spark, sf_dir)))


@register("dt_peaks", f"WITH {_CALENDAR} SELECT * FROM cal QUALIFY row_number() OVER (PARTITION BY column_name, part ORDER BY n DESC, bucket) = 1")
def dt_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.peaks(O.calendar(*_times(spark, sf_dir))))


@register("dt_ratios", tidy_sql(f"""
WITH {_RAW}, s AS (SELECT column_name, avg(CASE WHEN isodow(t) >= 6 THEN 1 ELSE 0 END) AS weekend_ratio, avg(CASE WHEN hour(t) >= 9 AND hour(t) < 17 THEN 1 ELSE 0 END) AS open FROM x GROUP BY ALL)
SELECT column_name, weekend_ratio, open * (1 - weekend_ratio) AS business_hours_ratio FROM s""", "weekend_ratio business_hours_ratio"))
def dt_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.scan(*_times(spark, sf_dir)).select("column_name", "weekend_ratio", "business_hours_ratio"))


@register("dt_seasonal", f"""
WITH {_RAW}, m AS (SELECT column_name, month(t) AS month, count(*) AS n FROM x GROUP BY ALL), b AS (SELECT * FROM m QUALIFY n = max(n) OVER (PARTITION BY column_name))
SELECT column_name, CASE WHEN count(*) = 1 THEN 'Peak in ' || ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][min(month)] ELSE 'Multiple peaks detected' END AS seasonal_pattern FROM b GROUP BY column_name""")
def dt_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.seasonal(O.calendar(*_times(spark, sf_dir)))


@register("dt_intervals", tidy_sql("""
WITH g AS (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts)) / 1e6 AS gap FROM events)
SELECT avg(gap) AS avg_interval_seconds, stddev_pop(gap) AS interval_std_seconds, CASE WHEN stddev_pop(gap) = 0 THEN 'identical' WHEN stddev_pop(gap) / avg(gap) < 0.1 THEN 'regular' ELSE 'irregular' END AS sentence FROM g""", "avg_interval_seconds interval_std_seconds"))
def dt_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.intervals(table(spark, sf_dir, "events"), {"ts": F.col("ts")}).drop("column_name")
    return tidy(found.withColumn("sentence", O.interval_sentence(F.col("avg_interval_seconds"), F.col("interval_std_seconds"))))


@register("dt_timeline", tidy_sql("""
WITH e AS (SELECT epoch_us(o_orderdate) AS us FROM orders), b AS (SELECT min(us) AS lo, max(us) AS hi FROM e)
SELECT least(floor((us - lo) / (hi - lo) * 60), 59) AS bin, count(*) AS n FROM e, b GROUP BY ALL""", "", "bin"))
def dt_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    lo, hi = df.agg(F.min(O.micros(F.col("o_orderdate"))), F.max(O.micros(F.col("o_orderdate")))).first()
    return tidy(O.timeline(df, F.col("o_orderdate"), lo, hi))


@register("dt_unique", f"WITH {_RAW} SELECT column_name, count(DISTINCT t) AS unique_values FROM x GROUP BY column_name")
def dt_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = _times(spark, sf_dir)
    return C.level_facts(C.levels(df, {k: O.micros(c) for k, c in columns.items()})).select("column_name", F.col("unique").alias("unique_values"))


@register("dt_monotonic", """
WITH g AS (SELECT ts - lag(ts) OVER (ORDER BY event_id) AS gap FROM events)
SELECT 'ts' AS column_name, coalesce(bool_and(gap >= INTERVAL 0 SECOND), true) AS mono_inc, coalesce(bool_and(gap <= INTERVAL 0 SECOND), true) AS mono_dec FROM g""")
def dt_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", O.micros(F.col("ts")).alias("ts"))
    return ordered_summary(df, ["ts"], ["event_id"]).select("column_name", "mono_inc", "mono_dec")


@register("dt_flat_verdict", f"""
WITH {_RAW}, s AS (SELECT column_name, 100 * avg(CASE WHEN isodow(t) >= 6 THEN 1 ELSE 0 END) AS w FROM x GROUP BY ALL)
SELECT column_name, CASE WHEN w > 28.57 + 3 THEN 'above flat' WHEN w < 28.57 - 3 THEN 'below flat' ELSE 'flat' END AS weekend_verdict FROM s""")
def dt_flat_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.scan(*_times(spark, sf_dir)).select("column_name", O.flat_verdict(100 * F.col("weekend_ratio"), O.FLAT_WEEKEND).alias("weekend_verdict"))

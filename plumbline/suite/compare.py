"""Queries of comparison and gate: the older half of orders against the newer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import register
from plumbline.operators import boolean as B
from plumbline.operators import categorical as C
from plumbline.operators import check as K
from plumbline.operators import compare as O
from plumbline.operators import dataset as D
from plumbline.operators import numeric as N
from plumbline.operators import quantiles as Q
from plumbline.operators import temporal as W
from plumbline.plans.together import together
from plumbline.suite.common import table, tidy, tidy_sql

_SPLIT = "a AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT * FROM orders WHERE o_orderkey % 3 = 0 AND o_totalprice > 60000)"
_NUMBERS = ("o_custkey", "o_totalprice")


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf_dir, "orders")
    return df.filter("o_orderkey % 3 <> 0"), df.filter("o_orderkey % 3 = 0 and o_totalprice > 60000")


def _numbers(df: DataFrame) -> DataFrame:
    columns = {c: F.col(c).cast("double") for c in _NUMBERS}
    q = Q.quantiles(df, columns, N.QUARTILES)
    quartiles = df.sparkSession.createDataFrame([(c, *[v[p] for p in N.QUARTILES]) for c, v in q.items()], "column_name string, q1 double, median double, q3 double")
    return N.scan(df, columns).select("column_name", "count", "mean", "std", "min", "max").join(quartiles, "column_name")


def _stats_sql(side: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {side}" for c in _NUMBERS)


@register("cmp_numeric", tidy_sql(f"""
WITH {_SPLIT}, x AS ({_stats_sql('a')}), y AS ({_stats_sql('b')})
SELECT x.column_name, (y.mean - x.mean) / x.std AS mean_shift_sigma, (y.median - x.median) / x.std AS median_shift_sigma, (y.q1 - x.q1) / x.std AS q1_shift_sigma, (y.q3 - x.q3) / x.std AS q3_shift_sigma,
       y.std / x.std AS std_ratio, x.min AS min_before, y.min AS min_after, x.max AS max_before, y.max AS max_after FROM x JOIN y USING (column_name)""",
       "mean_shift_sigma median_shift_sigma q1_shift_sigma q3_shift_sigma std_ratio min_before min_after max_before max_after"))
def cmp_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir)
    return tidy(O.numeric_changes(*together(spark, lambda: _numbers(a), lambda: _numbers(b))))


@register("cmp_schema", """
SELECT * FROM (VALUES ('id', 'long', 'long', 'unchanged'), ('gone', 'string', NULL, 'removed'), ('new', NULL, 'date', 'added'), ('kind', 'int', 'string', 'retyped')) t(column_name, before_type, after_type, change)""")
def cmp_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.createDataFrame([("id", "long"), ("gone", "string"), ("kind", "int")], "column_name string, type string")
    b = spark.createDataFrame([("id", "long"), ("new", "date"), ("kind", "string")], "column_name string, type string")
    return O.schema_changes(a, b)


@register("cmp_dataset", tidy_sql(f"WITH {_SPLIT}, n AS (SELECT (SELECT count(*) FROM a) AS x, (SELECT count(*) FROM b) AS y) SELECT x AS rows_before, y AS rows_after, 0.0 AS missing_cells_pct_before, 0.0 AS missing_cells_pct_after, 100.0 * (y - x) / x AS rows_change_pct FROM n", "missing_cells_pct_before missing_cells_pct_after rows_change_pct"))
def cmp_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir)
    return tidy(O.dataset_changes(D.overview(a), D.overview(b)))


def _common(df: DataFrame) -> DataFrame:
    names = {c: F.when(F.col("o_orderkey") % 5 != 0, F.col(c)) if c == "o_orderpriority" else F.col(c) for c in ("o_orderstatus", "o_orderpriority")}
    return C.scan(df, names).select("column_name", "count", "missing").join(C.level_facts(C.levels(df, names)).select("column_name", "unique"), "column_name")


def _common_sql(side: str) -> str:
    return f"SELECT 'o_orderstatus' AS column_name, count(*) AS n, 0 AS m, count(DISTINCT o_orderstatus) AS u FROM {side} UNION ALL SELECT 'o_orderpriority', count(*) FILTER (o_orderkey % 5 <> 0), count(*) FILTER (o_orderkey % 5 = 0), count(DISTINCT o_orderpriority) FILTER (o_orderkey % 5 <> 0) FROM {side}"


@register("cmp_column_common", tidy_sql(f"""
WITH {_SPLIT}, x AS ({_common_sql('a')}), y AS ({_common_sql('b')})
SELECT x.column_name, x.n AS count_before, y.n AS count_after, 100.0 * y.m / (y.n + y.m) - 100.0 * x.m / (x.n + x.m) AS missing_change_pp, 100.0 * (y.u - x.u) / x.u AS unique_change_pct,
       100.0 * (y.u / y.n - x.u / x.n) / (x.u / x.n) AS distinct_rate_change_pct FROM x JOIN y USING (column_name)""", "missing_change_pp unique_change_pct distinct_rate_change_pct"))
def cmp_column_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir)
    return tidy(O.common_changes(_common(a), _common(b)))


@register("cmp_categorical", f"""
WITH {_SPLIT}, x AS (SELECT CAST(o_custkey AS VARCHAR) AS value FROM a GROUP BY ALL ORDER BY count(*) DESC, value LIMIT 50), y AS (SELECT CAST(o_custkey AS VARCHAR) AS value FROM b GROUP BY ALL ORDER BY count(*) DESC, value LIMIT 50)
SELECT 'customer' AS column_name, value, 'entered' AS change FROM y WHERE value NOT IN (SELECT value FROM x) UNION ALL SELECT 'customer', value, 'left' FROM x WHERE value NOT IN (SELECT value FROM y)""")
def cmp_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = [C.top_items(C.levels(df, {"customer": F.col("o_custkey").cast("string")})) for df in halves(spark, sf_dir)]
    return O.categorical_changes(*tops)


@register("cmp_boolean", tidy_sql(f"WITH {_SPLIT} SELECT 'open' AS column_name, 100 * (SELECT avg(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) FROM b) - 100 * (SELECT avg(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) FROM a) AS true_rate_change_pp", "true_rate_change_pp"))
def cmp_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = [B.scan(df, {"open": F.col("o_orderstatus") == "O"}) for df in halves(spark, sf_dir)]
    return tidy(O.boolean_changes(a, b))


@register("cmp_datetime", tidy_sql(f"""
WITH {_SPLIT}, x AS (SELECT epoch_us(min(o_orderdate)) AS lo, epoch_us(max(o_orderdate)) AS hi FROM a), y AS (SELECT epoch_us(min(o_orderdate)) AS lo, epoch_us(max(o_orderdate)) AS hi FROM b)
SELECT 'o_orderdate' AS column_name, (x.hi - x.lo) / 86400000000.0 AS time_span_days_before, (y.hi - y.lo) / 86400000000.0 AS time_span_days_after, x.hi * 1000 AS max_ts_before, y.hi * 1000 AS max_ts_after FROM x, y""", "time_span_days_before time_span_days_after"))
def cmp_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = [W.scan(df, {"o_orderdate": F.col("o_orderdate")}) for df in halves(spark, sf_dir)]
    return tidy(O.datetime_changes(a, b))


@register("chk_findings", f"""
WITH {_SPLIT}, x AS (SELECT count(*) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, quantile_cont(o_totalprice, 0.5) AS med, min(o_totalprice) AS lo FROM a),
y AS (SELECT count(*) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, quantile_cont(o_totalprice, 0.5) AS med, min(o_totalprice) AS lo FROM b)
SELECT 'rows' AS kind, NULL AS "column" FROM y WHERE n < 1000000 UNION ALL SELECT 'rows', NULL FROM x, y WHERE abs(y.n - x.n) / x.n > 0.1
UNION ALL SELECT 'distribution', 'o_totalprice' FROM x, y WHERE abs(y.m - x.m) / x.s > 0.05 UNION ALL SELECT 'distribution', 'o_totalprice' FROM x, y WHERE abs(y.med - x.med) / x.s > 0.05
UNION ALL SELECT 'distribution', 'o_totalprice' FROM x, y WHERE greatest(y.s / x.s, x.s / y.s) > 1.01""")
def chk_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline import api

    a, b = [api.summarize(df.select("o_totalprice"), correlations=False) for df in halves(spark, sf_dir)]
    limits = K.Thresholds(min_rows=1_000_000, max_rows_drift_pct=10.0, max_mean_shift_sigma=0.05, max_median_shift_sigma=0.05, max_std_ratio=1.01, max_unique_drift_pct=None)
    return K.check_payload(b, a, limits).to_frame(spark).select("kind", "column")


_PAIR = """a AS (SELECT value, user_id, user_id % 2 = 0 AS flag, ts, event_type AS old FROM events WHERE event_id % 2 = 0),
b AS (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, user_id * 1000 + event_id % 7 AS user_id, user_id % 4 = 0 AS flag, ts - INTERVAL 1 DAY AS ts, event_type AS new FROM events WHERE event_id % 2 = 1)"""


@register("chk_drifts", f"""
WITH {_PAIR}, x AS (SELECT count(*) AS n, 100.0 * (count(*) - count(value)) / count(*) AS miss, count(DISTINCT user_id) AS u, 100 * avg(CASE WHEN flag THEN 1 ELSE 0 END) AS t, max(ts) AS hi, max(value) AS top, min(value) AS low, max(user_id) AS utop, min(user_id) AS ulow FROM a),
y AS (SELECT count(*) AS n, 100.0 * (count(*) - count(value)) / count(*) AS miss, count(DISTINCT user_id) AS u, 100 * avg(CASE WHEN flag THEN 1 ELSE 0 END) AS t, max(ts) AS hi, max(value) AS top, min(value) AS low, max(user_id) AS utop, min(user_id) AS ulow FROM b)
SELECT 'missing' AS kind, 'value' AS "column" FROM y WHERE miss > 20 UNION ALL SELECT 'missing', 'value' FROM x, y WHERE abs(y.miss - x.miss) > 5
UNION ALL SELECT 'cardinality', 'user_id' FROM x, y WHERE abs(y.u - x.u) / x.u > 0.25 AND abs(y.u / y.n - x.u / x.n) / (x.u / x.n) > 0.25
UNION ALL SELECT 'boolean', 'flag' FROM x, y WHERE abs(y.t - x.t) > 10 UNION ALL SELECT 'freshness', 'ts' FROM x, y WHERE y.hi <= x.hi UNION ALL SELECT 'freshness', 'ts' FROM y WHERE hi < TIMESTAMP '2100-01-01'
UNION ALL SELECT 'range', 'value' FROM x, y WHERE y.top > x.top UNION ALL SELECT 'range', 'value' FROM x, y WHERE y.low < x.low UNION ALL SELECT 'range', 'user_id' FROM x, y WHERE y.utop > x.utop UNION ALL SELECT 'range', 'user_id' FROM x, y WHERE y.ulow < x.ulow
UNION ALL SELECT 'schema', 'old' UNION ALL SELECT 'schema', 'new'""")
def chk_drifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline import api

    e = table(spark, sf_dir, "events")
    a = e.filter("event_id % 2 = 0").selectExpr("value", "user_id", "user_id % 2 = 0 as flag", "ts", "event_type as old")
    b = e.filter("event_id % 2 = 1").selectExpr("if(event_id % 3 = 0, null, value) as value", "user_id * 1000 + event_id % 7 as user_id", "user_id % 4 = 0 as flag", "ts - interval 1 day as ts", "event_type as new")
    before, after = [api.summarize(df, correlations=False) for df in (a, b)]
    limits = K.Thresholds(
        max_missing_pct=20.0, max_age="1d", fail_on_new_column=True, fail_on_range_expansion=True, require_max_ts_advances=True, max_mean_shift_sigma=None, max_median_shift_sigma=None, max_std_ratio=None
    )
    return K.check_payload(after, before, limits, now=4102444800.0 + 86400).to_frame(spark).select("kind", "column")


@register("chk_duplicate_pct", tidy_sql("""
WITH d AS (SELECT l_returnflag, l_linestatus FROM lineitem), n AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS u FROM d)
SELECT 'duplicates' AS kind, NULL AS "column" FROM n WHERE 100.0 * (n - u) / n > 50"""))
def chk_duplicate_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline import api

    now = api.summarize(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"), correlations=False)
    return K.check_payload(now, None, K.Thresholds(max_duplicate_pct=50.0)).to_frame(spark).select("kind", "column")

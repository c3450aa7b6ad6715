"""Queries of the numeric operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import register
from plumbline.operators import categorical as C
from plumbline.operators import numeric as O
from plumbline.operators import ordered
from plumbline.operators import quantiles as Q
from plumbline.suite.common import measures, measures_sql, table, tidy, tidy_sql

_M = measures_sql()
_MOMENTS = f"""
{_M}, means AS (SELECT column_name, avg(v) AS m, count(*) AS n FROM x GROUP BY ALL),
central AS (SELECT x.column_name, avg((v - m) ** 2) AS m2, avg((v - m) ** 3) AS m3, avg((v - m) ** 4) AS m4 FROM x JOIN means USING (column_name) GROUP BY ALL),
stats AS (
  SELECT column_name, n AS count, m AS mean, CASE WHEN n > 1 THEN m2 * n / (n - 1) ELSE 0 END AS variance,
         CASE WHEN n > 2 AND m2 > 0 THEN m3 / m2 ** 1.5 ELSE 0 END AS skew, CASE WHEN n > 2 AND m2 > 0 THEN m4 / m2 ** 2 - 3 ELSE 0 END AS kurtosis
  FROM means JOIN central USING (column_name))
"""


def _scan(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    df, columns = measures(spark, sf_dir)
    return tidy(O.scan(df, columns).select("column_name", *keep))


@register("num_counts", f"""
WITH {_M}
SELECT column_name, count(*) FILTER (v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)) AS count, count(*) FILTER (v IS NULL OR isnan(v)) AS missing,
       count(*) FILTER (isinf(v)) AS inf, count(*) FILTER (v = 0) AS zeros, count(*) FILTER (v < 0 AND NOT isinf(v)) AS negatives
FROM raw GROUP BY column_name""")  # fmt: skip
def num_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "count", "missing", "inf", "zeros", "negatives")


@register("num_moments", tidy_sql(f"WITH {_MOMENTS} SELECT column_name, count, mean, variance, sqrt(variance) AS std, sqrt(variance) / sqrt(count) AS se, sqrt(variance) / abs(mean) AS cv FROM stats", "mean variance std se cv"))
def num_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "count", "mean", "variance", "std", "se", "cv")


def _small(df: DataFrame) -> DataFrame:
    """Shape statistics to six decimals: near zero their digits are those of cancelled sums."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("num_shape", f"WITH {_MOMENTS} SELECT column_name, round(skew, 6) + 0.0 AS skew, round(kurtosis, 6) + 0.0 AS kurtosis FROM stats")
def num_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir)
    return tidy(_small(O.scan(df, columns).select("column_name", "skew", "kurtosis")))


@register("num_jarque_bera", f"WITH {_MOMENTS} SELECT column_name, round(count * (skew ** 2 / 6 + kurtosis ** 2 / 24), 3) AS jb_chi2 FROM stats")
def num_jarque_bera(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir)
    return O.scan(df, columns).select("column_name", F.round("jb_chi2", 3).alias("jb_chi2"))


@register("num_ci95", tidy_sql(f"WITH {_MOMENTS} SELECT column_name, mean - 1.96 * sqrt(variance / count) AS ci_lo, mean + 1.96 * sqrt(variance / count) AS ci_hi FROM stats", "ci_lo ci_hi"))
def num_ci95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "ci_lo", "ci_hi")


@register("num_gmean", tidy_sql(f"WITH {_M} SELECT column_name, coalesce(exp(avg(ln(v)) FILTER (v > 0)), 0) AS gmean, min(v) FILTER (v > 0) AS min_positive, min(v) AS min, max(v) AS max FROM x GROUP BY column_name", "gmean min_positive min max"))
def num_gmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "gmean", "min_positive", "min", "max")


@register("num_int_like", f"WITH {_M} SELECT column_name, bool_and(abs(v - round(v)) < 1e-10) AS int_like FROM x GROUP BY column_name")
def num_int_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "int_like")


@register("num_heaping", tidy_sql(f"""
WITH {_M}, digits AS (
  SELECT column_name, regexp_replace(regexp_replace(CAST(CAST(round(abs(v), 10) AS DECIMAL(38, 10)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.', '') AS d FROM x)
SELECT column_name, 100.0 * count(*) FILTER (right(d, 1) IN ('0', '5')) / count(*) AS heap_pct FROM digits GROUP BY column_name""", "heap_pct"))
def num_heaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "heap_pct")


@register("num_profile", tidy_sql(f"WITH {_MOMENTS} SELECT s.column_name, count, mean, sqrt(variance) AS std, min, max FROM stats s JOIN (SELECT column_name, min(v) AS min, max(v) AS max FROM x GROUP BY ALL) USING (column_name)", "mean std min max"))
def num_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "count", "mean", "std", "min", "max")


_ALL = (*O.QUARTILES, *O.TAILS)
_PS = ", ".join(map(str, _ALL))


@register("num_quantiles", tidy_sql(f"WITH {_M}, q AS (SELECT column_name, quantile_cont(v, [{_PS}]) AS q FROM x GROUP BY column_name) SELECT column_name, unnest([{_PS}])::DOUBLE AS p, unnest(q) AS value FROM q", "p value"))
def num_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir)
    return tidy(Q.quantile_frame(df, columns, _ALL))


@register("num_quantiles_ext", tidy_sql(f"WITH {_M}, q AS (SELECT column_name, quantile_cont(v, [0.01, 0.05, 0.1, 0.25, 0.75, 0.9, 0.95, 0.99]) AS q FROM x GROUP BY column_name) SELECT column_name, q[1] AS p1, q[2] AS p5, q[3] AS p10, q[6] AS p90, q[7] AS p95, q[8] AS p99, q[5] - q[4] AS iqr FROM q", "p1 p5 p10 p90 p95 p99 iqr"))
def num_quantiles_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir)
    found = Q.quantiles(df, columns, (*O.TAILS, 0.25, 0.75))
    rows = [(c, *[q[p] for p in O.TAILS], q[0.75] - q[0.25]) for c, q in found.items()]
    return tidy(spark.createDataFrame(rows, "column_name string, p1 double, p5 double, p10 double, p90 double, p95 double, p99 double, iqr double"))


def _quartiles(df: DataFrame, columns: dict) -> dict:
    return {c: tuple(q[p] for p in O.QUARTILES) for c, q in Q.quantiles(df, columns, O.QUARTILES).items()}


_DEVIATIONS = f"""
{_M}, q AS (SELECT column_name, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY ALL),
d AS (SELECT column_name, quantile_cont(abs(v - med), 0.5) AS mad FROM x JOIN q USING (column_name) GROUP BY ALL)
"""


@register("num_mad", tidy_sql(f"WITH {_DEVIATIONS} SELECT * FROM d", "mad"))
def num_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir)
    return tidy(O.deviations(df, columns).select("column_name", "mad"))


@register("num_outliers_iqr", f"WITH {_DEVIATIONS} SELECT column_name, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers_iqr FROM x JOIN q USING (column_name) GROUP BY column_name")
def num_outliers_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir)
    return O.deviations(df, columns).select("column_name", "outliers_iqr")


@register("num_outliers_mad", f"WITH {_DEVIATIONS} SELECT column_name, count(*) FILTER (mad > 0 AND abs(0.6745 * (v - med) / mad) > 3.5) AS outliers_mod_zscore FROM x JOIN q USING (column_name) JOIN d USING (column_name) GROUP BY column_name")
def num_outliers_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir)
    return O.deviations(df, columns).select("column_name", "outliers_mod_zscore")


@register("num_histogram", tidy_sql(f"""
WITH {_M}, b AS (SELECT column_name, min(v) AS lo, max(v) AS hi FROM x GROUP BY ALL)
SELECT column_name, bin, lo + bin * (hi - lo) / 25 AS lower, CASE WHEN bin = 24 THEN hi ELSE lo + (bin + 1) * (hi - lo) / 25 END AS upper, count(*) AS n
FROM (SELECT column_name, lo, hi, least(floor((v - lo) / (hi - lo) * 25), 24) AS bin FROM x JOIN b USING (column_name)) GROUP BY ALL""", "lower upper", "bin"))
def num_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir)
    return tidy(O.histogram(df, columns, O.bounds(df, columns)))


@register("num_extremes", tidy_sql(f"""
WITH {_M}, k AS (SELECT *, l_orderkey * 8 + l_linenumber AS row_index FROM x),
r AS (SELECT column_name, 'min' AS side, row_number() OVER (PARTITION BY column_name ORDER BY v, row_index) AS rank, v AS value, row_index FROM k
      UNION ALL SELECT column_name, 'max', row_number() OVER (PARTITION BY column_name ORDER BY v DESC, row_index), v, row_index FROM k)
SELECT * FROM r WHERE rank <= 5""", "value"))
def num_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir)
    return tidy(O.extremes(df, columns, F.col("l_orderkey") * 8 + F.col("l_linenumber")))


@register("num_monotonic", tidy_sql("""
WITH o AS (SELECT 'o_orderkey' AS column_name, CAST(o_orderkey AS DOUBLE) AS v, o_orderkey AS k FROM orders
           UNION ALL SELECT 'o_totalprice', o_totalprice, o_orderkey FROM orders UNION ALL SELECT 'back', -CAST(o_orderkey AS DOUBLE), o_orderkey FROM orders),
g AS (SELECT column_name, v, v - lag(v) OVER (PARTITION BY column_name ORDER BY k) AS gap FROM o)
SELECT column_name, count(*) AS n, coalesce(bool_and(gap >= 0), true) AS mono_inc, coalesce(bool_and(gap <= 0), true) AS mono_dec, avg(gap) AS gap_mean, stddev_pop(gap) AS gap_std FROM g GROUP BY column_name""", "gap_mean gap_std"))
def num_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_orderkey")).alias("back"))
    return tidy(ordered.ordered_summary(df, ["o_orderkey", "o_totalprice", "back"], ["o_orderkey"]))


_STEPS = {"discount": "l_discount", "price": "l_extendedprice", "uneven": "CASE WHEN l_linenumber = 1 THEN l_orderkey ELSE 100000 + 0.25 * l_partkey END", "one": "0.0 * l_quantity"}


@register("num_granularity", tidy_sql(f"""
WITH v AS ({" UNION ".join(f"SELECT DISTINCT '{k}' AS column_name, CAST({x} AS DOUBLE) AS v FROM lineitem" for k, x in _STEPS.items())}),
g AS (SELECT column_name, lead(v) OVER (PARTITION BY column_name ORDER BY v) - v AS d FROM v),
f AS (SELECT column_name, min(d) AS lo, max(d) AS hi, least(50, count(d)) AS bins FROM g GROUP BY ALL),
b AS (SELECT column_name, lo, hi, bins, CASE WHEN hi - lo <= abs(hi) * 1e-9 THEN -1 ELSE least(floor((d - lo) / (hi - lo) * bins), bins - 1) END AS bin FROM g JOIN f USING (column_name) WHERE d > 0),
c AS (SELECT *, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, bin) AS nth FROM c),
s AS (SELECT column_name, CASE WHEN bin < 0 THEN (lo + hi) / 2 ELSE lo + (bin + 0.5) * ((hi - lo) / bins) END AS step FROM m WHERE nth = 1)
SELECT column_name, step AS gran_step, CASE WHEN step IS NOT NULL THEN coalesce(list_filter(range(0, 11), lambda k: abs(step * 10 ** k - round(step * 10 ** k)) <= 1e-10)[1], 10) END AS gran_decimals
FROM f LEFT JOIN s USING (column_name)""", "gran_step", "gran_decimals"))
def num_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a few levels, of tens of thousands, of two grids of unlike steps, and of one value."""
    df = table(spark, sf_dir, "lineitem").select(*[F.expr(f"CAST({x} AS DOUBLE)").alias(k) for k, x in _STEPS.items()])
    return tidy(O.granularity(df, {k: F.col(k) for k in _STEPS}))


@register("num_unique", tidy_sql(f"WITH {_M} SELECT column_name, count(DISTINCT v) AS unique_values, count(DISTINCT v) / count(*) AS unique_ratio FROM x GROUP BY column_name", "unique_ratio"))
def num_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir)
    facts = C.level_facts(C.levels(df, {k: O.N.finite(c) + 0.0 for k, c in columns.items()}))
    return tidy(facts.select("column_name", F.col("unique").alias("unique_values"), (F.col("unique") / F.col("count")).alias("unique_ratio")))


@register("num_top_values", tidy_sql(f"""
WITH {_M}, l AS (SELECT column_name, v AS value, count(*) AS n FROM x GROUP BY ALL), k AS (SELECT column_name, count(*) AS levels FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM l)
SELECT column_name, rank, value, n FROM r JOIN k USING (column_name) WHERE rank <= 50 AND (levels <= 50 OR 50.0 / levels >= 0.02)""", "value"))
def num_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir)
    counted = C.levels(df, {k: O.N.finite(c) + 0.0 for k, c in columns.items()})
    sizes = {r["column_name"]: r["unique"] for r in C.level_facts(counted).collect()}  # a row for each column
    tracked = [c for c, n in sizes.items() if O.top_values_tracked(n, C.TOP_K)]
    return tidy(C.top_items(counted.filter(F.col("column_name").isin(tracked))))

"""Queries of the quality flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import register
from plumbline.operators import boolean as B
from plumbline.operators import categorical as C
from plumbline.operators import flags as O
from plumbline.operators import numeric as N
from plumbline.operators import ordered
from plumbline.operators import quantiles as Q
from plumbline.operators import temporal as D
from plumbline.suite.categorical import _LEVELS, texts
from plumbline.suite.common import measures, table, tidy, tidy_sql
from plumbline.suite.numeric import _DEVIATIONS, _MOMENTS


def numeric_table(df: DataFrame, columns: dict) -> DataFrame:
    """All that the numeric flags look at."""
    return N.facts(df, columns)


def _raised_sql(source: str, rules: list[tuple[str, str, str]]) -> str:
    """(column_name, flag, severity, ratio) of rules (flag, severity expression, ratio expression)."""
    return " UNION ALL ".join(f"SELECT column_name, '{flag}' AS flag, {level} AS severity, CAST({ratio} AS DOUBLE) AS ratio FROM {source} WHERE {level} IS NOT NULL" for flag, level, ratio in rules)


def _when(condition: str, level: str = "warn") -> str:
    return f"(CASE WHEN {condition} THEN '{level}' END)"


_NUMERIC = _MOMENTS + f""",
{_DEVIATIONS[_DEVIATIONS.index('q AS (SELECT'):]},
u AS (SELECT column_name, count(*) AS uniq, max(n) AS mode_n FROM (SELECT column_name, v, count(*) AS n FROM x GROUP BY ALL) GROUP BY ALL),
o AS (SELECT column_name, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers, count(*) FILTER (v = 0) AS zeros, count(*) FILTER (v < 0) AS negatives,
      min(v) AS min, bool_and(abs(v - round(v)) < 1e-10) AS int_like FROM x JOIN q USING (column_name) GROUP BY ALL),
r AS (SELECT column_name, count(*) FILTER (v IS NULL OR isnan(v)) AS missing, count(*) FILTER (isinf(v)) AS inf FROM raw GROUP BY ALL),
h AS (SELECT column_name, 100.0 * count(*) FILTER (right(regexp_replace(regexp_replace(CAST(CAST(round(abs(v), 10) AS DECIMAL(38, 10)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.', ''), 1) IN ('0', '5')) / count(*) AS heap FROM x GROUP BY ALL),
f AS (SELECT *, count * (skew ** 2 / 6 + kurtosis ** 2 / 24) AS jb, 100.0 * missing / (count + missing + inf) AS miss, 100.0 * negatives / count AS neg, 100.0 * zeros / count AS zero, 100.0 * outliers / count AS outp
      FROM stats JOIN u USING (column_name) JOIN o USING (column_name) JOIN r USING (column_name) JOIN h USING (column_name))
"""
_NUMERIC_RULES = [
    ("missing", "(CASE WHEN miss > 20 THEN 'bad' WHEN miss > 0 THEN 'warn' END)", "miss / 20"),
    ("infinite", _when("inf > 0", "bad"), "NULL"),
    ("negatives", "(CASE WHEN neg > 10 THEN 'warn' WHEN neg > 0 THEN 'info' END)", "neg / 10"),
    ("zero_inflated", "(CASE WHEN zero >= 50 THEN 'bad' WHEN zero >= 30 THEN 'warn' END)", "zero / 30"),
    ("positive_only", _when("min > 0", "good"), "NULL"),
    ("skewed_right", _when("skew >= 1"), "skew"),
    ("skewed_left", _when("skew <= -1"), "-skew"),
    ("log_scale", _when("min > 0 AND skew >= 1", "info"), "NULL"),
    ("heavy_tailed", _when("abs(kurtosis) >= 3"), "abs(kurtosis) / 3"),
    ("normal", _when("jb <= 5.99", "good"), "NULL"),
    ("discrete", _when("int_like AND uniq <= 50", "info"), "NULL"),
    ("heaping", _when("heap >= 30", "info"), "heap / 30"),
    ("constant", _when("count * 0.95 > 1 AND uniq = 1", "bad"), "NULL"),
    ("quasi_constant", _when("count * 0.95 > 1 AND uniq > 1 AND (uniq <= 2 OR mode_n >= 0.95 * count)"), "NULL"),
    ("many_outliers", _when("outp > 1", "bad"), "outp"),
    ("some_outliers", _when("outp > 0.3 AND outp <= 1"), "outp / 0.3"),
]


@register("flags_numeric", tidy_sql(f"WITH {_NUMERIC} {_raised_sql('f', _NUMERIC_RULES)}", "ratio"))
def flags_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.numeric(numeric_table(*measures(spark, sf_dir))))


_CATEGORICAL = f"""{_LEVELS}, s AS (SELECT column_name, sum(n) AS count, count(*) AS uniq, max(n) AS mode_n, count(DISTINCT lower(value)) AS cv, count(DISTINCT trim(value)) AS tv FROM l GROUP BY ALL),
r AS (SELECT column_name, count(*) - count(value) AS missing, count(*) FILTER (value IN ('', '0')) AS empty FROM raw GROUP BY ALL),
f AS (SELECT *, 100.0 * missing / (count + missing) AS miss FROM s JOIN r USING (column_name))"""
_CATEGORICAL_RULES = [
    ("missing", "(CASE WHEN miss > 20 THEN 'bad' WHEN miss > 0 THEN 'warn' END)", "miss / 20"),
    ("high_cardinality", _when("uniq > greatest(200, 0.5 * count)"), "uniq / greatest(200, 0.5 * count)"),
    ("dominant", _when("count * 0.7 > 1 AND mode_n >= floor(0.7 * count)"), "100.0 * mode_n / count / 70"),
    ("case_variants", _when("cv > 0 AND uniq > cv"), "NULL"),
    ("trim_variants", _when("tv > 0 AND uniq > tv"), "NULL"),
    ("empty_values", _when("empty > 0"), "NULL"),
    ("constant", _when("count * 0.95 > 1 AND uniq = 1", "bad"), "NULL"),
]


@register("flags_categorical", tidy_sql(f"WITH {_CATEGORICAL} {_raised_sql('f', _CATEGORICAL_RULES)}", "ratio"))
def flags_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.categorical(C.summary(*texts(spark, sf_dir))))


@register("flags_boolean", tidy_sql("""
WITH s AS (SELECT 'quality' AS column_name, avg(quality) AS p FROM labels UNION ALL SELECT 'rare', avg(CASE WHEN doc_id % 97 = 0 THEN 1 ELSE 0 END) FROM labels UNION ALL SELECT 'always', 1.0)
SELECT column_name, CASE WHEN p IN (0, 1) THEN 'constant' ELSE 'imbalanced' END AS flag, CASE WHEN p IN (0, 1) THEN 'bad' ELSE 'warn' END AS severity, CAST(NULL AS DOUBLE) AS ratio FROM s WHERE p <= 0.05 OR p >= 0.95""", "ratio"))
def flags_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labels")
    return tidy(O.boolean(B.scan(df, {"quality": F.col("quality") == 1, "rare": F.col("doc_id") % 97 == 0, "always": F.col("doc_id") >= 0})))


@register("flags_datetime", tidy_sql("""
WITH g AS (SELECT ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS gap FROM events),
m AS (SELECT month(ts) AS month, count(*) AS n FROM events GROUP BY ALL), peak AS (SELECT count(*) FILTER (n = top) AS k FROM m, (SELECT max(n) AS top FROM m)),
s AS (SELECT count(*) AS n, count(DISTINCT ts) AS u, avg(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END) AS w, avg(CASE WHEN hour(ts) >= 9 AND hour(ts) < 17 THEN 1 ELSE 0 END) AS o, avg(gap) AS mean, stddev_pop(gap) AS std FROM g),
f AS (SELECT 'weekend_heavy' AS flag, w > 0.35 AS raised, w / 0.35 AS ratio FROM s UNION ALL SELECT 'business_hours', o * (1 - w) > 0.5, o * (1 - w) / 0.5 FROM s
      UNION ALL SELECT 'mostly_unique', u / n > 0.95, NULL FROM s UNION ALL SELECT 'irregular', std / mean > 2, NULL FROM s UNION ALL SELECT 'seasonal', k = 1, NULL FROM peak)
SELECT 'ts' AS column_name, flag, 'info' AS severity, ratio FROM f WHERE raised""", "ratio"))
def flags_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = table(spark, sf_dir, "events"), {"ts": F.col("ts")}
    unique = C.level_facts(C.levels(df, {"ts": D.micros(F.col("ts"))})).select("column_name", "unique")
    gaps = D.intervals(df, columns)
    stats = D.scan(df, columns).join(unique, "column_name").join(gaps, "column_name").join(D.seasonal(D.calendar(df, columns)), "column_name")
    return tidy(O.temporal(stats))


_ACTING = "'missing', 'zero_inflated', 'constant', 'quasi_constant', 'imbalanced', 'high_cardinality', 'dominant', 'many_rare', 'case_variants', 'trim_variants', 'empty_values'"


@register("triage_rank", f"""
WITH {_NUMERIC}, raised AS ({_raised_sql('f', _NUMERIC_RULES)}), acting AS (SELECT * FROM raised WHERE severity = 'bad' OR (severity = 'warn' AND flag IN ({_ACTING})))
SELECT column_name, count(*) AS n_flags, CASE WHEN bool_or(severity = 'bad') THEN 'bad' ELSE 'warn' END AS worst, string_agg(flag, ',' ORDER BY flag) AS flags FROM acting GROUP BY column_name""")
def triage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.triage(O.numeric(numeric_table(*measures(spark, sf_dir))))


@register("fence_rows", tidy_sql("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders),
d AS (SELECT round(o_totalprice, -4) AS value, q1, q3 FROM orders, q), e AS (
  SELECT value, count(*) AS n, CASE WHEN value < q1 THEN 'low' ELSE 'high' END AS side, CASE WHEN value < q1 THEN (q1 - value) / (q3 - q1) ELSE (value - q3) / (q3 - q1) END AS distance
  FROM d WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) GROUP BY ALL)
SELECT *, CASE WHEN distance >= 3 THEN 'extreme' WHEN distance >= 2 THEN 'high' ELSE 'moderate' END AS band FROM e ORDER BY distance DESC, value LIMIT 12""", "value distance"))
def fence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    q = Q.quantiles(df, {"p": F.col("o_totalprice")}, (0.25, 0.75))["p"]
    return tidy(O.fence_rows(df, F.round("o_totalprice", -4), q[0.25], q[0.75]))


@register("identifier_kind", """
SELECT column_name, n >= 100 AND u >= 0.95 * n AND (up OR down) AS identifier FROM (
  SELECT 'o_orderkey' AS column_name, count(*) AS n, count(DISTINCT o_orderkey) AS u, coalesce(bool_and(g >= 0), true) AS up, coalesce(bool_and(g <= 0), true) AS down FROM (SELECT o_orderkey, o_orderkey - lag(o_orderkey) OVER (ORDER BY o_orderkey) AS g FROM orders)
  UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey), coalesce(bool_and(g >= 0), true), coalesce(bool_and(g <= 0), true) FROM (SELECT o_custkey, o_custkey - lag(o_custkey) OVER (ORDER BY o_orderkey) AS g FROM orders))""")
def identifier_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["o_orderkey", "o_custkey"]
    df = table(spark, sf_dir, "orders").select(*[F.col(c).cast("double").alias(c) for c in names])
    columns = {c: F.col(c) for c in names}
    facts = C.level_facts(C.levels(df, columns)).select("column_name", "unique")
    order = ordered.ordered_summary(df, names, ["o_orderkey"]).select("column_name", "mono_inc", "mono_dec")
    rows = N.scan(df, columns).join(facts, "column_name").join(order, "column_name")
    return rows.select("column_name", O.identifier(*[F.col(c) for c in ("count", "missing", "int_like", "unique", "mono_inc", "mono_dec")]).alias("identifier"))


@register("id_facts", "SELECT count(DISTINCT o_orderkey) AS distinct_ids, count(*) - count(DISTINCT o_orderkey) AS duplicates, min(o_orderkey) AS lowest, max(o_orderkey) AS highest, max(o_orderkey) - min(o_orderkey) + 1 - count(DISTINCT o_orderkey) AS gaps FROM orders")
def id_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.count("*").alias("n"))
    return counted.agg(
        F.count("*").alias("distinct_ids"), (F.sum("n") - F.count("*")).alias("duplicates"), F.min("o_orderkey").alias("lowest"), F.max("o_orderkey").alias("highest"),
        (F.max("o_orderkey") - F.min("o_orderkey") + 1 - F.count("*")).alias("gaps"),
    )

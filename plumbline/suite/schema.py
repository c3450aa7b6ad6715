"""Queries of kinds, coercions, sources and whole profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import register
from plumbline.functions import numbers as N
from plumbline.operators import temporal as W
from plumbline.options import STRATEGIES, ComputeOptions
from plumbline.plans import kinds as O
from plumbline.plans import profile as P
from plumbline.sources import readers
from plumbline.suite.common import table, tidy, tidy_sql

_KINDS = {
    "lineitem": ["l_quantity", "l_linenumber", "l_returnflag", "l_shipdate", "l_extendedprice"], "labels": ["quality", "toxic"], "embeddings": ["embedding"],
    "orders": ["o_totalprice", "o_orderstatus", "o_orderdate", "text_price", "text_date"],
}


@register("kind_inference", """
SELECT * FROM (VALUES ('l_quantity', 'categorical'), ('l_linenumber', 'categorical'), ('l_returnflag', 'categorical'), ('l_shipdate', 'datetime'), ('l_extendedprice', 'numeric'),
  ('embedding', 'categorical'), ('o_totalprice', 'numeric'), ('o_orderstatus', 'categorical'), ('o_orderdate', 'datetime'), ('text_price', 'numeric'), ('text_date', 'datetime')) t(column_name, kind)
UNION ALL SELECT column_name, CASE WHEN n >= 100 AND zeros / n <= 0.8 THEN 'boolean' ELSE 'categorical' END FROM (
  SELECT 'quality' AS column_name, count(*) AS n, count(*) FILTER (quality = 0) AS zeros FROM labels UNION ALL SELECT 'toxic', count(*), count(*) FILTER (toxic = 0) FROM labels)""")
def kind_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for name, columns in _KINDS.items():
        df = table(spark, sf_dir, name)
        if name == "orders":
            df = df.withColumn("text_price", F.col("o_totalprice").cast("string")).withColumn("text_date", F.date_format("o_orderdate", "dd/MM/yyyy"))
        found += [(p.name, p.kind) for p in O.classify(df.select(*columns))]
    return spark.createDataFrame(found, "column_name string, kind string")


_TEXTS = {
    "mostly_days": "CASE WHEN o_orderkey % 10 < 9 THEN o_day ELSE 'n/a' END", "days_and_gaps": "CASE WHEN o_orderkey % 4 = 0 THEN o_day END", "late_words": "CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE o_day END",
    "mostly_numbers": "CASE WHEN o_orderkey % 10 < 9 THEN CAST(o_custkey AS STRING) ELSE 'n/a' END", "numbers_and_gaps": "CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_custkey AS STRING) END", "truths": "CASE WHEN o_custkey % 2 = 0 THEN 'Yes' ELSE 'no' END",
}


@register("infer_text_kinds", f"""
WITH o AS (SELECT *, strftime(o_orderdate, '%d/%m/%Y') AS o_day FROM orders), t AS (SELECT {', '.join(f'{x.replace("STRING", "VARCHAR")} AS {c}' for c, x in _TEXTS.items())} FROM o),
x AS (UNPIVOT (SELECT {', '.join(f"coalesce({c}, '') AS {c}" for c in _TEXTS)} FROM t) ON COLUMNS(*) INTO NAME column_name VALUE v),
s AS (SELECT column_name, count(*) AS n, count(nullif(v, '')) AS known, count(try_strptime(v, '%d/%m/%Y')) AS days, count(TRY_CAST(v AS DOUBLE)) AS numbers, count(*) FILTER (lower(v) IN ('true', 'false', '1', '0', 'yes', 'no')) AS truths FROM x GROUP BY ALL),
k AS (SELECT column_name, unnest(['conservative', 'balanced', 'aggressive']) AS inference, n, known, days, numbers, truths FROM s)
SELECT inference, column_name, CASE WHEN inference <> 'conservative' AND days > 0.8 * known THEN 'datetime' WHEN numbers > 0.8 * n THEN 'numeric' WHEN inference = 'aggressive' AND truths > 0.8 * n THEN 'boolean' ELSE 'categorical' END AS kind FROM k""")
def infer_text_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What texts are taken for, over all rows, by each strategy."""
    df = table(spark, sf_dir, "orders").withColumn("o_day", F.date_format("o_orderdate", "dd/MM/yyyy")).select(*[F.expr(x).alias(c) for c, x in _TEXTS.items()])
    found = [(s, p.name, p.kind) for s in STRATEGIES for p in O.classify(df, ComputeOptions(inference=s))]
    return spark.createDataFrame(found, "inference string, column_name string, kind string")


@register("reclass_rules", """
SELECT 'quality' AS column_name, count(*) >= 100 AND min(quality) = 0 AND max(quality) = 1 AND count(*) FILTER (quality NOT IN (0, 1)) = 0 AND count(*) FILTER (quality = 0) / count(*) <= 0.8 AS is_boolean, count(DISTINCT quality) <= 50 AS few_levels FROM labels
UNION ALL SELECT 'toxic', count(*) >= 100 AND min(toxic) = 0 AND max(toxic) = 1 AND count(*) FILTER (toxic NOT IN (0, 1)) = 0 AND count(*) FILTER (toxic = 0) / count(*) <= 0.8, count(DISTINCT toxic) <= 50 FROM labels""")
def reclass_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {p.name: p.kind for p in O.classify(table(spark, sf_dir, "labels").select("quality", "toxic"))}
    return spark.createDataFrame([(c, k == "boolean", k in ("boolean", "categorical")) for c, k in found.items()], "column_name string, is_boolean boolean, few_levels boolean")


@register("force_types", "SELECT * FROM (VALUES ('quality', 'numeric'), ('toxic', 'boolean')) t(column_name, kind)")
def force_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = O.classify(table(spark, sf_dir, "labels").select("quality", "toxic"), ComputeOptions(force_column_types={"quality": "numeric", "toxic": "boolean"}))
    return spark.createDataFrame([(p.name, p.kind) for p in plans], "column_name string, kind string")


@register("coerce_numeric", tidy_sql("SELECT * FROM (VALUES (' 1.5 ', 1.5), ('-2e3', -2000.0), ('5d', NULL), ('abc', NULL), ('', NULL), (NULL, NULL), ('.5', 0.5), ('7.', 7.0)) t(word, value)", "value"))
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(w,) for w in (" 1.5 ", "-2e3", "5d", "abc", "", None, ".5", "7.")], "word string")
    return tidy(df.select("word", N.as_double(F.col("word"), df.schema["word"].dataType).alias("value")))


@register("coerce_datetime", "SELECT * FROM (VALUES ('2024-03-01', 1709251200000000), ('2024-03-01 10:00:00', 1709287200000000), ('2024/03/01', 1709251200000000), ('31/12/2023', 1703980800000000), ('never', NULL), (NULL, NULL)) t(word, us)")
def coerce_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(w,) for w in ("2024-03-01", "2024-03-01 10:00:00", "2024/03/01", "31/12/2023", "never", None)], "word string")
    return df.select("word", W.micros(O.parse_time(F.col("word"))).alias("us"))


@register("proj_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def proj_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.select_columns(table(spark, sf_dir, "orders"), ["o_totalprice", "no_such_column", "o_orderkey"])


@register("proj_dedup_names", "SELECT r_regionkey AS a, r_name AS a_1 FROM region")
def proj_dedup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("a"), F.col("r_name").alias("a")))


_PAYLOAD = {
    "o_totalprice": """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS med, quantile_cont(o_totalprice, 0.75) AS q3, avg(o_totalprice) AS m FROM orders),
      d AS (SELECT quantile_cont(abs(o_totalprice - med), 0.5) AS mad FROM orders, q),
      c AS (SELECT avg((o_totalprice - m) ** 2) AS m2, avg((o_totalprice - m) ** 3) AS m3, avg((o_totalprice - m) ** 4) AS m4 FROM orders, q)
      SELECT count(*) AS count, 0 AS missing, count(DISTINCT o_totalprice) AS unique_est, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min, any_value(q1) AS q1, any_value(med) AS median,
        any_value(q3) AS q3, max(o_totalprice) AS max, count(*) FILTER (o_totalprice = 0) AS zeros, count(*) FILTER (o_totalprice < 0) AS negatives,
        count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS outliers_iqr_est, count(*) FILTER (mad > 0 AND abs(0.6745 * (o_totalprice - med) / mad) > 3.5) AS outliers_mod_zscore,
        0 AS inf, var_samp(o_totalprice) AS variance, any_value(m3 / m2 ** 1.5) AS skew, any_value(m4 / m2 ** 2 - 3) AS kurtosis, stddev_samp(o_totalprice) / abs(avg(o_totalprice)) AS cv, stddev_samp(o_totalprice) / sqrt(count(*)) AS se,
        exp(avg(ln(o_totalprice))) AS gmean, min(o_totalprice) FILTER (o_totalprice > 0) AS min_positive, any_value(q3 - q1) AS iqr, any_value(mad) AS mad, avg(o_totalprice) - 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)) AS ci_lo,
        avg(o_totalprice) + 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)) AS ci_hi, count(*) * any_value((m3 / m2 ** 1.5) ** 2 / 6 + (m4 / m2 ** 2 - 3) ** 2 / 24) AS jb_chi2, count(DISTINCT o_totalprice) / count(*) AS unique_ratio_approx
      FROM orders, q, d, c""",
    "o_orderstatus": """WITH l AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT sum(n) AS t FROM l)
      SELECT any_value(t) AS count, 0 AS missing, count(*) AS unique_est, -sum(n / t * log2(n / t)) AS entropy, sum(length(v) * n) / any_value(t) AS avg_len, 1 AS len_p90, count(*) FILTER (v IN ('', '0')) AS empty_zero,
        count(DISTINCT lower(v)) AS case_variants_est, count(DISTINCT trim(v)) AS trim_variants_est, max(n) / any_value(t) AS most_common_ratio, count(*) / any_value(t) AS diversity_ratio, 1 - sum((n / t) ** 2) AS gini_impurity,
        count(*) FILTER (n = 1) AS singleton_levels, count(*) AS exact_levels FROM l, t""",
    "o_orderdate": """WITH g AS (SELECT o_orderdate AS ts, (epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER (ORDER BY o_orderdate)) / 1e6 AS gap FROM orders)
      SELECT count(*) AS count, 0 AS missing, epoch_us(min(ts)) * 1000 AS min_ts, epoch_us(max(ts)) * 1000 AS max_ts, count(DISTINCT ts) AS unique_est, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6 AS time_span_days,
        avg(gap) AS avg_interval_seconds, stddev_pop(gap) AS interval_std_seconds, avg(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END) AS weekend_ratio,
        avg(CASE WHEN hour(ts) >= 9 AND hour(ts) < 17 THEN 1 ELSE 0 END) * (1 - avg(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END)) AS business_hours_ratio FROM g""",
    "": "SELECT count(*) AS rows_est, 3 AS cols, 0 AS missing_cells, 0 AS missing_cells_pct, count(*) - count(DISTINCT (o_totalprice, o_orderstatus, o_orderdate)) AS duplicate_rows_est FROM orders",
}
_SCALARS = {
    "o_totalprice": "count missing unique_est mean std min q1 median q3 max zeros negatives outliers_iqr_est outliers_mod_zscore inf variance skew kurtosis cv se gmean min_positive iqr mad ci_lo ci_hi jb_chi2 unique_ratio_approx",
    "o_orderstatus": "count missing unique_est entropy avg_len len_p90 empty_zero case_variants_est trim_variants_est most_common_ratio diversity_ratio gini_impurity singleton_levels exact_levels",
    "o_orderdate": "count missing min_ts max_ts unique_est time_span_days avg_interval_seconds interval_std_seconds weekend_ratio business_hours_ratio", "": "rows_est cols missing_cells missing_cells_pct duplicate_rows_est",
}


@register("profile_long", tidy_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, stat, value FROM (UNPIVOT (SELECT {', '.join(f'CAST({x} AS DOUBLE) AS {x}' for x in _SCALARS[c].split())} FROM ({sql})) ON COLUMNS(*) INTO NAME stat VALUE value)" for c, sql in _PAYLOAD.items()
), "value"))
def profile_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All plain statistics of a whole payload."""
    summary = P.payload(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderstatus", "o_orderdate"), ComputeOptions(compute_correlations=False))
    stats = {"": summary["dataset"], **summary["columns"]}
    rows = [(c, k, float(stats[c][k])) for c, names in _SCALARS.items() for k in names.split()]
    return tidy(spark.createDataFrame(rows, "column_name string, stat string, value double"))


@register("ds_composition", "SELECT * FROM (VALUES ('identifier', 1, 17), ('numeric', 2, 33), ('categorical', 2, 33), ('datetime', 1, 17)) t(kind, columns, pct)")
def ds_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = P.payload(table(spark, sf_dir, "orders"), ComputeOptions(compute_correlations=False))
    return tidy(spark.createDataFrame([(k, n, p) for k, (n, p) in P.composition(summary).items()], "kind string, columns int, pct int"))


@register("ds_quick_facts", "SELECT (SELECT count(*) FROM orders) AS rows, 6 AS complete, epoch_us(min(o_orderdate)) * 1000 AS first_ts, epoch_us(max(o_orderdate)) * 1000 AS last_ts, 2 AS text_columns FROM orders")
def ds_quick_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = P.payload(table(spark, sf_dir, "orders"), ComputeOptions(compute_correlations=False))
    f = P.quick_facts(summary)
    return tidy(spark.createDataFrame([(summary["dataset"]["rows_est"], f["complete"], f["first_ts"], f["last_ts"], f["text_columns"])], "rows long, complete int, first_ts long, last_ts long, text_columns int"))


@register("io_chunks", tidy_sql("SELECT i // 4096 AS chunk, min(i) AS start_row, count(*) AS rows FROM (SELECT row_number() OVER () - 1 AS i FROM orders) GROUP BY ALL", "", "chunk start_row"))
def io_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(m["chunk"], m["start_row"], m["rows"]) for _, m in readers.chunks_with_metrics(table(spark, sf_dir, "orders").select("o_orderkey"), 4096)]
    return tidy(spark.createDataFrame(found, "chunk long, start_row long, rows long"))

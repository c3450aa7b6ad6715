"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import register
from plumbline.operators import boolean as B
from plumbline.operators import categorical as O
from plumbline.suite.common import table, tidy, tidy_sql

#: Text columns of part, with missing values and variants put in.
TEXTS = {
    "p_brand": "p_brand",
    "p_type": "p_type",
    "p_name": "p_name",
    "gaps": "CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN '' ELSE p_type END",
    "mixed": "CASE p_size % 4 WHEN 0 THEN upper(p_brand) WHEN 1 THEN concat(' ', p_brand) WHEN 2 THEN lower(p_brand) ELSE p_brand END",
}
_RAW = "raw AS (" + " UNION ALL ".join(f"SELECT '{k}' AS column_name, {v} AS value FROM part" for k, v in TEXTS.items()) + ")"
_LEVELS = f"{_RAW}, l AS (SELECT column_name, value, count(*) AS n FROM raw WHERE value IS NOT NULL GROUP BY ALL)"
_TOP = f"{_LEVELS}, t AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM l QUALIFY rank <= 50), c AS (SELECT column_name, sum(n) AS count, count(*) AS levels FROM l GROUP BY ALL)"


def texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    df = table(spark, sf_dir, "part").select(*[F.expr(v).alias(k) for k, v in TEXTS.items()])
    return df, {k: F.col(k) for k in TEXTS}


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.levels(*texts(spark, sf_dir))


@register("cat_counts", tidy_sql(f"WITH {_RAW} SELECT column_name, count(value) AS count, count(*) - count(value) AS missing, avg(length(value)) AS avg_len, count(*) FILTER (value IN ('', '0')) AS empty_zero FROM raw GROUP BY column_name", "avg_len"))
def cat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.scan(*texts(spark, sf_dir)).select("column_name", "count", "missing", "avg_len", "empty_zero"))


@register("cat_unique", tidy_sql(f"WITH {_LEVELS} SELECT column_name, count(*) AS unique_values, count(*) / sum(n) AS diversity_ratio FROM l GROUP BY column_name", "diversity_ratio"))
def cat_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = O.level_facts(_levels(spark, sf_dir))
    return tidy(facts.select("column_name", F.col("unique").alias("unique_values"), (F.col("unique") / F.col("count")).alias("diversity_ratio")))


@register("cat_singletons", f"WITH {_LEVELS} SELECT column_name, count(*) FILTER (n = 1) AS singleton_levels, count(*) AS exact_levels FROM l GROUP BY column_name HAVING count(*) <= 2048")
def cat_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = O.level_facts(_levels(spark, sf_dir)).filter(F.col("unique") <= O.SINGLETON_LEVELS)
    return facts.select("column_name", F.col("levels_once").alias("singleton_levels"), F.col("unique").alias("exact_levels"))


@register("cat_top_items", f"WITH {_TOP} SELECT column_name, rank, value, n FROM t")
def cat_top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.top_items(_levels(spark, sf_dir)))


@register("cat_entropy_gini", tidy_sql(f"""
WITH {_TOP}, s AS (SELECT column_name, sum(n) AS tracked FROM t GROUP BY ALL)
SELECT column_name, -sum(n / tracked * log2(n / tracked)) AS entropy, 1 - sum((n / tracked) ** 2) AS gini_impurity,
       -sum(n / count * log2(n / count)) AS entropy_of_rows, max(n / count) AS most_common_ratio, coalesce(sum(n / count) FILTER (rank <= 5), 0) AS top5_coverage,
       count(*) FILTER (n / count < 0.01) AS rare_levels, coalesce(sum(n / count) FILTER (n / count < 0.01), 0) AS rare_coverage
FROM t JOIN s USING (column_name) JOIN c USING (column_name) GROUP BY column_name""", "entropy gini_impurity entropy_of_rows most_common_ratio top5_coverage rare_coverage"))
def cat_entropy_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _levels(spark, sf_dir)
    return tidy(O.concentration(O.top_items(counted), O.level_facts(counted)))


@register("cat_entropy_full", tidy_sql(f"WITH {_LEVELS}, s AS (SELECT column_name, sum(n) AS k FROM l GROUP BY ALL) SELECT column_name, -sum(n / k * log2(n / k)) AS entropy_full, 1 - sum((n / k) ** 2) AS gini_full FROM l JOIN s USING (column_name) GROUP BY column_name", "entropy_full gini_full"))
def cat_entropy_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.level_facts(_levels(spark, sf_dir)).select("column_name", "entropy_full", "gini_full"))


@register("cat_lengths", tidy_sql(f"WITH {_RAW} SELECT column_name, avg(length(value)) AS avg_len, floor(quantile_cont(length(value), 0.9)) AS len_p90 FROM raw WHERE value IS NOT NULL GROUP BY column_name", "avg_len", "len_p90"))
def cat_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = texts(spark, sf_dir)
    p90 = O.length_quantile(O.lengths(df, columns)).withColumnRenamed("value", "len_p90")
    return tidy(O.scan(df, columns).select("column_name", "avg_len").join(p90, "column_name"))


_BARS = """
s AS (SELECT column_name, min(length) AS lo, max(length) AS hi, count(*) AS k FROM h GROUP BY ALL),
w AS (SELECT *, CASE WHEN k <= 40 THEN 1 ELSE ceil((hi - lo + 1) / 40) END AS width FROM h JOIN s USING (column_name))
SELECT column_name, lo + floor((length - lo) / width) * width AS lower, lo + floor((length - lo) / width) * width + width - 1 AS upper, sum(n) AS n FROM w GROUP BY ALL
"""


@register("cat_len_hist", tidy_sql(f"WITH {_RAW}, h AS (SELECT column_name, length(value) AS length, count(*) AS n FROM raw WHERE value IS NOT NULL GROUP BY ALL), {_BARS}", "", "lower upper n"))
def cat_len_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.length_bars(O.lengths(*texts(spark, sf_dir))))


@register("cat_len_bars_long", tidy_sql(f"WITH h AS (SELECT 'text' AS column_name, length(text) AS length, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL), {_BARS}", "", "lower upper n"))
def cat_len_bars_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.length_bars(O.lengths(table(spark, sf_dir, "documents"), {"text": F.col("text")})))


@register("cat_case_trim", f"WITH {_LEVELS} SELECT column_name, count(DISTINCT lower(value)) AS case_variants, count(DISTINCT regexp_replace(value, '^\\s+|\\s+$', '', 'g')) AS trim_variants FROM l GROUP BY column_name")
def cat_case_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.variants(_levels(spark, sf_dir))


@register("cat_collisions", tidy_sql(f"WITH {_LEVELS} SELECT column_name, lower(trim(value)) AS key, count(*) AS n_levels, sum(n) AS n FROM l GROUP BY ALL HAVING count(*) > 1", "", "n"))
def cat_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.collisions(_levels(spark, sf_dir))


@register("cat_quality", tidy_sql(f"""
WITH {_TOP}, v AS (SELECT column_name, count(DISTINCT lower(value)) AS case_variants, count(DISTINCT trim(value)) AS trim_variants, max(n) AS mode_n FROM l GROUP BY ALL),
r AS (SELECT column_name, count(*) - count(value) AS missing FROM raw GROUP BY ALL)
SELECT column_name, count, missing, levels AS unique_values, mode_n, case_variants, trim_variants, levels / count AS diversity_ratio FROM c JOIN v USING (column_name) JOIN r USING (column_name)""", "diversity_ratio", "count"))
def cat_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = O.summary(*texts(spark, sf_dir))
    return tidy(s.select("column_name", "count", "missing", F.col("unique").alias("unique_values"), "mode_n", "case_variants", "trim_variants", "diversity_ratio"))


@register("bool_summary", tidy_sql("""
WITH raw AS (
  SELECT 'quality' AS column_name, quality = 1 AS b FROM labels UNION ALL SELECT 'toxic', toxic = 1 FROM labels
  UNION ALL SELECT 'gaps', CASE WHEN doc_id % 4 = 0 THEN NULL ELSE quality = 1 END FROM labels UNION ALL SELECT 'one_sided', doc_id >= 0 FROM labels),
c AS (SELECT column_name, count(b) AS count, count(*) - count(b) AS missing, count(*) FILTER (b) AS t, count(*) FILTER (NOT b) AS f FROM raw GROUP BY ALL),
p AS (SELECT *, t / count AS p, f / count AS q FROM c)
SELECT column_name, count, missing, t AS "true", f AS "false", p AS true_ratio, q AS false_ratio, e AS entropy, abs(p - 0.5) < 0.1 AS is_balanced, abs(e - 1) < 0.1 AS is_uniform
FROM (SELECT *, CASE WHEN p = 0 OR q = 0 THEN 0 ELSE -(p * log2(p) + q * log2(q)) END AS e FROM p)""", "true_ratio false_ratio entropy"))
def bool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labels")
    gaps = F.when(F.col("doc_id") % 4 != 0, F.col("quality") == 1)
    columns = {"quality": B.from_number(F.col("quality")), "toxic": B.from_number(F.col("toxic")), "gaps": gaps, "one_sided": F.col("doc_id") >= 0}
    return tidy(B.scan(df, columns).drop("mem_bytes"))


@register("coerce_bool", """
WITH w AS (SELECT unnest(['Yes', ' TRUE ', 't', '1', 'no', 'F', '0', 'maybe', '', NULL]) AS word)
SELECT word, CASE WHEN lower(trim(word)) IN ('true', '1', 't', 'yes', 'y') THEN true WHEN lower(trim(word)) IN ('false', '0', 'f', 'no', 'n') THEN false END AS value FROM w""")
def coerce_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["Yes", " TRUE ", "t", "1", "no", "F", "0", "maybe", "", None]
    return spark.createDataFrame([(w,) for w in words], "word string").select("word", B.from_text(F.col("word")).alias("value"))

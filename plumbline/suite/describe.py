"""Queries of verdicts on levels, lengths, tails and bins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import register
from plumbline.operators import categorical as C
from plumbline.operators import describe as O
from plumbline.operators import numeric as N
from plumbline.suite.categorical import _TOP, texts
from plumbline.suite.common import measures, table, tidy, tidy_sql
from plumbline.suite.numeric import _DEVIATIONS, _M, _MOMENTS, _quartiles


@register("cat_suppression", tidy_sql(f"""
WITH {_TOP}, s AS (SELECT column_name, sum(n) AS tracked, max(n) AS most, sum(n) FILTER (rank <= 5) AS five FROM t GROUP BY ALL), f AS (SELECT *, tracked = count AS whole FROM s JOIN c USING (column_name))
SELECT column_name, levels, NOT (most = 1 OR (whole AND levels <= 2)) AS show_entropy, NOT (whole AND levels <= 2) AS show_rare, NOT (whole AND levels <= 5) AS show_top5,
       CASE WHEN levels / count >= 0.9 THEN 'identifier-like' WHEN five / count <= 0.02 OR levels / count >= 0.5 THEN 'too many levels' ELSE 'bars' END AS chart, 100.0 / levels AS even_share FROM f""", "even_share", "levels"))
def cat_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = C.levels(*texts(spark, sf_dir))
    return tidy(O.level_verdicts(C.top_items(counted), C.level_facts(counted)))


@register("cat_len_gap", tidy_sql("""
WITH h AS (SELECT 'mixed' AS column_name, length(CASE WHEN doc_id % 3 = 0 THEN repeat('x', CAST(doc_id % 4 + 1 AS INTEGER)) ELSE repeat('x', CAST(40 + doc_id % 7 AS INTEGER)) END) AS length, count(*) AS n FROM documents GROUP BY ALL),
g AS (SELECT column_name, length AS below, lead(length) OVER (ORDER BY length) AS above, sum(n) OVER (ORDER BY length) AS rows_below, sum(n) OVER () AS total, max(length) OVER () - min(length) OVER () AS span FROM h)
SELECT column_name, below, above, rows_below, total - rows_below AS rows_above FROM g QUALIFY above IS NOT NULL AND above - below > min(above - below) OVER () AND (above - below) / span >= 0.12 AND least(rows_below, total - rows_below) >= greatest(5, 0.02 * total)""", "", "below above rows_below rows_above"))
def cat_len_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    mixed = F.when(F.col("doc_id") % 3 == 0, F.expr("repeat('x', cast(doc_id % 4 + 1 as int))")).otherwise(F.expr("repeat('x', cast(40 + doc_id % 7 as int))"))
    return tidy(O.length_gaps(C.lengths(df, {"mixed": mixed})))


@register("tails_verdict", tidy_sql(f"""
WITH {_DEVIATIONS}, r AS (SELECT column_name, 'min' AS side, v AS value, row_number() OVER (PARTITION BY column_name ORDER BY v) AS k FROM x UNION ALL SELECT column_name, 'max', v, row_number() OVER (PARTITION BY column_name ORDER BY v DESC) FROM x),
f AS (SELECT column_name, side, count(*) AS tracked, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS beyond, count(*) - count(DISTINCT value) AS ties FROM r JOIN q USING (column_name) WHERE k <= 5 GROUP BY ALL)
SELECT *, CASE WHEN beyond = 0 THEN 'inside' WHEN beyond = tracked THEN 'all beyond' ELSE 'some beyond' END AS verdict FROM f"""))
def tails_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir)
    quartiles = _quartiles(df, columns)
    fences = spark.createDataFrame([(c, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, _, q3) in quartiles.items()], "column_name string, lo double, hi double")
    return tidy(O.tails(N.extremes(df, columns, F.col("l_orderkey") * 8 + F.col("l_linenumber")), fences))


@register("fence_clusters", tidy_sql("""
WITH m AS (SELECT DISTINCT round(o_totalprice, -4) AS value FROM orders), b AS (SELECT min(value) AS lo, max(value) AS hi FROM m),
g AS (SELECT value, CASE WHEN coalesce((value - lag(value) OVER (ORDER BY value)) / (hi - lo), 1) >= 0.02 THEN 1 ELSE 0 END AS new FROM m, b),
c AS (SELECT value, sum(new) OVER (ORDER BY value) AS cluster FROM g) SELECT cluster, min(value) AS first, max(value) AS last, count(*) AS n FROM c GROUP BY cluster""", "first last", "cluster"))
def fence_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "orders").select(F.round("o_totalprice", -4).alias("value")).distinct()
    lo, hi = marks.agg(F.min("value"), F.max("value")).first()
    return tidy(O.clusters(marks, lo or 0.0, hi or 0.0))


@register("common_values", f"WITH {_TOP} SELECT column_name, rank, value, n FROM t WHERE rank <= 10 AND column_name IN (SELECT column_name FROM t GROUP BY ALL HAVING max(n) > 1)")
def common_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.common_values(C.top_items(C.levels(*texts(spark, sf_dir)))))


def _rebin(bins: int, log: bool):
    y = "log10(o_totalprice)" if log else "o_totalprice"
    name = f"num_hist_rebin_{'log' if log else bins}"

    @register(name, tidy_sql(f"WITH v AS (SELECT {y} AS y FROM orders WHERE o_totalprice > 0), b AS (SELECT min(y) AS lo, max(y) AS hi FROM v) SELECT least(floor((y - lo) / (hi - lo) * {bins}), {bins - 1}) AS bin, count(*) AS n FROM v, b GROUP BY ALL", "", "bin"))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "orders").filter("o_totalprice > 0")
        lo, hi = df.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
        if log:
            lo, hi = math.log10(lo), math.log10(hi)
        return tidy(O.rebinned(df, F.col("o_totalprice"), lo, hi, bins, log))

    return query


for _bins in (10, 50):
    _rebin(_bins, False)
_rebin(25, True)


@register("num_indicators", f"""
WITH {_MOMENTS}, {_DEVIATIONS[_DEVIATIONS.index('q AS (SELECT'):]}, o AS (SELECT column_name, 100.0 * count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / count(*) AS out, 100.0 * count(*) FILTER (v = 0) / count(*) AS zero FROM x JOIN q USING (column_name) GROUP BY ALL),
r AS (SELECT column_name, 100.0 * count(*) FILTER (v IS NULL OR isnan(v)) / count(*) FILTER (v IS NULL OR NOT isinf(v)) AS miss FROM raw GROUP BY ALL),
g AS (SELECT column_name, 'missing' AS indicator, miss AS v, 5 AS a, 20 AS b, 50 AS c FROM r UNION ALL SELECT column_name, 'outliers', out, 1, 5, 10 FROM o UNION ALL SELECT column_name, 'skew', abs(skew), 1, 2, 5 FROM stats UNION ALL SELECT column_name, 'zeros', zero, 30, 50, 90 FROM o)
SELECT column_name, indicator, CASE WHEN v >= c THEN 'critical' WHEN v >= b THEN 'high' ELSE 'medium' END AS severity FROM g WHERE v >= a""")
def num_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir)
    rows = N.scan(df, columns).join(N.deviations(df, columns, _quartiles(df, columns)), "column_name")
    return O.indicators(rows).select("column_name", "indicator", "severity")


@register("num_mem_bytes", f"WITH {_M} SELECT column_name, 8 * count(*) AS mem_bytes FROM raw GROUP BY column_name")
def num_mem_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.scan(*measures(spark, sf_dir)).select("column_name", "mem_bytes")

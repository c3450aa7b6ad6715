"""Queries of the operators on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import register
from plumbline.operators import dataset as O
from plumbline.suite.common import MEASURES, measures, table, tidy, tidy_sql

_GAPPY = {
    "event_id": "event_id", "user_id": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END", "value": "CASE WHEN event_id % 10 = 1 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 10 = 2 THEN NULL ELSE value END",
    "late": "CASE WHEN event_id > 700 THEN NULL ELSE event_type END", "event_type": "event_type",
}
_COLUMNS = ", ".join(f"{v} AS {k}" for k, v in _GAPPY.items())
_MISSING = "m AS (" + " UNION ALL ".join(f"SELECT '{k}' AS column_name, {i} AS position, count(*) FILTER ({k} IS NULL{' OR isnan(value)' if k == 'value' else ''}) AS missing, count(*) AS rows FROM g" for i, k in enumerate(_GAPPY)) + ")"
_G = f"g AS (SELECT {_COLUMNS} FROM events)"


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*[F.expr(v).alias(k) for k, v in _GAPPY.items()])


@register("ds_overview", tidy_sql(f"WITH {_G}, {_MISSING} SELECT any_value(rows) AS rows, 5 AS cols, sum(missing) AS missing_cells, 100.0 * sum(missing) / (any_value(rows) * 5) AS missing_cells_pct FROM m", "missing_cells_pct", "cols missing_cells"))
def ds_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.overview(gappy(spark, sf_dir)))


@register("ds_missing", tidy_sql(f"WITH {_G}, {_MISSING} SELECT column_name, position, missing, rows, 100.0 * missing / rows AS pct FROM m", "pct", "position"))
def ds_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.missing(gappy(spark, sf_dir)))


@register("ds_top_missing", tidy_sql(f"WITH {_G}, {_MISSING} SELECT column_name, 100.0 * missing / rows AS pct, missing AS count FROM m ORDER BY pct DESC, position LIMIT 5", "pct"))
def ds_top_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.top_missing(gappy(spark, sf_dir)))


@register("ds_duplicates", tidy_sql("""
WITH d AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_linenumber END AS line, l_discount FROM lineitem)
SELECT (SELECT count(*) FROM d) AS rows, count(*) AS distinct_rows, (SELECT count(*) FROM d) - count(*) AS duplicates, 100.0 * ((SELECT count(*) FROM d) - count(*)) / (SELECT count(*) FROM d) AS pct FROM (SELECT DISTINCT * FROM d)""", "pct"))
def ds_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.expr("CASE WHEN l_linenumber > 5 THEN NULL ELSE l_linenumber END AS line"), "l_discount")
    return tidy(O.duplicates(df).select("rows", F.col("distinct").alias("distinct_rows"), "duplicates", "pct"))


@register("ds_sample_rows")
def ds_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.sample_rows(table(spark, sf_dir, "orders"), seed=7)


_FOUR = ("l_quantity", "l_extendedprice", "tax_gaps", "disc_odd")
_PAIRS = f"""
wide AS (SELECT {', '.join(f"CASE WHEN isnan({k}) OR isinf({k}) THEN NULL ELSE {k} END AS {k}" for k in _FOUR)} FROM (SELECT {', '.join(f"{v} AS {k}" for k, v in MEASURES.items() if k in _FOUR)} FROM lineitem)),
pairs AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, coalesce(corr({a}, {b}), 0) AS r FROM wide" for i, a in enumerate(_FOUR) for b in _FOUR[i + 1:])})
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir, _FOUR)
    return O.correlations(df, columns)


@register("corr_pairwise", f"WITH {_PAIRS} SELECT a, b, round(r, 9) + 0.0 AS r FROM pairs")
def corr_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", (F.round("r", 9) + 0.0).alias("r"))


@register("corr_top", f"""
WITH {_PAIRS}, d AS (SELECT a AS column_name, b AS partner, r FROM pairs UNION ALL SELECT b, a, r FROM pairs)
SELECT column_name, row_number() OVER (PARTITION BY column_name ORDER BY abs(r) DESC, partner) AS rank, partner, round(r, 9) + 0.0 AS r FROM d""")
def corr_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.correlation_partners(_pairs(spark, sf_dir)).withColumn("r", F.round("r", 9)))


@register("corr_section", f"WITH {_PAIRS} SELECT a, b, round(r, 9) + 0.0 AS r, CASE WHEN abs(r) >= 0.9 THEN 'very strong' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength FROM pairs WHERE abs(r) >= 0.5 OR (SELECT max(abs(r)) FROM pairs) < 0.5")
def corr_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.correlation_section(_pairs(spark, sf_dir)).withColumn("r", F.round("r", 9) + 0.0)


@register("corr_cap", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 9) + 0.0 AS r FROM lineitem")
def corr_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir, _FOUR)
    return O.correlations(df, columns, most=2).withColumn("r", F.round("r", 9) + 0.0)


_CHUNK = 128
_BY_CHUNK = f"""{_G}, c AS (SELECT *, event_id - (SELECT min(event_id) FROM events) AS i FROM g),
by_chunk AS ({' UNION ALL '.join(f"SELECT '{k}' AS column_name, i // {_CHUNK} * {_CHUNK} AS start_row, i // {_CHUNK} * {_CHUNK} + count(*) - 1 AS end_row, count(*) FILTER ({k} IS NULL{' OR isnan(value)' if k == 'value' else ''}) AS missing FROM c GROUP BY i // {_CHUNK}" for k in _GAPPY)})"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = gappy(spark, sf_dir)
    first = df.agg(F.min("event_id")).first()[0] or 0
    return O.missing_by_chunk(df, F.col("event_id") - first, _CHUNK, list(_GAPPY))


@register("miss_per_chunk", tidy_sql(f"WITH {_BY_CHUNK} SELECT * FROM by_chunk", "", "start_row end_row"))
def miss_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


@register("miss_gap_finding", tidy_sql(f"""
WITH {_BY_CHUNK}, s AS (SELECT *, end_row - start_row + 1 AS size FROM by_chunk),
o AS (SELECT column_name, sum(missing) OVER w AS m, sum(size) OVER w AS r, row_number() OVER (PARTITION BY column_name ORDER BY missing / size DESC, start_row) AS k,
      sum(missing) OVER (PARTITION BY column_name) AS all_m, sum(size) OVER (PARTITION BY column_name) AS all_r FROM s
      WINDOW w AS (PARTITION BY column_name ORDER BY missing / size DESC, start_row ROWS UNBOUNDED PRECEDING)),
f AS (SELECT * FROM o WHERE all_m > 0 AND 2 * m >= all_m QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY k) = 1)
SELECT column_name, k AS chunks, r / all_r AS rows_share, m / all_m AS missing_share, CASE WHEN m / all_m >= 1.5 * (r / all_r) THEN 'gap' ELSE 'spread' END AS finding FROM f""", "rows_share missing_share", "chunks"))
def miss_gap_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.missing_concentration(_chunks(spark, sf_dir)))


@register("miss_strip", tidy_sql(f"""
WITH {_BY_CHUNK}, n AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY start_row) - 1 AS nth, count(*) OVER (PARTITION BY column_name) AS k FROM by_chunk)
SELECT column_name, nth // CAST(ceil(k / 60) AS BIGINT) AS segment, sum(missing) AS missing, sum(end_row - start_row + 1) AS rows FROM n GROUP BY ALL""", "", "segment missing rows"))
def miss_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.missing_strip(_chunks(spark, sf_dir)))


@register("miss_heatmap", tidy_sql(f"WITH {_BY_CHUNK} SELECT column_name, start_row, missing / (end_row - start_row + 1) AS share FROM by_chunk WHERE missing > 0", "share", "start_row"))
def miss_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _chunks(spark, sf_dir).filter("missing > 0")
    return tidy(cells.select("column_name", "start_row", (F.col("missing") / (F.col("end_row") - F.col("start_row") + 1)).alias("share")))


@register("miss_severity", f"WITH {_G}, {_MISSING} SELECT column_name, CASE WHEN 100.0 * missing / rows < 5 THEN 'low' WHEN 100.0 * missing / rows <= 20 THEN 'medium' ELSE 'high' END AS severity FROM m")
def miss_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.missing(gappy(spark, sf_dir)).select("column_name", O.severity(F.col("pct")).alias("severity"))


@register("miss_context", tidy_sql(f"""
WITH {_G}, {_MISSING} SELECT column_name, 100.0 * missing / rows AS pct, row_number() OVER w AS rank, count(*) OVER () AS of, lag(column_name) OVER w AS previous, lead(column_name) OVER w AS next
FROM m WHERE missing > 0 WINDOW w AS (ORDER BY 100.0 * missing / rows DESC, position)""", "pct"))
def miss_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.missing_context(gappy(spark, sf_dir)))


@register("miss_analyzer", tidy_sql(f"WITH {_G}, {_MISSING} SELECT column_name, 100.0 * missing / rows AS pct, greatest((SELECT count(*) FROM m WHERE 100.0 * missing / rows > 5) - 5, 0) AS remaining FROM m WHERE 100.0 * missing / rows > 5 ORDER BY pct DESC, position LIMIT 5", "pct"))
def miss_analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = O.missing(gappy(spark, sf_dir)).filter("pct > 5")
    n = over.agg(F.greatest(F.count("*") - 5, F.lit(0)).alias("remaining"))
    return tidy(over.orderBy(F.desc("pct"), "position").limit(5).crossJoin(F.broadcast(n)).select("column_name", "pct", "remaining"))  # one row

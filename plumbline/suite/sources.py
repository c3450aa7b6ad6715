"""Queries of sources, sinks and the gate's plumbing."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import register
from plumbline.errors import ConfigurationError, PlumblineError
from plumbline.operators import check as K
from plumbline.operators import compare as M
from plumbline.operators import flags as G
from plumbline.operators import ordered as O
from plumbline.options import ComputeOptions
from plumbline.plans import kinds
from plumbline.plans import profile as P
from plumbline.shared import new_path
from plumbline.sources import readers, sinks
from plumbline.suite.common import table, tidy, tidy_sql

_SUPPLIERS = tidy_sql("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier", "s_acctbal")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")


def _typed(df: DataFrame) -> DataFrame:
    return tidy(df.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal")))


def _files(form: str, suffix: str, **options: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{new_path(spark, 'source')}{suffix}"
        _suppliers(spark, sf_dir).coalesce(1).write.options(**options).format(form).save(path)
        return _typed(readers.read(path, spark))

    return query


for _name, _form, _suffix, _options in (("src_parquet", "parquet", ".parquet", {}), ("src_csv", "csv", ".csv", {"header": "true"}), ("src_json", "json", ".jsonl", {}), ("src_orc", "orc", ".orc", {})):
    register(_name, _SUPPLIERS)(_files(_form, _suffix, **_options))


@register("src_pandas", _SUPPLIERS)
def src_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(readers.read(_suppliers(spark, sf_dir).toPandas(), spark))


@register("src_arrow", _SUPPLIERS)
def src_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(readers.read(pa.Table.to_reader(_suppliers(spark, sf_dir).toArrow(), max_chunksize=7), spark))


@register("src_iterable", _SUPPLIERS)
def src_iterable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator of frames, one of which lacks no row of the first."""
    frame = _suppliers(spark, sf_dir).toPandas()
    return _typed(readers.read((frame.iloc[i : i + 9] for i in range(0, len(frame), 9)), spark))


@register("src_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders")
def src_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers over files of unequal size: they follow the files' names, and not the order in which tasks read them."""
    path = new_path(spark, "order")
    orders = table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey")
    least = orders.agg(F.min("o_orderkey")).first()[0]
    for k, (lo, hi) in enumerate(((0, 10), (10, 5000), (5000, 5100), (5100, 1 << 60))):
        rows = orders.filter((F.col("o_orderkey") >= least + lo) & (F.col("o_orderkey") < least + hi))
        (rows.coalesce(1) if k < 3 else rows).write.parquet(f"{path}/part{k}")  # the last has as many files as its sort has partitions, named in their order
    return O.with_row_index(spark.read.parquet(*[f"{path}/part{k}" for k in range(4)]).select("o_orderkey"))


@register("sink_json", "SELECT 'region' AS source, count(*) AS rows, count(DISTINCT r_name) AS names FROM region UNION ALL SELECT 'nation', count(*), count(DISTINCT n_name) FROM nation")
def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics as they are read back from JSON."""
    rows = []
    for name, key in (("region", "r_name"), ("nation", "n_name")):
        stats = json.loads(json.dumps(sinks.plain(P.payload(table(spark, sf_dir, name), ComputeOptions(compute_correlations=False))), allow_nan=False))
        rows.append((name, stats["dataset"]["rows_est"], stats["columns"][key]["unique_est"]))
    return spark.createDataFrame(rows, "source string, rows long, names long")


@register("pred_payload_null", """
SELECT stat, CAST(value AS DOUBLE) AS value FROM (VALUES ('count', 0.0), ('missing', 25.0), ('zeros', 0.0), ('unique_est', 0.0), ('mean', NULL), ('std', NULL), ('outliers_iqr_est', NULL), ('outliers_mod_zscore', NULL), ('skew', NULL), ('heap_pct', NULL), ('mono_inc', NULL))
t(stat, value)""")
def pred_payload_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a column without values publishes."""
    stats = P.payload(table(spark, sf_dir, "nation").select(F.lit(None).cast("double").alias("none")))["columns"]["none"]
    names = ("count", "missing", "zeros", "unique_est", "mean", "std", "outliers_iqr_est", "outliers_mod_zscore", "skew", "heap_pct", "mono_inc")
    return spark.createDataFrame([(k, None if stats[k] is None else float(stats[k])) for k in names], "stat string, value double")


@register("coerce_string", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS key_text, CAST(n_nationkey % 2 = 0 AS VARCHAR) AS flag_text, CAST(DATE '2024-01-01' + CAST(n_nationkey AS INTEGER) AS VARCHAR) AS day_text FROM nation")
def coerce_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 2 == 0).alias("flag"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey").cast("int")).alias("day"))
    texts = {n: kinds.as_text(F.col(c), df.schema[c].dataType).alias(n) for n, c in (("key_text", "n_nationkey"), ("flag_text", "flag"), ("day_text", "day"))}
    return df.select("n_nationkey", *texts.values())


@register("flag_monotonic", """
WITH g AS (SELECT 'o_orderkey' AS column_name, o_orderkey - lag(o_orderkey) OVER (ORDER BY o_orderkey) AS gap FROM orders UNION ALL SELECT 'back', lag(o_orderkey) OVER (ORDER BY o_orderkey) - o_orderkey FROM orders
  UNION ALL SELECT 'o_totalprice', o_totalprice - lag(o_totalprice) OVER (ORDER BY o_orderkey) FROM orders)
SELECT column_name, 'monotonic_increasing' AS flag, 'good' AS severity FROM g GROUP BY column_name HAVING bool_and(gap >= 0)
UNION ALL SELECT column_name, 'monotonic_decreasing', 'good' FROM g GROUP BY column_name HAVING bool_and(gap <= 0)""")
def flag_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("double").alias("o_orderkey"), "o_totalprice", (-F.col("o_orderkey")).cast("double").alias("back"))
    summary = P.payload(df, ComputeOptions(compute_correlations=False, order_by=["o_orderkey"]))
    return P.flag_table(spark, summary).filter(F.col("flag").startswith("monotonic")).select("column_name", "flag", "severity")


@register("miss_position", tidy_sql("""
WITH r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, CASE WHEN event_id % 4000 < 900 THEN NULL ELSE value END AS value FROM events)
SELECT i // 700 * 700 AS start_row, max(i) AS end_row, count(*) - count(value) AS missing FROM r GROUP BY i // 700""", "", "start_row end_row"))
def miss_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values by position, as a profile publishes them."""
    df = table(spark, sf_dir, "events").select("event_id", F.expr("CASE WHEN event_id % 4000 < 900 THEN NULL ELSE value END AS value"))
    summary = P.payload(df, ComputeOptions(compute_correlations=False, order_by=["event_id"], chunk_size=700))
    return spark.createDataFrame(summary["dataset"]["missing_by_position"]["value"]["chunks"], "start_row long, end_row long, missing long")


@register("num_approx", """
SELECT 'exact' AS mode, false AS approx, true AS unique_est_exact, count(*) AS n FROM orders UNION ALL SELECT 'approximate', true, false, count(*) FROM orders""")
def num_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_totalprice")
    found = {mode: P.payload(df, ComputeOptions(approximate=mode == "approximate"))["columns"]["o_totalprice"] for mode in ("exact", "approximate")}
    return spark.createDataFrame([(mode, s["approx"], s["unique_est_exact"], s["count"]) for mode, s in found.items()], "mode string, approx boolean, unique_est_exact boolean, n long")


@register("ds_memory", "SELECT 8 * count(*) + sum(strlen(n_name)) AS memory_bytes FROM nation")
def ds_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("double").alias("k"), "n_name")
    summary = P.payload(df, ComputeOptions(force_column_types={"k": "numeric"}))
    return spark.createDataFrame([(summary["dataset"]["memory_bytes"],)], "memory_bytes long")


@register("chk_duration", "SELECT * FROM (VALUES ('26h', 26 * 3600.0::DOUBLE), ('26H', 26 * 3600.0), ('90m', 90 * 60.0), ('3 d', 3 * 86400.0), ('2w', 14 * 86400.0), ('45s', 45.0), ('7', 7.0), ('-3h', NULL), ('soon', NULL), ('5y', NULL)) t(text, seconds)")
def chk_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    def seconds(text: str) -> float | None:
        try:
            return K.seconds(text)
        except ConfigurationError:
            return None

    return spark.createDataFrame([(t, seconds(t)) for t in ("26h", "26H", "90m", "3 d", "2w", "45s", "7", "-3h", "soon", "5y")], "text string, seconds double")


_THRESHOLDS = (
    ("good", {"min_rows": 5, "max_missing_pct": 2.5, "max_age": "3d", "fail_on_new_column": True}, True), ("text for a number", {"max_missing_pct": "5"}, False), ("below zero", {"min_rows": -3}, False),
    ("text for a flag", {"fail_on_new_column": "no"}, False), ("unknown", {"nope": 1}, False), ("a flag for a number", {"min_rows": True}, False), ("ratio below one", {"max_std_ratio": 0.5}, False), ("part of a row", {"min_rows": 1.5}, False),
)


@register("chk_thresholds", f"SELECT * FROM (VALUES {', '.join(f"('{name}', {str(good).lower()})" for name, _, good in _THRESHOLDS)}) t(name, accepted)")
def chk_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables of thresholds are taken."""
    def accepted(raw: dict) -> bool:
        try:
            K.Thresholds.from_mapping(raw)
        except ConfigurationError:
            return False
        return True

    return spark.createDataFrame([(name, accepted(raw)) for name, raw, _ in _THRESHOLDS], "name string, accepted boolean")


@register("cmp_moved", """
WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS d FROM orders)
SELECT 'o_totalprice' AS column_name, abs((SELECT avg(o_totalprice) + d FROM orders) - m) / d > 0 AS moved FROM s UNION ALL SELECT 'o_orderpriority', false""")
def cmp_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two tables, one with its prices raised by a standard deviation, the columns that moved."""
    df = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderpriority")
    d = df.agg(F.stddev_samp("o_totalprice")).first()[0]
    before, after = (P.payload(x, ComputeOptions(compute_correlations=False)) for x in (df, df.withColumn("o_totalprice", F.col("o_totalprice") + d)))
    moved = {c.name if hasattr(c, "name") else c for c in M.compare_payloads(before, after).moved}
    return spark.createDataFrame([(c, c in moved) for c in df.columns], "column_name string, moved boolean")


_GATES = (("as written", {}, True), ("another envelope", {"baseline_version": 99}, False), ("other statistics", {"summary": {"schema_version": 1}}, False))


@register("chk_baseline_gate", f"SELECT * FROM (VALUES {', '.join(f"('{name}', {str(good).lower()})" for name, _, good in _GATES)}) t(name, accepted)")
def chk_baseline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored baselines are read."""
    summary = sinks.plain(P.payload(table(spark, sf_dir, "region")))

    def accepted(changes: dict) -> bool:
        try:
            K.parse_baseline(K.envelope(summary) | changes, "baseline")
        except PlumblineError:
            return False
        return True

    return spark.createDataFrame([(name, accepted(changes)) for name, changes, _ in _GATES], "name string, accepted boolean")


@register("triage_levels", """
SELECT * FROM (VALUES ('heavy_tailed', false), ('some_outliers', false), ('negatives', false), ('skewed_right', false), ('missing', true), ('zero_inflated', true), ('dominant', true), ('many_outliers', true)) t(flag, acts)""")
def triage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which flags alone bring a column into the list of things to act on."""
    flags = [("heavy_tailed", "warn"), ("some_outliers", "warn"), ("negatives", "warn"), ("skewed_right", "warn"), ("missing", "warn"), ("zero_inflated", "warn"), ("dominant", "warn"), ("many_outliers", "bad")]
    raised = spark.createDataFrame([(f, f, s, 1.5) for f, s in flags], "column_name string, flag string, severity string, ratio double")
    acting = {r["column_name"] for r in G.triage(raised).collect()}
    return spark.createDataFrame([(f, f in acting) for f, _ in flags], "flag string, acts boolean")

"""Queries of sketches and streaming state: exact where sketches are, else whether they keep their error bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import register
from plumbline.operators import categorical as C
from plumbline.operators import dataset as D
from plumbline.operators import sketches as O
from plumbline.shared import new_path
from plumbline.streaming import state as S
from plumbline.suite.common import measures, measures_sql, table, tidy, tidy_sql

_TWO = ("l_extendedprice", "tax_gaps")
_M = measures_sql(_TWO)


@register("sk_moments", tidy_sql(f"""
WITH {_M}, m AS (SELECT column_name, avg(v) AS mean FROM x GROUP BY ALL)
SELECT column_name, count(*) AS n, any_value(mean) AS mean, sum((v - mean) ** 2) AS m2, sum((v - mean) ** 4) AS m4 FROM x JOIN m USING (column_name) GROUP BY column_name""", "mean m2 m4"))
def sk_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir, _TWO)
    parts = [O.moments(df.filter(F.pmod("l_orderkey", F.lit(4)) == k), columns) for k in range(4)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return tidy(O.merge_moments(union).select("column_name", "n", "mean", "m2", "m4"))


#: Numbers to one or two significant digits, which an estimate within its error shares with the exact one, unless a limit lies between them.
_ROUGH = "CAST(printf('%.{d}e', CAST({x} AS DOUBLE)) AS DOUBLE)"


def _rough(x, digits: int):
    return F.format_string(f"%.{digits - 1}e", x.cast("double")).cast("double")


def _rough_sql(x: str, digits: int) -> str:
    return _ROUGH.format(d=digits - 1, x=x)


@register("sk_distinct_hll", f"""
WITH {measures_sql(("l_quantity", "l_discount", "tax_gaps", "line", "l_extendedprice"))}, e AS (SELECT column_name, count(DISTINCT v) AS n FROM x GROUP BY column_name)
SELECT column_name, CASE WHEN n < 100 THEN n ELSE {_rough_sql('n', 1)} END AS distinct_values FROM e""")
def sk_distinct_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates: exact for few values, and for many to one significant digit."""
    df, columns = measures(spark, sf_dir, ("l_quantity", "l_discount", "tax_gaps", "line", "l_extendedprice"))
    found = O.distinct(df, {c: O.N.finite(x) + 0.0 for c, x in columns.items()})
    return found.select("column_name", F.when(F.col("unique") < 100, F.col("unique").cast("double")).otherwise(_rough(F.col("unique"), 1)).alias("distinct_values"))


@register("sk_quantiles_kll", f"WITH {_M} SELECT column_name, {_rough_sql('quantile_cont(v, 0.4)', 1)} AS p40 FROM x GROUP BY column_name")
def sk_quantiles_kll(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = measures(spark, sf_dir, _TWO)
    return O.quantiles(df, columns, (0.4,)).select("column_name", _rough(F.col("value"), 1).alias("p40"))


@register("sk_topk", "SELECT 'l_linenumber' AS column_name, CAST(l_linenumber AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY ALL")
def sk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.frequent_values(table(spark, sf_dir, "lineitem"), {"l_linenumber": F.col("l_linenumber").cast("string")}, 10).select("column_name", "value", "n")


@register("sk_kmv_merge", f"SELECT {_rough_sql('count(DISTINCT o_custkey)', 1)} AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders")
def sk_kmv_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of three parts of a table, merged."""
    df = table(spark, sf_dir, "orders")
    parts = [O.distinct_sketches(df.filter(F.pmod("o_orderkey", F.lit(3)) == k), {"c": F.col("o_custkey"), "p": F.col("o_orderpriority")}) for k in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy().pivot("column_name", ["c", "p"]).agg(F.hll_sketch_estimate(F.hll_union_agg("hll")))
    return merged.select(_rough(F.col("c"), 1).alias("customers"), F.col("p").alias("priorities"))


@register("sk_hash", "SELECT count(DISTINCT r_regionkey) AS keys FROM region")
def sk_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "region")
    doubled = df.unionByName(df)
    a, b = D.row_key(doubled)
    return doubled.select(a.alias("a"), b.alias("b")).distinct().agg(F.count("*").alias("keys"))


@register("sk_reservoir", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT NULL, CAST(least(100, count(*)) AS VARCHAR), NULL FROM (SELECT DISTINCT * FROM orders)")
def sk_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table that is smaller than the sample, and the number of different rows of a sample of a larger one."""
    small = O.reservoir(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), 100, seed=3)
    orders = table(spark, sf_dir, "orders")
    large = O.reservoir(orders, 100, seed=3).intersect(orders).agg(F.count("*").alias("n"))
    none = F.lit(None)
    return small.unionByName(large.select(none.cast(small.schema["n_nationkey"].dataType).alias("n_nationkey"), F.col("n").cast("string").alias("n_name"), none.cast(small.schema["n_regionkey"].dataType).alias("n_regionkey")))


@register("sk_seed", "SELECT count(DISTINCT o_orderkey) = 1500 AS own_order, true AS same_again FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1500)")
def sk_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another seed chooses other rows, the same one the same rows."""
    df = table(spark, sf_dir, "orders")
    samples = [sorted(r["o_orderkey"] for r in O.reservoir(df, 50, seed=s).collect()) for s in (1, 1, 2)]
    return spark.createDataFrame([(samples[0] != samples[2], samples[0] == samples[1])], "own_order boolean, same_again boolean")


@register("ds_duplicates_sketch", f"SELECT {_rough_sql('count(*)', 2)} AS rows, {_rough_sql('count(*) - count(DISTINCT (l_partkey, l_linenumber))', 1)} AS duplicates FROM lineitem")
def ds_duplicates_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.duplicates(table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber"), approximate=True)
    return found.select(_rough(F.col("rows"), 2).alias("rows"), _rough(F.col("duplicates"), 1).alias("duplicates"))


@register("st_stream_state", tidy_sql("""
SELECT 'value' AS column_name, count(*) AS rows, count(value) AS n, 0 AS missing, avg(value) AS mean, var_samp(value) AS variance, min(value) AS min, max(value) AS max FROM events""", "mean variance min max", "missing"))
def st_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    query = S.profile_stream(stream, path, ["value"], ["event_type"])
    query.awaitTermination()
    return tidy(S.current(S.read_state(spark, f"{path}/state")).filter("column_name = 'value'").select("column_name", "rows", "n", "missing", "mean", "variance", "min", "max"))


@register("st_windows", tidy_sql("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(value) AS n, avg(value) AS mean FROM events GROUP BY ALL""", "mean"))
def st_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = S.windowed_profile(events, "ts", "value", "1 hour", "10 minutes", by="event_type")
    return tidy(found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean"))

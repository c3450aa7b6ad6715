"""Shared parts of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numbers import rounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to nine significant digits, whole numbers as longs: engines add up in other orders."""
    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (rounded(c.cast("double")) + 0.0).alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("long").alias(f.name)
        return c.alias(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


def tidy_sql(sql: str, doubles: str = "", longs: str = "") -> str:
    """The same over the rows of a query, for the named columns."""
    changes = [f"CAST(printf('%.8e', {c}) AS DOUBLE) + 0.0 AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
    return f"SELECT * REPLACE ({', '.join(changes)}) FROM ({sql})" if changes else sql


#: Measures of lineitem, with missing, NaN and infinite values put in.
MEASURES = {
    "l_quantity": "l_quantity",
    "l_extendedprice": "l_extendedprice",
    "l_discount": "l_discount",
    "tax_gaps": "CASE WHEN l_linenumber > 5 THEN NULL ELSE l_tax END",
    "disc_odd": "CASE WHEN l_linenumber = 7 THEN CAST('Infinity' AS DOUBLE) WHEN l_linenumber = 6 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 5 THEN NULL ELSE l_discount - 0.04 END",
    "line": "CAST(l_linenumber AS DOUBLE)",
}


def measures(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, Column]]:
    chosen = {k: v for k, v in MEASURES.items() if not only or k in only}
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(v).alias(k) for k, v in chosen.items()])
    return df, {k: F.col(k) for k in chosen}


def measures_sql(only: tuple[str, ...] = ()) -> str:
    """CTEs: raw (column_name, v) of all values, and x of the finite ones."""
    parts = [f"SELECT '{k}' AS column_name, {v} AS v, l_orderkey, l_linenumber FROM lineitem" for k, v in MEASURES.items() if not only or k in only]
    return f"raw AS ({' UNION ALL '.join(parts)}), x AS (SELECT * FROM raw WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v))"

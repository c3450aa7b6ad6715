"""Statistics of boolean columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that stand for true and false: fixed values.
TRUE_WORDS = ("true", "1", "t", "yes", "y")
FALSE_WORDS = ("false", "0", "f", "no", "n")

Named = dict[str, Column]


def from_number(x: Column) -> Column:
    return F.when(x == 1, True).when(x == 0, False)


def from_text(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def binary_entropy(p: Column) -> Column:
    """In bits; 0 where one side is empty."""
    q = 1 - p
    return F.when(p.isNull(), None).when((p <= 0) | (q <= 0), 0.0).otherwise(-(p * F.log2(p) + q * F.log2(q)))


def scan(df: DataFrame, columns: Named) -> DataFrame:
    """(column_name, count, missing, true, false, true_ratio, false_ratio, entropy, is_balanced, is_uniform, mem_bytes): one pass."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string")
    flat = df.agg(*[a.alias(f"{i}_{k}") for i, c in enumerate(columns.values()) for k, a in (("t", F.count_if(c)), ("f", F.count_if(~c)), ("m", F.count_if(c.isNull())))])
    long = flat.select(F.inline(F.array(*[F.struct(F.lit(name).alias("column_name"), F.col(f"{i}_t").alias("true"), F.col(f"{i}_f").alias("false"), F.col(f"{i}_m").alias("missing")) for i, name in enumerate(columns)])))
    n = F.col("true") + F.col("false")
    p = F.try_divide(F.col("true"), n)
    h = binary_entropy(p)
    return long.select(
        "column_name", n.alias("count"), "missing", "true", "false", p.alias("true_ratio"), F.try_divide(F.col("false"), n).alias("false_ratio"), h.alias("entropy"),
        (F.abs(p - 0.5) < 0.1).alias("is_balanced"), (F.abs(h - 1) < 0.1).alias("is_uniform"), (n + F.col("missing")).alias("mem_bytes"),
    )

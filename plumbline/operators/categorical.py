"""Statistics of text columns, from one table of levels.

All text columns are unpivoted to (column_name, value) and counted once. Distinct counts,
frequent values, entropy and singletons are aggregates of that table of levels, which
replaces one shuffle of distinct values for each statistic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_K, LENGTH_BARS, SINGLETON_LEVELS = 50, 40, 2_048
#: Share of the rows below which a level is rare.
RARE = 0.01

Named = dict[str, Column]


def stripped(value: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(value, r"^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$", "")


def levels(df: DataFrame, columns: Named) -> DataFrame:
    """(column_name, value, n) of each distinct non-null value."""
    parts = [F.struct(F.lit(name).alias("column_name"), c.alias("value")) for name, c in columns.items()]
    if not parts:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n long")
    rows = df.select(F.explode(F.array(*parts)).alias("v")).select("v.*").filter("value is not null")
    return rows.groupBy("column_name", "value").agg(F.count("*").alias("n"))


#: Bytes of a text up to which it is counted as it is; of a longer one, its beginning and a digest of 128 bits.
SHORT = 96


def short_form(value: Column) -> Column:
    digest = F.concat(F.lpad(F.hex(F.xxhash64(value)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), value)), 16, "0"))
    return F.when(F.octet_length(value) <= SHORT, value).otherwise(F.concat(F.substring(value, 1, 20), F.lit("\0"), digest))


def _rows(df: DataFrame, columns: Named) -> DataFrame:
    parts = [F.struct(F.lit(i).alias("c"), x.alias("v")) for i, x in enumerate(columns.values())]
    return df.select(F.explode(F.array(*parts)).alias("r")).select("r.c", "r.v").filter("v is not null")


def profile_rows(df: DataFrame, columns: Named, k: int) -> list[dict]:
    """Of each column what ``scan``, ``level_facts``, ``variants`` and the 90 % quantile of lengths say, and its ``top`` k values with their numbers, in one job.

    Long texts are counted by their digests, so that they aren't shuffled; those among the
    commonest are looked up in another job. Of equally common values the lesser text comes
    first, of long ones that begin alike the lesser digest.
    """
    if not columns:
        return []
    names = F.array(*[F.lit(c) for c in columns])
    forms = _rows(df, columns).select("c", short_form(F.col("v")).alias("value"), F.xxhash64(F.lower("v")).alias("low"), F.xxhash64(stripped(F.col("v"))).alias("trim"))
    counted = forms.groupBy("c", "value", "low", "trim").agg(F.count("*").alias("n"))
    facts = counted.groupBy("c").agg(
        F.count("*").alias("unique"), F.count_if(F.col("n") == 1).alias("levels_once"), F.count_distinct("low").alias("case_variants"), F.count_distinct("trim").alias("trim_variants"),
    )
    order = Window.partitionBy("c").orderBy(F.desc("n"), F.asc("value"))
    top = counted.select("c", "value", "n").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    tops = top.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))
    own = facts.join(tops, "c").withColumn("column_name", F.get(names, F.col("c")))
    lengths_ = length_quantile(lengths(df, columns)).withColumnRenamed("value", "len_p90")
    found = scan(df, columns).join(own, "column_name", "left").join(lengths_, "column_name", "left").collect()  # a row for each column
    rows = [r.asDict() | {"top": [(t["value"], t["n"]) for t in r["top"] or []]} for r in found]
    long = [(r["c"], value) for r in rows for value, _ in r["top"] if "\0" in value]
    if long:
        asked = F.broadcast(df.sparkSession.createDataFrame(long, "c int, short string"))  # k for each column
        texts = _rows(df, columns).withColumn("short", short_form(F.col("v"))).join(asked, ["c", "short"]).groupBy("c", "short").agg(F.min("v").alias("v")).collect()
        whole = {(t["c"], t["short"]): t["v"] for t in texts}
        for r in rows:
            r["top"] = [(whole.get((r["c"], value), value), n) for value, n in r["top"]]
    return rows


def scan(df: DataFrame, columns: Named) -> DataFrame:
    """(column_name, count, missing, avg_len, empty_zero, mem_bytes): what one scan gives."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string")
    wide = {
        name: {
            "count": F.count(c), "missing": F.count_if(c.isNull()), "avg_len": F.avg(F.length(c)), "empty_zero": F.count_if(c.isin("", "0")),
            "mem_bytes": F.coalesce(F.sum(F.octet_length(c).cast("long")), F.lit(0)),
        }
        for name, c in columns.items()
    }
    flat = df.agg(*[a.alias(f"{i}_{k}") for i, own in enumerate(wide.values()) for k, a in own.items()])
    keys = list(next(iter(wide.values())))
    return flat.select(F.inline(F.array(*[F.struct(F.lit(name).alias("column_name"), *[F.col(f"{i}_{k}").alias(k) for k in keys]) for i, name in enumerate(wide)])))


def level_facts(counted: DataFrame) -> DataFrame:
    """(column_name, count, unique, levels_once, mode_n, entropy_full, gini_full) over all levels."""
    n = F.col("n").cast("double")
    facts = counted.groupBy("column_name").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"), F.count_if(F.col("n") == 1).alias("levels_once"), F.max("n").alias("mode_n"),
        F.sum(n * F.log2(n)).alias("weighted"), F.sum(n * n).alias("squares"),
    )
    total = F.col("count").cast("double")
    return facts.select("column_name", "count", "unique", "levels_once", "mode_n", (F.log2(total) - F.col("weighted") / total).alias("entropy_full"), (1 - F.col("squares") / (total * total)).alias("gini_full"))


def top_items(counted: DataFrame, k: int = TOP_K) -> DataFrame:
    """(column_name, rank, value, n) of the k commonest levels; of equally common ones the lesser text comes first."""
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("column_name", "rank", "value", "n")


def concentration(top: DataFrame, counts: DataFrame) -> DataFrame:
    """Statistics of the tracked levels: entropy and Gini impurity normalised by their sum, shares of all rows of the first five and of rare ones.

    ``counts`` has (column_name, count).
    """
    totals = top.groupBy("column_name").agg(F.sum("n").alias("tracked"))
    rows = top.join(F.broadcast(totals), "column_name").join(F.broadcast(counts.select("column_name", "count")), "column_name")  # a row for each column
    p, share = F.col("n") / F.col("tracked"), F.col("n") / F.col("count")
    return rows.groupBy("column_name").agg(
        (-F.sum(p * F.log2(p)) + 0.0).alias("entropy"),
        (1 - F.sum(p * p)).alias("gini_impurity"),
        (-F.sum(share * F.log2(share)) + 0.0).alias("entropy_of_rows"),
        F.max(share).alias("most_common_ratio"),
        F.coalesce(F.sum(F.when(F.col("rank") <= 5, share)), F.lit(0.0)).alias("top5_coverage"),
        F.count_if(share < RARE).alias("rare_levels"),
        F.coalesce(F.sum(F.when(share < RARE, share)), F.lit(0.0)).alias("rare_coverage"),
    )


def variants(counted: DataFrame) -> DataFrame:
    """(column_name, case_variants, trim_variants): distinct levels after lowering, and after stripping."""
    forms = counted.select("column_name", F.explode(F.array(F.struct(F.lit("case").alias("form"), F.lower("value").alias("v")), F.struct(F.lit("trim").alias("form"), stripped(F.col("value")).alias("v")))).alias("f"))
    distinct = forms.select("column_name", "f.form", "f.v").distinct()
    return distinct.groupBy("column_name").agg(F.count_if(F.col("form") == "case").alias("case_variants"), F.count_if(F.col("form") == "trim").alias("trim_variants"))


def collisions(counted: DataFrame) -> DataFrame:
    """(column_name, key, n_levels, n) of the groups of levels that become one when stripped and lowered."""
    keyed = counted.groupBy("column_name", F.lower(stripped(F.col("value"))).alias("key")).agg(F.count("*").alias("n_levels"), F.sum("n").alias("n"))
    return keyed.filter("n_levels > 1")


def lengths(df: DataFrame, columns: Named) -> DataFrame:
    """(column_name, length, n): how often each length in code points occurs."""
    return levels(df, {name: F.length(c) for name, c in columns.items()}).withColumnRenamed("value", "length")


def length_quantile(counted_lengths: DataFrame, p: float = 0.9) -> DataFrame:
    """(column_name, value) of the interpolated quantile of lengths, cut to a whole number; from the table of lengths, whose size is the number of different lengths."""
    order = Window.partitionBy("column_name").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted_lengths.select("column_name", "length", F.sum("n").over(order).alias("upto"))
    total = counted_lengths.groupBy("column_name").agg(((F.sum("n") - 1) * F.lit(p)).alias("h"))
    rows = upto.join(F.broadcast(total), "column_name")
    at = rows.groupBy("column_name", "h").agg(F.min(F.when(F.col("upto") > F.floor("h"), F.col("length"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("h"), F.col("length"))).alias("b"))
    return at.select("column_name", F.floor(F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))).cast("long").alias("value"))


def length_bars(counted_lengths: DataFrame, most: int = LENGTH_BARS) -> DataFrame:
    """(column_name, lower, upper, n): a bar for each length, or of equal width if there are more than ``most``."""
    span = counted_lengths.groupBy("column_name").agg(F.min("length").alias("lo"), F.max("length").alias("hi"), F.count("*").alias("k"))
    width = F.when(F.col("k") <= most, 1).otherwise(F.ceil((F.col("hi") - F.col("lo") + 1) / most))
    rows = counted_lengths.join(F.broadcast(span), "column_name").withColumn("width", width)
    lower = F.col("lo") + F.floor((F.col("length") - F.col("lo")) / F.col("width")) * F.col("width")
    barred = rows.groupBy("column_name", lower.cast("long").alias("lower"), F.col("width").cast("long").alias("width")).agg(F.sum("n").alias("n"))
    return barred.select("column_name", "lower", (F.col("lower") + F.col("width") - 1).alias("upper"), "n")


def summary(df: DataFrame, columns: Named, k: int = TOP_K) -> DataFrame:
    """A row for each column with all of its statistics but the lists."""
    counted = levels(df, columns)
    facts = level_facts(counted)
    base = scan(df, columns)
    own = (
        base.join(facts.drop("count"), "column_name", "left")
        .join(concentration(top_items(counted, k), facts), "column_name", "left")
        .join(variants(counted), "column_name", "left")
        .join(length_quantile(lengths(df, columns)).withColumnRenamed("value", "len_p90"), "column_name", "left")
    )
    few = F.col("unique") <= SINGLETON_LEVELS
    return own.select(
        "*",
        F.try_divide(F.col("unique"), F.col("count")).alias("diversity_ratio"),
        F.when(few, F.col("levels_once")).alias("singleton_levels"),
        F.when(few, F.col("unique")).alias("exact_levels"),
    )

"""Names for working columns beside a caller's own, and joins that no hot key holds up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.shared import durable


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Each name, with underscores before it until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Keys up to which a list of rows to drop is broadcast: sixteen bytes each.
BROADCAST_ROWS = 1 << 20
#: Hot keys that are joined by broadcast, at most: each has more than one part in so many of all rows.
HOT_KEYS = 4096


def text_mark(docs: DataFrame) -> Column:
    """A digest that tells texts of one doc_id apart."""
    return F.xxhash64(docs["text"])


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text aren't in ``gone`` (doc_id, mark: the text's ``text_mark``); nulls are equal.

    A list of at most BROADCAST_ROWS rows is broadcast, so that texts aren't shuffled; a longer one is joined by shuffle.
    """
    doc, mark = fresh(docs, "dropped_id", "dropped_mark")
    gone = durable(gone.select(F.col("doc_id").alias(doc), F.col("mark").alias(mark)).distinct())  # counted and joined, but found once
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[doc]) & (text_mark(docs) == gone[mark]), "left_anti")


def join_counted(rows: DataFrame, table: DataFrame, key: str, extra: str, salt: Column) -> DataFrame:
    """``rows`` joined to ``table``, which has each pair of ``key`` and ``extra`` (two whole-number columns) once, and ``n``, how many of the rows have it.

    Pairs with more than one part in HOT_KEYS of these rows, of which there can't be more
    than HOT_KEYS, are broadcast, and their rows are spread by ``salt`` in the join of the
    others: no task gets more of them than of other rows. ``extra`` is at least 0.
    """
    total, most = table.agg(F.sum("n"), F.max("n")).first()
    values = [c for c in table.columns if c not in (key, extra, "n")]
    least = max(1000, (total or 0) // HOT_KEYS)
    if (most or 0) <= least:
        return rows.join(table.select(key, extra, *values), [key, extra]).select(*rows.columns, *values)
    cold = table.filter(F.col("n") <= least).select(F.col(key).alias("_key"), F.col(extra).alias("_extra"), *[F.col(c).alias(f"_{c}") for c in values])
    hot = table.filter(F.col("n") > least).select(F.col(key).alias("_hot_key"), F.col(extra).alias("_hot_extra"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    warm = rows.join(F.broadcast(hot), (rows[key] == hot["_hot_key"]) & (rows[extra] == hot["_hot_extra"]), "left")
    spread = F.when(F.col("_hot_key").isNotNull(), -1 - F.pmod(salt, F.lit(1 << 30))).otherwise(F.col(extra)).cast("long").alias("_place")
    warm = warm.select("*", spread)
    found = warm.join(cold, (warm[key] == cold["_key"]) & (warm["_place"] == cold["_extra"].cast("long")), "left").filter("_hot_key is not null or _key is not null")
    return found.select(*rows.columns, *[F.when(F.col("_hot_key").isNotNull(), F.col(f"_hot_{c}")).otherwise(F.col(f"_{c}")).alias(c) for c in values])

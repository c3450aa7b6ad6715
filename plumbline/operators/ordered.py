"""Statistics that depend on the order of rows, without a global window.

Rows have the order of the caller's columns; or, read from files, that of the files' names
and of the rows in them (Spark deals files to tasks by size, so the order of tasks says
nothing); or, made from data in memory, that of the data. What has been joined, grouped or
dealt anew has no order, and nothing is said about it. With a caller's order, rows are range-partitioned by their order and sorted within partitions. Each partition is
scanned once, in array operations, to a row of first and last values, direction and sums of
gaps; these few rows are then put together in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PART = "part long, column_name string, n long, first double, last double, up boolean, down boolean, gaps long, total double, squares double, base double"


@dataclass(frozen=True)
class Blocks:
    """The pieces of files that tasks read, in the order of the files' names: by the row id that each one begins with, its place in that order, its first row's number, and its rows."""

    first: np.ndarray
    place: np.ndarray
    start: np.ndarray
    rows: np.ndarray


_PARTS = pa.schema(
    [("part", pa.int64()), ("column_name", pa.string()), ("n", pa.int64()), ("first", pa.float64()), ("last", pa.float64()), ("up", pa.bool_()), ("down", pa.bool_()),
     ("gaps", pa.int64()), ("total", pa.float64()), ("squares", pa.float64()), ("base", pa.float64())]
)


def _source(df: DataFrame) -> str | None:
    """Whether rows come as they are from ``files`` or from data in ``memory``."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    kind = plan.getClass().getSimpleName()
    if kind == "LogicalRelation":
        return "files" if plan.relation().getClass().getSimpleName() == "HadoopFsRelation" else None
    return "memory" if kind in ("LocalRelation", "LogicalRDD", "ExternalRDD", "Range") else None


def has_order(df: DataFrame) -> bool:
    """Whether rows have an order of their own."""
    return _source(df) is not None


def blocks(df: DataFrame) -> Blocks:
    """The pieces of the files of ``df``; a row for each reaches the driver."""
    tagged = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    found = sorted(tagged.groupBy("f", "b").agg(F.min("m").alias("m"), F.count("*").alias("n")).collect())
    sizes = np.array([r["n"] for r in found], np.int64)
    ids = np.array([r["m"] for r in found], np.int64)
    order = np.argsort(ids)
    return Blocks(ids[order], order, (np.cumsum(sizes) - sizes)[order], sizes[order])


def _partial(columns: list[str], pieces: Blocks | None = None):
    """A state for each column and partition, or piece of a file; the last column of the input is then the row id."""
    from pyspark import TaskContext

    def fresh() -> dict[str, dict]:
        return {c: {"n": 0, "first": None, "last": None, "up": True, "down": True, "gaps": 0, "total": 0.0, "squares": 0.0, "base": None} for c in columns}

    def add(s: dict, v: np.ndarray) -> None:
        v = v[np.isfinite(v)]
        if not len(v):
            return
        if s["first"] is None:
            s["first"] = float(v[0])
        else:
            v = np.concatenate([[s["last"]], v])
        d = np.diff(v)
        s["n"] += len(d) if s["n"] else len(v)
        s["last"] = float(v[-1])
        if len(d):
            if s["base"] is None:
                s["base"] = float(d[0])
            s["up"], s["down"] = s["up"] and bool((d >= 0).all()), s["down"] and bool((d <= 0).all())
            off = d - s["base"]  # sums about a gap of the partition, so that squares keep their digits
            s["gaps"], s["total"], s["squares"] = s["gaps"] + len(d), s["total"] + float(off.sum()), s["squares"] + float((off * off).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, dict[str, dict]] = {}
        for batch in batches:
            if pieces is None:
                runs = [(TaskContext.get().partitionId(), 0, batch.num_rows)]
            else:
                at = np.searchsorted(pieces.first, batch.column(len(columns)).to_numpy(), "right") - 1
                cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]).tolist() if len(at) else []
                runs = [(int(pieces.place[at[a]]), a, b) for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True)]
            for part, a, b in runs:
                state = states.setdefault(part, fresh())
                for i, c in enumerate(columns):
                    add(state[c], batch.column(i)[a:b].to_numpy(zero_copy_only=False).astype(np.float64))
        rows = [{"part": part, "column_name": c, **s} for part, state in states.items() for c, s in state.items() if s["n"]]
        yield pa.RecordBatch.from_pylist(rows, schema=_PARTS)

    return run


def _partial_long(names: list[str]):
    """As ``_partial`` for rows (c, v), c being the number of a column."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(k: int) -> Iterator[pa.RecordBatch]:
            for c, v in seen:
                yield pa.RecordBatch.from_arrays([pa.array(v[c == k], from_pandas=True)], ["v"])

        part = TaskContext.get().partitionId()
        held: dict[int, list] = {}
        for batch in batches:  # sorted by column, so that one state at a time is open
            seen = [(batch.column("c").to_numpy(), batch.column("v").to_numpy(zero_copy_only=False))]
            for k in np.unique(seen[0][0]).tolist():
                (found,) = _partial(["v"])(of(k))
                held.setdefault(k, []).extend(found.to_pylist())
        rows = [{**r, "part": part * (1 << 20) + i, "column_name": names[k]} for k, own in held.items() for i, r in enumerate(own)]
        yield pa.RecordBatch.from_pylist(rows, schema=_PARTS)

    return run


def _combined(parts: DataFrame) -> DataFrame:
    order = Window.partitionBy("column_name").orderBy("part")  # a row for each partition
    rows = parts.withColumn("jump", F.col("first") - F.lag("last").over(order))
    gap_sum = F.coalesce(F.col("total") + F.col("gaps") * F.col("base"), F.lit(0.0)) + F.coalesce("jump", F.lit(0.0))
    n_gaps = F.col("gaps") + F.when(F.col("jump").isNotNull(), 1).otherwise(0)
    facts = rows.groupBy("column_name").agg(
        F.sum("n").alias("n"), F.sum(n_gaps).alias("gaps"), F.sum(gap_sum).alias("sum"),
        F.bool_and(F.col("up") & F.coalesce(F.col("jump") >= 0, F.lit(True))).alias("mono_inc"), F.bool_and(F.col("down") & F.coalesce(F.col("jump") <= 0, F.lit(True))).alias("mono_dec"),
    )
    mean = F.try_divide(F.col("sum"), F.col("gaps"))
    joined = rows.join(F.broadcast(facts.select("column_name", mean.alias("mean"))), "column_name")
    off = F.col("base") - F.col("mean")
    spread = F.coalesce(F.col("squares") + 2 * off * F.col("total") + F.col("gaps") * off * off, F.lit(0.0)) + F.coalesce((F.col("jump") - F.col("mean")) * (F.col("jump") - F.col("mean")), F.lit(0.0))
    squares = joined.groupBy("column_name").agg(F.sum(spread).alias("spread"))
    return facts.join(squares, "column_name").select("column_name", "n", "mono_inc", "mono_dec", mean.alias("gap_mean"), F.sqrt(F.try_divide(F.greatest("spread", F.lit(0.0)), F.col("gaps"))).alias("gap_std"))


def ordered_summary(df: DataFrame, columns: list[str], order_by: list[str | Column] | None = None) -> DataFrame:
    """(column_name, n, mono_inc, mono_dec, gap_mean, gap_std) of numeric columns in the order of ``order_by``, or else in that of their source.

    Missing and infinite values are passed over; ties count for both directions; a column
    with at most one value is monotonic both ways; a column without values has no row, nor
    has any column of rows without an order.
    """
    values = [F.col(f"`{c}`").cast("double").alias(c) for c in columns]
    if order_by:
        rows = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
        return _combined(rows.select(*values).mapInArrow(_partial(columns), _PART))
    source = _source(df)
    if source == "files":
        rows = df.select(*values, F.monotonically_increasing_id().alias("__id"))
        return _combined(rows.mapInArrow(_partial(columns, blocks(df)), _PART))
    if source is None:
        return df.sparkSession.createDataFrame([], "column_name string, n long, mono_inc boolean, mono_dec boolean, gap_mean double, gap_std double")
    return _combined(df.select(*values).mapInArrow(_partial(columns), _PART))


def sorted_gaps(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column_name, n, mono_inc, mono_dec, gap_mean, gap_std) of each column's values in their own order: one sort for all columns."""
    parts = [F.struct(F.lit(i).alias("c"), x.cast("double").alias("v")) for i, x in enumerate(columns.values())]
    rows = df.select(F.explode(F.array(*parts)).alias("r")).select("r.c", "r.v").filter("v is not null")
    return _combined(rows.repartitionByRange("c", "v").sortWithinPartitions("c", "v").mapInArrow(_partial_long(list(columns)), _PART))


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """``df`` with the number of each row, from 0, in the order of its source; null if there is no order.

    The source is read once to count and again to number, so sorted rows must be kept (``durable``) first.
    """
    source = _source(df)
    if source is None:
        return df.withColumn(name, F.lit(None).cast("long"))
    raw = df.withColumn(name, F.monotonically_increasing_id())
    part = F.shiftrightunsigned(F.col(name), 33)
    if source == "files":
        found = blocks(df)
        table = [(int(i) >> 33, int(i), int(i) + int(n), int(s) - int(i)) for i, n, s in zip(found.first, found.rows, found.start, strict=True)]
    else:
        sizes = sorted((r["p"], r["n"]) for r in raw.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
        table, before = [], 0
        for p, n in sizes:
            table.append((p, p << 33, (p << 33) + n, before - (p << 33)))
            before += n
    places = df.sparkSession.createDataFrame(table, "_part long, _from long, _to long, _shift long")
    here = (part == F.col("_part")) & (F.col(name) >= F.col("_from")) & (F.col(name) < F.col("_to"))
    return raw.join(F.broadcast(places), here).withColumn(name, F.col(name) + F.col("_shift")).select(*[F.col(f"`{c}`") for c in df.columns], name)  # a row for each piece of a file

"""What changed between two profiles: joins of two small tables of statistics, and the same over payloads."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relative(before: Column, after: Column) -> Column:
    """Change in per cent of the first value's size; null from zero."""
    return F.try_divide(100.0 * (after - before), F.abs(before))


def in_sigmas(before: Column, after: Column, sigma: Column) -> Column:
    """A shift in standard deviations of the first side; null without one."""
    return F.when(sigma > 0, (after - before) / sigma)


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column_name, before_type, after_type, change) of two tables (column_name, type): added, removed, retyped or unchanged."""
    a, b = before.select("column_name", F.col("type").alias("before_type")), after.select("column_name", F.col("type").alias("after_type"))
    change = F.when(F.col("before_type").isNull(), "added").when(F.col("after_type").isNull(), "removed").when(F.col("before_type") != F.col("after_type"), "retyped").otherwise("unchanged")
    return a.join(b, "column_name", "full").select("column_name", "before_type", "after_type", change.alias("change"))


def _sides(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.alias("a").join(after.alias("b"), F.col("a.column_name") == F.col("b.column_name"))


def numeric_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shifts of mean, median and quartiles in standard deviations of the first side, ratio of deviations, and both ranges; of two tables of numeric statistics."""
    sigma = F.col("a.std")
    shifts = [in_sigmas(F.col(f"a.{c}"), F.col(f"b.{c}"), sigma).alias(f"{c}_shift_sigma") for c in ("mean", "median", "q1", "q3")]
    ranges = [F.col(f"{side}.{c}").alias(f"{c}_{name}") for c in ("min", "max") for side, name in (("a", "before"), ("b", "after"))]
    return _sides(before, after).select(F.col("a.column_name").alias("column_name"), *shifts, F.try_divide(F.col("b.std"), sigma).alias("std_ratio"), *ranges)


def common_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts, missing shares in points, and relative changes of distinct counts and rates; of two tables (column_name, count, missing, unique)."""
    pct = lambda s: F.coalesce(F.try_divide(100.0 * F.col(f"{s}.missing"), F.col(f"{s}.count") + F.col(f"{s}.missing")), F.lit(0.0))
    rate = lambda s: F.try_divide(F.col(f"{s}.unique"), F.col(f"{s}.count"))
    return _sides(before, after).select(
        F.col("a.column_name").alias("column_name"), F.col("a.count").alias("count_before"), F.col("b.count").alias("count_after"), (pct("b") - pct("a")).alias("missing_change_pp"),
        relative(F.col("a.unique"), F.col("b.unique")).alias("unique_change_pct"), relative(rate("a"), rate("b")).alias("distinct_rate_change_pct"),
    )


def categorical_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column_name, value, change) of frequent values that entered or left; of two tables (column_name, value) of the same number of them."""
    keys = ["column_name", "value"]
    entered = after.select(*keys).join(before.select(*keys), keys, "left_anti").withColumn("change", F.lit("entered"))
    left = before.select(*keys).join(after.select(*keys), keys, "left_anti").withColumn("change", F.lit("left"))
    return entered.unionByName(left)


def boolean_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    rate = lambda s: F.try_divide(100.0 * F.col(f"{s}.true"), F.col(f"{s}.true") + F.col(f"{s}.false"))
    return _sides(before, after).select(F.col("a.column_name").alias("column_name"), (rate("b") - rate("a")).alias("true_rate_change_pp"))


def datetime_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    picks = [F.col(f"{s}.{c}").alias(f"{c}_{name}") for c in ("time_span_days", "max_ts") for s, name in (("a", "before"), ("b", "after"))]
    return _sides(before, after).select(F.col("a.column_name").alias("column_name"), *picks)


def dataset_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of two overviews of one row each."""
    pairs = before.alias("a").crossJoin(F.broadcast(after.alias("b")))
    both = [F.col(f"{s}.{c}").alias(f"{c}_{name}") for c in ("rows", "missing_cells_pct") for s, name in (("a", "before"), ("b", "after"))]
    return pairs.select(*both, relative(F.col("a.rows"), F.col("b.rows")).alias("rows_change_pct"))


# The same over payloads, which are small.


def number(value: Any) -> float | None:
    if value is None or isinstance(value, (bool, str)):
        return None
    value = float(value)
    return None if math.isnan(value) else value


def change_pct(before: Any, after: Any) -> float | None:
    a, b = number(before), number(after)
    return None if a is None or b is None or a == 0 else (b - a) / abs(a) * 100.0


def shift(before: Any, after: Any, sigma: Any) -> float | None:
    a, b, s = number(before), number(after), number(sigma)
    return None if a is None or b is None or s is None or s <= 0 else (b - a) / s


def missing_pct(stats: Mapping[str, Any]) -> float:
    total = (stats.get("count") or 0) + (stats.get("missing") or 0)
    return 100.0 * (stats.get("missing") or 0) / total if total else 0.0


def true_pct(stats: Mapping[str, Any]) -> float | None:
    total = (stats.get("true") or 0) + (stats.get("false") or 0)
    return 100.0 * stats["true"] / total if total else None


@dataclass(frozen=True)
class SchemaDelta:
    added: dict[str, str] = field(default_factory=dict)
    removed: dict[str, str] = field(default_factory=dict)
    retyped: dict[str, tuple[str, str]] = field(default_factory=dict)
    unchanged: tuple[str, ...] = ()

    @property
    def changed(self) -> bool:
        return bool(self.added or self.removed or self.retyped)


@dataclass(frozen=True)
class DatasetDelta:
    rows_before: int
    rows_after: int
    rows_change_pct: float | None
    missing_pct_before: float
    missing_pct_after: float
    bytes_before: int
    bytes_after: int


@dataclass(frozen=True)
class ColumnDelta:
    """What moved in one column; fields that its type doesn't have are None."""

    name: str
    type: str
    count_before: int
    count_after: int
    missing_change_pp: float
    unique_change_pct: float | None = None
    distinct_rate_change_pct: float | None = None
    mean_shift_sigma: float | None = None
    median_shift_sigma: float | None = None
    q1_shift_sigma: float | None = None
    q3_shift_sigma: float | None = None
    std_ratio: float | None = None
    range_before: tuple | None = None
    range_after: tuple | None = None
    true_rate_change_pp: float | None = None
    values_entered: tuple[str, ...] = ()
    values_left: tuple[str, ...] = ()
    top_before: str | None = None
    top_after: str | None = None
    span_before: float | None = None
    span_after: float | None = None
    newest_before: int | None = None
    newest_after: int | None = None

    @property
    def moved(self) -> bool:
        changes = (self.missing_change_pp, self.unique_change_pct, self.mean_shift_sigma, self.median_shift_sigma, self.true_rate_change_pp)
        return any(c is not None and abs(c) > 1e-9 for c in changes) or bool(self.values_entered or self.values_left) or self.newest_before != self.newest_after or (self.std_ratio is not None and abs(self.std_ratio - 1) > 1e-9)


@dataclass(frozen=True)
class Comparison:
    dataset: DatasetDelta
    schema: SchemaDelta
    columns: dict[str, ColumnDelta]

    @property
    def moved(self) -> list[str]:
        return [c for c, d in self.columns.items() if d.moved]

    def render(self) -> str:
        """The changes as lines of text."""
        d, pct = self.dataset, lambda v: "n/a" if v is None else f"{v:+.2f}%"
        lines = [f"rows: {d.rows_before} -> {d.rows_after} ({pct(d.rows_change_pct)})"]
        lines += [f"added: {c} ({t})" for c, t in self.schema.added.items()] + [f"removed: {c} ({t})" for c, t in self.schema.removed.items()]
        lines += [f"retyped: {c} ({a} -> {b})" for c, (a, b) in self.schema.retyped.items()]
        for name in self.moved:
            c = self.columns[name]
            parts = [f"missing {c.missing_change_pp:+.2f} pp"] if abs(c.missing_change_pp) > 1e-9 else []
            parts += [f"{k} {v:+.3f} sigma" for k, v in (("mean", c.mean_shift_sigma), ("median", c.median_shift_sigma)) if v]
            parts += [f"distinct {pct(c.unique_change_pct)}"] if c.unique_change_pct else []
            parts += [f"true rate {c.true_rate_change_pp:+.2f} pp"] if c.true_rate_change_pp else []
            parts += [f"entered {', '.join(c.values_entered[:5])}"] if c.values_entered else []
            parts += [f"left {', '.join(c.values_left[:5])}"] if c.values_left else []
            lines.append(f"{name}: {'; '.join(parts) or 'newest or spread moved'}")
        return "\n".join(lines)

    __str__ = render


def _column(name: str, a: Mapping[str, Any], b: Mapping[str, Any]) -> ColumnDelta:
    kind = a["type"]
    rate = lambda s: (s.get("unique_est") or 0) / s["count"] if s.get("count") else None
    more: dict[str, Any] = {}
    if kind in ("numeric", "identifier"):
        more |= {f"{k}_shift_sigma": shift(a.get(k), b.get(k), a.get("std")) for k in ("mean", "median", "q1", "q3")}
        sa, sb = number(a.get("std")), number(b.get("std"))
        more |= {"std_ratio": sb / sa if sa and sb is not None else None, "range_before": (a.get("min"), a.get("max")), "range_after": (b.get("min"), b.get("max"))}
    if kind == "boolean" and true_pct(a) is not None and true_pct(b) is not None:
        more["true_rate_change_pp"] = true_pct(b) - true_pct(a)
    if kind == "categorical":
        va, vb = [str(v) for v, _ in a.get("top_items") or []], [str(v) for v, _ in b.get("top_items") or []]
        more |= {"values_entered": tuple(v for v in vb if v not in va), "values_left": tuple(v for v in va if v not in vb), "top_before": va[0] if va else None, "top_after": vb[0] if vb else None}
    if kind == "datetime":
        more |= {"span_before": a.get("time_span_days"), "span_after": b.get("time_span_days"), "newest_before": a.get("max_ts"), "newest_after": b.get("max_ts")}
    return ColumnDelta(
        name, kind, a["count"], b["count"], missing_pct(b) - missing_pct(a), change_pct(a.get("unique_est"), b.get("unique_est")), change_pct(rate(a), rate(b)), **more
    )


def compare_payloads(before: Mapping[str, Any], after: Mapping[str, Any]) -> Comparison:
    a, b = before["columns"], after["columns"]
    schema = SchemaDelta(
        {c: s["type"] for c, s in b.items() if c not in a}, {c: s["type"] for c, s in a.items() if c not in b},
        {c: (a[c]["type"], b[c]["type"]) for c in a if c in b and a[c]["type"] != b[c]["type"]}, tuple(c for c in a if c in b and a[c]["type"] == b[c]["type"]),
    )
    x, y = before["dataset"], after["dataset"]
    dataset = DatasetDelta(x["rows_est"], y["rows_est"], change_pct(x["rows_est"], y["rows_est"]), x["missing_cells_pct"], y["missing_cells_pct"], x["memory_bytes"], y["memory_bytes"])
    return Comparison(dataset, schema, {c: _column(c, a[c], b[c]) for c in schema.unchanged})

"""The plan of a profile: a fixed number of jobs, whatever the number of columns, put together to a payload.

Jobs: the probe of kinds; one wide scan for each kind; levels; a sketch, quartiles and
deviations; bins; steps of neighbouring values; ordered scans for direction and gaps;
duplicates; correlations; missing values by position. Each is for all columns of a kind. What reaches the driver is a row for each
column and short lists.
"""

from __future__ import annotations

import math
import threading
from collections import defaultdict
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import boolean as B
from plumbline.operators import categorical as C
from plumbline.operators import dataset as D
from plumbline.operators import flags as G
from plumbline.operators import numeric as N
from plumbline.operators import ordered as O
from plumbline.operators import sketches as S
from plumbline.operators import temporal as W
from plumbline.options import ComputeOptions
from plumbline.plans.kinds import ColumnPlan, classify, select_columns
from plumbline.plans.spread import kept
from plumbline.plans.together import together
from plumbline.shared import durable, release

SCHEMA_VERSION = 2
#: Statistics that are defined for a column without values: fixed values.
DEFINED_WHEN_EMPTY = {
    "type", "dtype", "source_timezone", "count", "missing", "unique_est", "inf", "zeros", "negatives", "true", "false", "mem_bytes", "approx", "corr_top", "top_values", "top_items",
    "min_items", "max_items", "true_histogram_counts", "true_histogram_edges", "by_hour", "by_dow", "by_month", "by_year",
}


def _by_column(rows: DataFrame) -> dict[str, dict[str, Any]]:
    return {r["column_name"]: r.asDict() for r in rows.collect()}


def _lists(rows: DataFrame, order: str) -> dict[str, list]:
    out = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: r[order]):
        out[r["column_name"]].append(r)
    return out


def _finite(value: Any) -> Any:
    return None if isinstance(value, float) and not math.isfinite(value) else value


def published(stats: dict[str, Any]) -> dict[str, Any]:
    """A column's statistics as they are published: NaN and infinite ones are null, and so are those that its lack of values leaves undefined."""
    empty = not stats.get("count")
    return {k: None if empty and k not in DEFINED_WHEN_EMPTY else _finite(v) for k, v in stats.items()}


def _uncertainty(unique: int, rows: int, k: int, approximate: bool) -> int:
    """By how many rows a frequent value's number may be off: nothing while the sketch holds all values."""
    tracked = max(1000, S.TRACKED * k)
    return 0 if not approximate or unique <= 0.75 * tracked else math.ceil(3.5 * rows / tracked)


def _ordered(df: DataFrame, columns: dict, options: ComputeOptions) -> dict[str, dict[str, Any]]:
    """Direction of each column, if the rows have an order."""
    keys = [f"__{k}" for k in options.order_by or []]
    rows = df.select(*[x.alias(c) for c, x in columns.items()], *[F.col(k).alias(f"__{k}") for k in options.order_by or []])
    return _by_column(O.ordered_summary(rows, list(columns), keys or None))


def _direction(order: dict[str, dict], name: str, known: bool) -> dict[str, bool | None]:
    """A column of no values is monotonic both ways, rows without an order neither."""
    found = order.get(name, {"mono_inc": True, "mono_dec": True} if known else {"mono_inc": None, "mono_dec": None})
    return {k: found[k] for k in ("mono_inc", "mono_dec")}


def numeric_stats(df: DataFrame, plans: list[ColumnPlan], options: ComputeOptions, indexed: DataFrame, known_order: bool) -> dict[str, dict[str, Any]]:
    columns = {p.name: p.values for p in plans}
    if not columns:
        return {}
    exact = not options.approximate
    with kept(df.select(*[x.alias(f"x{i}") for i, x in enumerate(columns.values())])) as held:
        own = {c: F.col(f"x{i}") for i, c in enumerate(columns)}
        clean = {c: N.N.finite(x) + 0.0 for c, x in own.items()}

        def moments() -> tuple[dict, dict, dict]:
            scan = _by_column(N.scan(held, own))
            limits = {c: (scan[c]["min"], scan[c]["max"]) for c in columns}
            return scan, limits, _lists(N.histogram(held, own, limits), "bin")

        def frequent() -> tuple[dict, list[str], dict]:
            facts = _by_column(N.level_counts(held, own) if exact else S.distinct(held, clean, options.hll_bits))
            few = [c for c in columns if N.top_values_tracked(facts.get(c, {}).get("unique", 0), options.top_k)]
            counted = {c: clean[c] for c in few}
            tops = _lists((C.top_items(C.levels(held, counted), options.top_k) if exact else S.frequent_values(held, counted, options.top_k)), "rank") if few else {}
            return facts, few, tops

        (scan, limits, bins), (facts, few, tops), devs, steps, order, ends = together(
            df.sparkSession,
            moments,
            frequent,
            lambda: _by_column(N.deviations(held, own, exact=exact)),
            lambda: _by_column(N.granularity(held, own, None if exact else options.numeric_sample_size)),
            lambda: _ordered(df, columns, options),
            lambda: _lists(N.extremes(indexed, columns, F.col("__row_index")), "rank"),
        )
    out = {}
    for p in plans:
        s, d, step = scan[p.name], devs.get(p.name, {}), steps[p.name]
        unique = facts.get(p.name, {}).get("unique", 0)
        lo, hi = limits[p.name]
        counts = [0] * (N.BINS if lo is not None and hi > lo else 1)
        for r in bins.get(p.name, []):
            counts[r["bin"]] = r["n"]
        q1, q3 = d.get("q1"), d.get("q3")
        items = {side: [(r["row_index"], r["value"]) for r in ends.get(p.name, []) if r["side"] == side] for side in ("min", "max")}
        stats = {
            "type": "numeric", "count": s["count"], "missing": s["missing"], "unique_est": unique, "mean": s["mean"], "std": s["std"],
            "min": s["min"], "q1": q1, "median": d.get("median"), "q3": q3, "max": s["max"], "zeros": s["zeros"], "negatives": s["negatives"],
            "outliers_iqr_est": d.get("outliers_iqr", 0), "approx": options.approximate, "mem_bytes": s["mem_bytes"], "corr_top": [],
            **_direction(order, p.name, known_order), "int_like": s["int_like"],
            "top_values": [(r["value"], r["n"]) for r in tops.get(p.name, [])] if p.name in few else None,
            "top_values_uncertainty": _uncertainty(unique, s["count"], options.top_k, options.approximate) if p.name in few else 0,
            "unique_est_exact": exact, "dtype": p.dtype, "inf": s["inf"], "variance": s["variance"], "skew": s["skew"], "kurtosis": s["kurtosis"],
            "cv": s["cv"], "se": s["se"], "gmean": s["gmean"], "min_positive": s["min_positive"], "iqr": None if q1 is None else q3 - q1, "mad": d.get("mad"),
            "ci_lo": s["ci_lo"], "ci_hi": s["ci_hi"], "jb_chi2": s["jb_chi2"], "outliers_mod_zscore_est": d.get("outliers_mod_zscore", 0),
            "outliers_mod_zscore": d.get("outliers_mod_zscore", 0), "heap_pct": s["heap_pct"], "bimodal": False, "gran_decimals": step["gran_decimals"],
            "gran_step": step["gran_step"], "unique_ratio_approx": unique / s["count"] if s["count"] else None, "min_items": items["min"], "max_items": items["max"],
            "true_histogram_edges": N.bin_edges(lo, hi) if lo is not None else [], "true_histogram_counts": counts if lo is not None else [],
        }
        if G.is_identifier(stats):
            stats["type"] = "identifier"
        out[p.name] = stats
    return out


def categorical_stats(df: DataFrame, plans: list[ColumnPlan], options: ComputeOptions) -> dict[str, dict[str, Any]]:
    columns = {p.name: p.values for p in plans}
    if not columns:
        return {}
    if options.approximate:
        rows = _by_column(C.scan(df, columns).join(S.distinct(df, columns, options.hll_bits), "column_name", "left"))
        for key, form in (("case_variants", F.lower), ("trim_variants", C.stripped)):
            for c, r in _by_column(S.distinct(df, {c: form(x) for c, x in columns.items()}, options.hll_bits)).items():
                rows[c][key] = r["unique"]
        lengths = S.quantiles(df, {c: F.length(x).cast("double") for c, x in columns.items()}, (0.9,))
        for r in lengths.collect():
            rows[r["column_name"]]["len_p90"] = None if r["value"] is None else int(r["value"])
        for c, found in _lists(S.frequent_values(df, columns, options.top_k), "rank").items():
            rows[c]["top"] = [(t["value"], t["n"]) for t in found]
    else:
        with kept(df.select(*[x.alias(f"x{i}") for i, x in enumerate(columns.values())])) as held:
            rows = {r["column_name"]: r for r in C.profile_rows(held, {c: F.col(f"x{i}") for i, c in enumerate(columns)}, options.top_k)}
    out = {}
    for p in plans:
        r = rows[p.name]
        top, unique = r.get("top", []), r.get("unique") or 0
        tracked = sum(n for _, n in top)
        shares = [n / tracked for _, n in top] if tracked else []
        few = unique <= options.max_uniques and not options.approximate
        out[p.name] = {
            "type": "categorical", "count": r["count"], "missing": r["missing"], "unique_est": unique, "top_items": top,
            "top_items_uncertainty": _uncertainty(unique, r["count"], options.top_k, options.approximate), "unique_est_exact": not options.approximate, "approx": options.approximate,
            "mem_bytes": r["mem_bytes"], "dtype": p.dtype, "entropy": -sum(s * math.log2(s) for s in shares) + 0.0, "avg_len": r["avg_len"], "len_p90": r.get("len_p90"), "empty_zero": r["empty_zero"],
            "case_variants_est": r.get("case_variants") or 0, "trim_variants_est": r.get("trim_variants") or 0, "most_common_ratio": top[0][1] / r["count"] if top else 0.0,
            "diversity_ratio": unique / r["count"] if r["count"] else 0.0, "gini_impurity": 1 - sum(s * s for s in shares) if shares else 0.0,
            "singleton_levels": (r.get("levels_once") or 0) if few else None, "exact_levels": unique if few else None,
        }
    return out


def datetime_stats(df: DataFrame, plans: list[ColumnPlan], options: ComputeOptions, known_order: bool) -> dict[str, dict[str, Any]]:
    columns = {p.name: p.values for p in plans}
    if not columns:
        return {}
    tallies = W.calendar(df, columns)
    stamps = {c: W.micros(x) for c, x in columns.items()}
    scan, counted, seasons, facts, order, gaps_of = together(
        df.sparkSession,
        lambda: _by_column(W.scan(df, columns)),
        tallies.collect,
        lambda: _by_column(W.seasonal(tallies)),
        lambda: _by_column(S.distinct(df, stamps, options.hll_bits) if options.approximate else C.level_facts(C.levels(df, stamps))),
        lambda: _ordered(df, stamps, options),
        lambda: _by_column(W.intervals(df, columns)),
    )
    cal: dict[str, dict[str, dict[int, int]]] = defaultdict(lambda: defaultdict(dict))
    for r in counted:
        cal[r["column_name"]][r["part"]][r["bucket"]] = r["n"]
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    out = {}
    for p in plans:
        s, own = scan[p.name], cal[p.name]
        gaps = gaps_of[p.name] if s["count"] > 1 else None
        out[p.name] = {
            "type": "datetime", "count": s["count"], "missing": s["missing"], "min_ts": s["min_ts"], "max_ts": s["max_ts"], "mem_bytes": s["mem_bytes"], "dtype": p.dtype, "unique_est": facts.get(p.name, {}).get("unique", 0),
            **_direction(order, p.name, known_order), "time_span_days": s["time_span_days"], "avg_interval_seconds": gaps["avg_interval_seconds"] if gaps else 0.0,
            "interval_std_seconds": gaps["interval_std_seconds"] if gaps else 0.0, "weekend_ratio": s["weekend_ratio"], "business_hours_ratio": s["business_hours_ratio"],
            "seasonal_pattern": seasons.get(p.name, {}).get("seasonal_pattern"), "source_timezone": zone if p.dtype == "timestamp" and zone not in ("UTC", "Etc/UTC", "Z") else None, "by_hour": [own["hour"].get(h, 0) for h in range(24)], "by_dow": [own["dow"].get(d, 0) for d in range(7)],
            "by_month": [own["month"].get(m, 0) for m in range(1, 13)], "by_year": {str(y): n for y, n in sorted(own["year"].items())},
        }
    return out


def boolean_stats(df: DataFrame, plans: list[ColumnPlan]) -> dict[str, dict[str, Any]]:
    rows = _by_column(B.scan(df, {p.name: p.values for p in plans})) if plans else {}
    keys = ("count", "missing", "true", "false", "mem_bytes", "true_ratio", "false_ratio", "entropy")
    return {p.name: {"type": "boolean", "dtype": p.dtype, **{k: rows[p.name][k] for k in keys}} for p in plans}


def missing_by_position(indexed: DataFrame, names: list[str], chunk: int | None) -> dict[str, dict[str, Any]]:
    """Of each column with missing values, (first row, last row, missing) of each chunk of rows, however many there are, and whether they stand in a gap."""
    if not names or not chunk:
        return {}
    by_chunk = durable(D.missing_by_chunk(indexed, F.col("__row_index"), chunk, names))
    found = _by_column(D.missing_concentration(by_chunk))
    places = defaultdict(list)
    for batch in by_chunk.toArrow().sort_by("start_row").to_batches():  # a row for each chunk and column
        for c, *place in zip(*[batch[k].to_pylist() for k in ("column_name", "start_row", "end_row", "missing")], strict=True):
            places[c].append(tuple(place))
    release(by_chunk)
    return {c: {"chunks": places[c], "finding": found[c]["finding"], "rows_share": found[c]["rows_share"], "missing_share": found[c]["missing_share"]} for c in names if c in found}


def payload(df: DataFrame, options: ComputeOptions | None = None, complete: bool = True, tell: Callable[[str], None] | None = None, keep: Callable[[int, dict], None] | None = None) -> dict[str, Any]:
    """The statistics of a table: {schema_version, dataset, columns}. ``keep`` gets what there is after each kind of columns, in the order in which they end; ``tell`` and ``keep`` are called one at a time."""
    keep = keep or (lambda step, so_far: None)

    options, tell = options or ComputeOptions(), tell or (lambda step: None)
    whole = df
    df = select_columns(df, options.columns)
    tell("kinds")
    plans = classify(df, options, complete)
    of = {k: [p for p in plans if p.kind == k] for k in ("numeric", "categorical", "datetime", "boolean")}
    known_order = bool(options.order_by) or O.has_order(df)
    # sorted once and kept: each job would draw other bounds of the sort's partitions, and rows would change their numbers
    held = durable(whole.orderBy(*options.order_by).select(*[F.col(f"`{c}`") for c in df.columns])) if options.order_by else None
    indexed = O.with_row_index(df if held is None else held, "__row_index")
    stats: dict[str, dict[str, Any]] = {}
    source = whole if options.order_by else df
    exact = not options.approximate if options.exact_duplicates is None else options.exact_duplicates
    correlated = options.compute_correlations and len(of["numeric"]) > 1

    def partners() -> list:
        pairs = D.correlations(df, {p.name: p.values for p in of["numeric"]}, options.corr_max_cols)
        return sorted(D.correlation_partners(pairs).collect(), key=lambda r: (r["column_name"], r["rank"]))

    one, ended = threading.Lock(), 0

    def kind(name: str, compute: Callable[[], dict[str, dict[str, Any]]]) -> None:
        nonlocal ended
        with one:
            tell(name)
        found = compute()
        with one:
            ended += 1
            stats.update(found)
            keep(ended, {"schema_version": SCHEMA_VERSION, "dataset": {}, "columns": {c: published(s) for c, s in stats.items()}})

    dup, near, *_ = together(
        df.sparkSession,
        lambda: D.duplicates(df, approximate=not exact).first(),
        lambda: partners() if correlated else [],
        lambda: kind("numeric", lambda: numeric_stats(source, of["numeric"], options, indexed, known_order)),
        lambda: kind("categorical", lambda: categorical_stats(df, of["categorical"], options)),
        lambda: kind("datetime", lambda: datetime_stats(source, of["datetime"], options, known_order)),
        lambda: kind("boolean", lambda: boolean_stats(df, of["boolean"])),
    )
    tell("dataset")
    for r in near:
        if abs(r["r"]) >= options.corr_threshold and len(stats[r["column_name"]]["corr_top"]) < options.corr_max_per_col:
            stats[r["column_name"]]["corr_top"].append((r["partner"], r["r"]))
    rows, cols = dup["rows"], len(df.columns)
    lost = {c: stats[c]["missing"] for c in df.columns}
    cells, total = rows * cols, sum(lost.values())
    shares = [(c, 100.0 * n / rows if rows else 0.0, n) for c, n in lost.items()]
    dataset = {
        "rows_est": rows, "cols": cols, "missing_cells": total, "missing_cells_pct": 100.0 * total / cells if cells else 0.0, "duplicate_rows_est": dup["duplicates"], "duplicate_rows_pct_est": dup["pct"],
        "duplicate_rows_uncertainty": dup["hi"] - dup["duplicates"], "duplicates_degraded": False, "duplicate_rows_lo": dup["lo"], "duplicate_rows_hi": dup["hi"], "memory_bytes": sum(s["mem_bytes"] for s in stats.values()),
        "top_missing": [{"column": c, "pct": p, "count": n} for c, p, n in sorted(shares, key=lambda s: -s[1])[:5]],
    }
    tell("positions")
    places = missing_by_position(indexed, [c for c in df.columns if lost[c]], options.chunk_size) if known_order else {}
    if places:
        dataset["missing_by_position"] = places
    if held is not None:
        release(held)
    return {"schema_version": SCHEMA_VERSION, "dataset": dataset, "columns": {c: published(stats[c]) for c in df.columns}}


def long_table(spark, summary: dict[str, Any]) -> DataFrame:
    """(column_name, stat, value) of a payload's plain statistics, values as text."""
    rows = []
    for name, stats in [("", summary["dataset"]), *summary["columns"].items()]:
        rows += [(name, k, None if v is None else str(v)) for k, v in stats.items() if not isinstance(v, (list, dict, tuple))]
    return spark.createDataFrame(rows, "column_name string, stat string, value string")


def quick_facts(summary: dict[str, Any]) -> dict[str, Any]:
    """Counts of nearly unique, constant and many-valued columns, texts and their mean length, the range of dates, complete columns; columns with fewer than two values don't count."""
    facts: dict[str, Any] = {"unique": 0, "constant": 0, "high_cardinality": 0, "text_columns": 0, "mean_text_length": None, "first_ts": None, "last_ts": None, "complete": 0}
    lengths = []
    for s in summary["columns"].values():
        facts["complete"] += not s["missing"]
        n = s["count"] or 0
        if s["type"] == "datetime" and n:
            facts["first_ts"] = min(x for x in (facts["first_ts"], s["min_ts"]) if x is not None)
            facts["last_ts"] = max(x for x in (facts["last_ts"], s["max_ts"]) if x is not None)
        if s["type"] == "categorical" and s.get("avg_len") is not None:
            facts["text_columns"] += 1
            lengths.append(s["avg_len"])
        if n < 2 or "unique_est" not in s:
            continue
        ratio = s["unique_est"] / n
        facts["unique"] += ratio >= 0.9
        facts["constant"] += s["unique_est"] == 1
        facts["high_cardinality"] += s["type"] == "categorical" and ratio > 0.5
    facts["mean_text_length"] = sum(lengths) / len(lengths) if lengths else None
    return facts


def composition(summary: dict[str, Any]) -> dict[str, tuple[int, int]]:
    """Each kind's number of columns and whole per cent of them; the per cents add up to 100."""
    counts: dict[str, int] = defaultdict(int)
    for s in summary["columns"].values():
        counts[s["type"]] += 1
    shares = D.largest_remainder(dict(counts))
    return {k: (n, shares[k]) for k, n in counts.items()}


def flag_table(spark, summary: dict[str, Any]) -> DataFrame:
    """(column_name, flag, severity, ratio) of all flags that a payload raises."""
    parts = []
    cols = summary["columns"]

    def rows(kinds: tuple[str, ...], make, schema: str) -> DataFrame | None:
        found = [(c, *make(s)) for c, s in cols.items() if s["type"] in kinds and s["count"]]
        return spark.createDataFrame(found, f"column_name string, {schema}") if found else None

    def mode(s: dict) -> int:
        top = s.get("top_values") or s.get("top_items") or []
        return top[0][1] if top else 0

    num = rows(("numeric", "identifier"), lambda s: (s["count"], s["missing"], s["inf"], s["zeros"], s["negatives"], s["min"], s["skew"], s["kurtosis"], s["jb_chi2"], s["int_like"], s["unique_est"], s["heap_pct"], s["outliers_iqr_est"], mode(s), s["mono_inc"], s["mono_dec"]),
               "count long, missing long, inf long, zeros long, negatives long, min double, skew double, kurtosis double, jb_chi2 double, int_like boolean, unique long, heap_pct double, outliers_iqr long, mode_n long, mono_inc boolean, mono_dec boolean")
    cat = rows(("categorical",), lambda s: (s["count"], s["missing"], s["unique_est"], mode(s), s["case_variants_est"], s["trim_variants_est"], s["empty_zero"]),
               "count long, missing long, unique long, mode_n long, case_variants long, trim_variants long, empty_zero long")
    boo = rows(("boolean",), lambda s: (s["count"], s["missing"], s["true"], s["false"]), "count long, missing long, true long, false long")
    dat = rows(("datetime",), lambda s: (s["count"], s["missing"], s["unique_est"], s["weekend_ratio"], s["business_hours_ratio"], s["avg_interval_seconds"], s["interval_std_seconds"], s["seasonal_pattern"]),
               "count long, missing long, unique long, weekend_ratio double, business_hours_ratio double, avg_interval_seconds double, interval_std_seconds double, seasonal_pattern string")
    for frame, rule in ((num, G.numeric), (cat, G.categorical), (boo, G.boolean), (dat, G.temporal)):
        if frame is not None:
            parts.append(rule(frame))
    out = spark.createDataFrame([], "column_name string, flag string, severity string, ratio double")
    for part in parts:
        out = out.unionByName(part)
    return out

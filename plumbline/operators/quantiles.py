"""Exact quantiles without a sort and without a list of all values.

One scan sketches all columns. The sketch puts each wanted rank between two values, with a
margin; the next scan, for all columns and ranks at once, counts what lies below, at and
between these values, and groups what lies between, of which there is little. Where it
isn't little, what lies between is sketched instead, and the bracket is narrowed. Each such
round narrows it some two hundredfold, and what reaches the driver is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import numbers as N
from plumbline.plans.spread import kept

#: Size of a sketch, ranks that are read from it, the share of the values that a rank may be off, and values between brackets that are read.
SKETCH_K, GRID, MARGIN, READABLE = 4096, 1024, 0.002, 1 << 17


@dataclass
class Sketch:
    """Of a column's finite values: their number, bounds, and GRID + 1 values of evenly spaced ranks, each off by ``margin`` at most, nearly always."""

    n: int
    lo: float | None
    hi: float | None
    grid: np.ndarray
    margin: float = MARGIN

    def between(self, rank: float) -> tuple[float, float]:
        """Values that the one of a rank (from 0) lies between."""
        at = rank / max(1, self.n - 1)
        a, b = math.floor((at - self.margin) * GRID), math.ceil((at + self.margin) * GRID)
        return (self.lo if a <= 0 else float(self.grid[a])), (self.hi if b >= GRID else float(self.grid[b]))

    def quantile(self, p: float) -> float | None:
        return float(self.grid[round(p * GRID)]) if self.n else None

    def distances(self, middle: float) -> Sketch:
        """The sketch of the values' distances from one value."""
        grid = np.sort(np.abs(self.grid - middle))
        return Sketch(self.n, 0.0, max(self.hi - middle, middle - self.lo), grid, 2 * self.margin + 2 / GRID)

    def above(self, limit: float) -> float:
        """About how many values are larger."""
        return self.n * float((self.grid > limit).mean()) if self.n else 0.0


def _grid(kll: Column) -> Column:
    """The values of GRID + 1 evenly spaced ranks. (As one text, the ranks are a constant of a few calls.)"""
    ranks = F.split(F.lit(",".join(str(i / GRID) for i in range(GRID + 1))), ",").cast("array<double>")
    return F.when(F.kll_sketch_get_n_double(kll) > 0, F.kll_sketch_get_quantile_double(kll, ranks))


def sketches(df: DataFrame, columns: dict[str, Column]) -> dict[str, Sketch]:
    """A sketch of each column of finite doubles, in one scan."""
    if not columns:
        return {}
    asks = [a for i, v in enumerate(columns.values()) for a in (F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias(f"k{i}"))]
    flat = df.agg(*asks)
    found = flat.select(*[F.col(f"{c}{i}") for i in range(len(columns)) for c in ("n", "lo", "hi")], *[_grid(F.col(f"k{i}")).alias(f"g{i}") for i in range(len(columns))]).first()
    return {name: Sketch(found[f"n{i}"], found[f"lo{i}"], found[f"hi{i}"], np.array(found[f"g{i}"] or [])) for i, name in enumerate(columns)}


@dataclass
class Counted:
    """A column's values counted by intervals (lo, hi): below, at lo, between, at hi, and so on; ``between`` has the values in between and their numbers."""

    intervals: list[tuple[float, float]]
    n: dict[int, int] = field(default_factory=dict)
    between: dict[int, list[tuple[float, int]]] = field(default_factory=dict)
    grids: dict[int, np.ndarray] = field(default_factory=dict)
    flagged: int = 0

    def bucket(self, v: Column) -> Column:
        """The interval of a value, by halving: a value is compared with a few of the bounds."""
        tests = []  # in the order of the values: each holds for its bucket and those before it
        for k, (lo, hi) in enumerate(self.intervals):
            tests += [(4 * k, v < lo), (4 * k + 1, v <= lo)] + ([(4 * k + 2, v < hi), (4 * k + 3, v <= hi)] if hi > lo else [])

        def among(a: int, b: int) -> Column:
            if a == b:
                return F.lit(tests[a][0] if a < len(tests) else 4 * len(self.intervals))
            middle = (a + b) // 2
            return F.when(tests[middle][1], among(a, middle)).otherwise(among(middle + 1, b))

        return among(0, len(tests)) if tests else F.lit(0)

    def at(self, rank: int) -> tuple[float | None, tuple[float, float] | None]:
        """The value of a rank, or a narrower bracket of it."""
        before = 0
        for b in range(4 * len(self.intervals) + 1):
            n = self.n.get(b, 0)
            if rank >= before + n:
                before += n
                continue
            k, kind = divmod(b, 4)
            if kind in (1, 3):
                return self.intervals[k][kind == 3], None
            if kind == 2 and b in self.between:
                for value, times in self.between[b]:
                    before += times
                    if rank < before:
                        return value, None
            if kind == 2 and b in self.grids:
                grid = self.grids[b]
                return None, Sketch(n, float(grid[0]), float(grid[-1]), grid).between(rank - before)
            # the sketch was off: the value is outside all brackets
            return None, (self.intervals[k - 1][1] if k else -math.inf, self.intervals[k][0] if k < len(self.intervals) else math.inf)
        raise AssertionError("a rank beyond the values")

    def count(self, test: Callable[[float], bool], sure_from: float) -> int | None:
        """How many values pass a test that all above ``sure_from`` pass and that is monotonous; None if values between brackets are missing."""
        total = 0
        for b, n in self.n.items():
            k, kind = divmod(b, 4)
            if kind in (1, 3):
                total += n * test(self.intervals[k][kind == 3])
            elif kind == 2:
                if b not in self.between:
                    return None
                total += sum(times for value, times in self.between[b] if test(value))
            elif k and self.intervals[k - 1][1] >= sure_from:
                total += n
        return total


def _disjoint(intervals: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(set(intervals)):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def counted(df: DataFrame, columns: dict[str, Column], brackets: dict[str, list[tuple[float, float]]], flags: dict[str, Column] | None = None) -> dict[str, Counted]:
    """All columns' values counted by their brackets; ``flagged`` counts the rows of a column's flag. One scan, or two if too much lies between."""
    found = {name: Counted(_disjoint(brackets[name])) for name in columns}
    flags = flags or {}
    names = list(columns)
    first = df.select(*[v.alias(f"v{i}") for i, v in enumerate(columns.values())], *[c.bucket(columns[name]).alias(f"b{i}") for i, (name, c) in enumerate(found.items())],
                      *[F.coalesce(flags[name], F.lit(False)).alias(f"f{i}") if name in flags else F.lit(False).alias(f"f{i}") for i, name in enumerate(names)])
    items = [F.struct(F.lit(i).alias("c"), F.col(f"b{i}").alias("b"), F.col(f"f{i}").alias("f"), F.col(f"v{i}").alias("v")) for i in range(len(names))]
    rows = first.select(F.explode(F.array(*items)).alias("r")).select("r.*").filter("v is not null")
    inner = F.when(F.col("b") % 4 == 2, F.col("v")).alias("x")
    levels = rows.select("c", "b", "f", inner).groupBy("c", "b", "f", "x").agg(F.count("*").alias("n")).limit(READABLE + 1).toArrow().to_pydict()
    if len(levels["c"]) <= READABLE:
        for c, b, f, x, n in zip(levels["c"], levels["b"], levels["f"], levels["x"], levels["n"], strict=True):
            own = found[names[c]]
            own.n[b] = own.n.get(b, 0) + n
            own.flagged += n * f
            if x is not None:
                own.between.setdefault(b, []).append((x, n))
        for own in found.values():
            for values in own.between.values():
                values.sort()
        return found
    sizes = rows.select("c", "b", "f", inner).groupBy("c", "b").agg(F.count("*").alias("n"), F.count_if("f").alias("f"), _grid(F.kll_sketch_agg_double("x", F.lit(SKETCH_K))).alias("g"))
    for r in sizes.collect():  # a row for each bracket
        own = found[names[r["c"]]]
        own.n[r["b"]], own.flagged = r["n"], own.flagged + r["f"]
        if r["g"] is not None:
            own.grids[r["b"]] = np.array(r["g"])
    return found


def order_statistics(df: DataFrame, columns: dict[str, Column], ranks: dict[str, list[int]], known: dict[str, Sketch]) -> dict[tuple[str, int], float]:
    """The values of the given ranks (from 0) of finite columns, from their sketches."""
    open_ = {(name, r): known[name].between(r) for name, wanted in ranks.items() for r in wanted}
    out: dict[tuple[str, int], float] = {}
    while open_:
        names = list(dict.fromkeys(name for name, _ in open_))
        tallies = counted(df, {c: columns[c] for c in names}, {c: [b for (name, _), b in open_.items() if name == c] for c in names})
        left = {}
        for (name, r), _ in open_.items():
            value, narrower = tallies[name].at(r)
            if value is not None:
                out[name, r] = float(value)
            else:
                left[name, r] = (max(narrower[0], known[name].lo), min(narrower[1], known[name].hi))
        open_ = left
    return out


def _ranks(n: int, at: Iterable[float]) -> dict[float, float]:
    return {p: (n - 1) * p for p in at}


def _interpolated(values: dict[tuple[str, int], float], name: str, h: float) -> float:
    a, b = values[name, math.floor(h)], values[name, math.ceil(h)]
    return a + (b - a) * (h - math.floor(h))


@contextmanager
def finite_columns(df: DataFrame, columns: dict[str, Column]) -> Iterator[tuple[DataFrame, dict[str, Column]]]:
    """The columns' finite values, a small table of them held for several scans."""
    inputs = df.select(*[N.finite(x).alias(f"c{i}") for i, x in enumerate(columns.values())])
    with kept(inputs) as held:
        yield held, {name: F.col(f"c{i}") for i, name in enumerate(columns)}


def _quantiles(held: DataFrame, clean: dict[str, Column], known: dict[str, Sketch], at: tuple[float, ...]) -> dict[str, dict[float, float | None]]:
    spots = {name: _ranks(s.n, at) for name, s in known.items() if s.n}
    ranks = {name: sorted({r for h in own.values() for r in (math.floor(h), math.ceil(h))}) for name, own in spots.items()}
    values = order_statistics(held, clean, ranks, known)
    return {name: {p: _interpolated(values, name, spots[name][p]) if name in spots else None for p in at} for name in clean}


def quantiles(df: DataFrame, columns: dict[str, Column], at: tuple[float, ...]) -> dict[str, dict[float, float | None]]:
    """Linearly interpolated quantiles of each column's finite values, exact; null for a column without any."""
    with finite_columns(df, columns) as (held, clean):
        return _quantiles(held, clean, sketches(held, clean), at)


@dataclass(frozen=True)
class Limits:
    """The fixed values of outliers: interquartile ranges beyond the quartiles, and the scale and limit of scores by the median deviation."""

    fence: float
    scale: float
    score: float


def deviations(df: DataFrame, columns: dict[str, Column], limits: Limits, quartiles: dict[str, tuple[float | None, ...]] | None = None, exact: bool = True) -> dict[str, dict[str, float | int | None]]:
    """{q1, median, q3, mad, iqr_outliers, mad_outliers} of each column with values: three scans for all columns, or one if not ``exact``.

    ``quartiles`` (q1, median, q3), if they are known, aren't looked for again. Estimates are read from the sketches alone.
    """
    at = (0.25, 0.5, 0.75)
    with finite_columns(df, columns) as (held, clean):
        known = {name: s for name, s in sketches(held, clean).items() if s.n}
        own = {name: clean[name] for name in known}
        if quartiles is None:
            found = _quantiles(held, own, known, at) if exact else {name: {p: s.quantile(p) for p in at} for name, s in known.items()}
            quartiles = {name: tuple(q[p] for p in at) for name, q in found.items()}
        out: dict[str, dict[str, float | int | None]] = {name: dict(zip(("q1", "median", "q3"), quartiles[name], strict=True)) for name in known}
        fences = {name: (q["q1"] - limits.fence * (q["q3"] - q["q1"]), q["q3"] + limits.fence * (q["q3"] - q["q1"])) for name, q in out.items()}
        far = {name: s.distances(out[name]["median"]) for name, s in known.items()}
        if not exact:
            for name, s in known.items():
                mad = far[name].quantile(0.5)
                beyond = s.n * float(((s.grid < fences[name][0]) | (s.grid > fences[name][1])).mean())
                out[name] |= {"mad": mad, "iqr_outliers": round(beyond), "mad_outliers": round(far[name].above(mad * limits.score / limits.scale)) if mad else 0}
            return out
        gaps = {name: F.abs(own[name] - F.lit(out[name]["median"])) for name in known}
        middle = {name: _ranks(s.n, (0.5,))[0.5] for name, s in known.items()}
        brackets = {}
        for name, h in middle.items():
            lo, hi = far[name].between(math.floor(h))[0], far[name].between(math.ceil(h))[1]
            times = limits.score / limits.scale
            brackets[name] = [(lo, hi), (lo * times * (1 - 1e-9), hi * times * (1 + 1e-9))]
        flags = {name: (own[name] < fences[name][0]) | (own[name] > fences[name][1]) for name in known}
        tallies = counted(held, gaps, brackets, flags) if known else {}
        values, missed = {}, {}
        for name, h in middle.items():
            for r in {math.floor(h), math.ceil(h)}:
                value, _ = tallies[name].at(r)
                if value is None:
                    missed.setdefault(name, []).append(r)
                else:
                    values[name, r] = value
        if missed:
            values |= order_statistics(held, gaps, missed, far)
        again = {}
        for name, h in middle.items():
            mad = _interpolated(values, name, h)
            out[name] |= {"mad": mad, "iqr_outliers": tallies[name].flagged, "mad_outliers": 0}
            if mad:
                beyond = tallies[name].count(lambda g, mad=mad: limits.scale * g / mad > limits.score, mad * limits.score / limits.scale * (1 + 1e-12))
                inside = brackets[name][1][0] <= mad * limits.score / limits.scale <= brackets[name][1][1]
                if beyond is None or not inside:
                    again[name] = F.count_if(limits.scale * gaps[name] / F.lit(mad) > limits.score).alias(f"n{len(again)}")
                else:
                    out[name]["mad_outliers"] = beyond
        if again:
            counts = held.agg(*again.values()).first()
            for i, name in enumerate(again):
                out[name]["mad_outliers"] = counts[f"n{i}"]
        return out


def quantile_frame(df: DataFrame, columns: dict[str, Column], at: tuple[float, ...]) -> DataFrame:
    """(column_name, p, value) of ``quantiles``."""
    found = quantiles(df, columns, at)
    return df.sparkSession.createDataFrame([(name, p, v) for name, own in found.items() for p, v in own.items()], "column_name string, p double, value double")


def sketched_quantiles(df: DataFrame, columns: dict[str, Column], at: tuple[float, ...]) -> DataFrame:
    """(column_name, p, value) from mergeable sketches, one scan."""
    found = sketches(df, {name: N.finite(x) for name, x in columns.items()})
    return df.sparkSession.createDataFrame([(name, p, s.quantile(p)) for name, s in found.items() for p in at], "column_name string, p double, value double")

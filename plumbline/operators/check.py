"""The gate: thresholds on a profile and on its change against a stored baseline."""

from __future__ import annotations

import json
import math
import re
import time
import tomllib
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from plumbline import __version__
from plumbline.errors import ConfigurationError, PlumblineError
from plumbline.operators import compare as C
from plumbline.operators.sketches import HLL_ERROR

BASELINE_VERSION, SCHEMA_VERSION = 1, 2
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds(value: Any) -> float:
    """A duration in seconds, or as a number and one of s, m, h, d and w."""
    if isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and value >= 0:
        return float(value)
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([smhdw])?\s*", str(value).lower()) if isinstance(value, str) else None
    if not found:
        raise ConfigurationError(f"{value!r} is no duration; write 90m, 26h, 3d, 2w, 45s or seconds")
    return float(found[1]) * _UNITS[found[2] or "s"]


@dataclass(frozen=True)
class Thresholds:
    """Limits; a value at a limit passes, and None turns a check off. Drifts are against the baseline."""

    max_missing_pct: float | None = None
    min_rows: int | None = None
    max_duplicate_pct: float | None = None
    max_rows_drift_pct: float | None = None
    max_missing_drift_pp: float | None = 5.0
    max_unique_drift_pct: float | None = 25.0
    max_mean_shift_sigma: float | None = 0.5
    max_median_shift_sigma: float | None = 0.5
    max_std_ratio: float | None = 2.0
    max_true_rate_drift_pp: float | None = 10.0
    max_age: float | str | None = None
    fail_on_new_column: bool = False
    fail_on_range_expansion: bool = False
    require_max_ts_advances: bool = False

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "bool":
                if not isinstance(value, bool):
                    raise ConfigurationError(f"{f.name} is true or false, not {value!r}")
            elif f.name != "max_age" and value is not None:
                number = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
                least = 1 if f.name == "max_std_ratio" else 0
                if not number or value < least or f.name == "min_rows" and value != int(value):
                    raise ConfigurationError(f"{f.name} is a number from {least} on, not {value!r}")
        if self.max_age is not None:
            object.__setattr__(self, "max_age", seconds(self.max_age))

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any]) -> Thresholds:
        unknown = sorted(set(raw) - {f.name for f in fields(cls)})
        if unknown:
            raise ConfigurationError(f"unknown thresholds: {', '.join(unknown)}")
        return cls(**raw)

    @classmethod
    def from_file(cls, path: str | Path) -> Thresholds:
        """From JSON or TOML; a [tool.<name>.check] or [thresholds] table is taken if there is one."""
        readers = {".toml": tomllib.loads, ".json": json.loads}
        if Path(path).suffix.lower() not in readers:
            raise ConfigurationError(f"thresholds are a .json or .toml file, not {path}")
        try:
            raw = readers[Path(path).suffix.lower()](Path(path).read_text())
        except (OSError, ValueError) as e:
            raise ConfigurationError(f"{path} can't be read: {e}") from e
        if not isinstance(raw, dict):
            raise ConfigurationError(f"{path} holds no table of thresholds")
        for tool in raw.get("tool", {}).values() if isinstance(raw.get("tool"), dict) else ():
            if isinstance(tool, dict) and "check" in tool:
                raw = tool["check"]
        return cls.from_mapping(raw.get("thresholds", raw))

    def notes(self) -> list[str]:
        if self.max_unique_drift_pct is not None and self.max_unique_drift_pct < 200 * HLL_ERROR:
            return [f"max_unique_drift_pct is within twice the error of estimated distinct counts ({100 * HLL_ERROR:.1f} %)"]
        return []


@dataclass(frozen=True)
class Finding:
    kind: str
    column: str | None
    message: str
    baseline: Any = None
    current: Any = None
    approximate: bool = False

    def render(self) -> str:
        return f"{self.column or 'dataset'}: {self.message}" + " (approximate)" * self.approximate


@dataclass(frozen=True)
class CheckResult:
    findings: tuple[Finding, ...] = ()
    checked_columns: tuple[str, ...] = ()
    notes: tuple[str, ...] = ()

    @property
    def passed(self) -> bool:
        return not self.findings

    def to_dict(self) -> dict[str, Any]:
        return {"passed": self.passed, "findings": [asdict(f) for f in self.findings], "checked_columns": list(self.checked_columns), "notes": list(self.notes)}

    def render(self) -> str:
        lines = [f.render() for f in self.findings] or [f"passed; {len(self.checked_columns)} columns checked"]
        return "\n".join([*lines, *(f"note: {n}" for n in self.notes)])

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(f.kind, f.column, f.message, None if f.baseline is None else str(f.baseline), None if f.current is None else str(f.current), f.approximate) for f in self.findings]
        return spark.createDataFrame(rows, "kind string, column string, message string, baseline string, current string, approximate boolean")


@dataclass(frozen=True)
class Baseline:
    summary: Mapping[str, Any]
    created_at: str = ""
    version: str = ""
    source: str | None = None


def envelope(summary: Mapping[str, Any], source: str | None = None) -> dict[str, Any]:
    """Statistics as they are stored."""
    return {"baseline_version": BASELINE_VERSION, "created_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "version": __version__, "source": source, "summary": summary}


def write_baseline(path: str | Path, summary: Mapping[str, Any], source: str | None = None) -> None:
    Path(path).write_text(json.dumps(envelope(summary, source), default=str, indent=1))


def parse_baseline(raw: Mapping[str, Any], name: str | Path) -> Baseline:
    """A stored baseline; another version of the envelope or of the statistics is refused."""
    for key, found, wanted in (("baseline_version", raw.get("baseline_version"), BASELINE_VERSION), ("schema_version", raw.get("summary", {}).get("schema_version"), SCHEMA_VERSION)):
        if found != wanted:
            raise PlumblineError(f"{name} has {key} {found!r}; this version reads {wanted}")
    return Baseline(raw["summary"], raw.get("created_at", ""), raw.get("version", ""), raw.get("source"))


def read_baseline(path: str | Path) -> Baseline:
    try:
        raw = json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        raise PlumblineError(f"the baseline {path} can't be read: {e}") from e
    return parse_baseline(raw, path)


def _absolute(now: Mapping[str, Any], t: Thresholds, clock: float) -> Iterator[Finding]:
    data = now["dataset"]
    rows = data["rows_est"]
    if t.min_rows is not None and rows < t.min_rows:
        yield Finding("rows", None, f"{rows} rows, fewer than {t.min_rows}", None, rows)
    if t.max_duplicate_pct is not None and rows and (worst := 100.0 * data["duplicate_rows_hi"] / rows) > t.max_duplicate_pct:
        yield Finding("duplicates", None, f"up to {worst:.2f} % duplicate rows, more than {t.max_duplicate_pct:g} %", None, worst, data["duplicate_rows_hi"] != data["duplicate_rows_lo"])
    for name, s in now["columns"].items():
        if t.max_missing_pct is not None and (pct := C.missing_pct(s)) > t.max_missing_pct:
            yield Finding("missing", name, f"{pct:.2f} % missing, more than {t.max_missing_pct:g} %", None, pct)
        if t.max_age is not None and s["type"] == "datetime" and s.get("max_ts") is not None and (age := clock - s["max_ts"] / 1e9) > t.max_age:
            yield Finding("freshness", name, f"the newest value is {age:.0f} s old, more than {t.max_age:.0f} s", None, age)


def _drift(name: str, a: Mapping[str, Any], b: Mapping[str, Any], t: Thresholds) -> Iterator[Finding]:
    d = C._column(name, a, b)
    if t.max_missing_drift_pp is not None and abs(d.missing_change_pp) > t.max_missing_drift_pp:
        yield Finding("missing", name, f"missing moved by {d.missing_change_pp:+.2f} points, more than {t.max_missing_drift_pp:g}", C.missing_pct(a), C.missing_pct(b))
    both = (d.unique_change_pct, d.distinct_rate_change_pct)
    if t.max_unique_drift_pct is not None and all(v is not None and abs(v) > t.max_unique_drift_pct for v in both):
        yield Finding("cardinality", name, f"distinct values moved by {both[0]:+.1f} %, more than {t.max_unique_drift_pct:g} %", a.get("unique_est"), b.get("unique_est"), not (a.get("unique_est_exact", True) and b.get("unique_est_exact", True)))
    if d.type == "numeric":
        for k, limit in (("mean", t.max_mean_shift_sigma), ("median", t.max_median_shift_sigma)):
            moved = getattr(d, f"{k}_shift_sigma")
            if limit is not None and moved is not None and abs(moved) > limit:
                yield Finding("distribution", name, f"the {k} moved by {moved:+.2f} standard deviations, more than {limit:g}", a.get(k), b.get(k), bool(a.get("approx") or b.get("approx")) and k == "median")
        if t.max_std_ratio is not None and (sa := C.number(a.get("std"))) and (sb := C.number(b.get("std"))) is not None:
            ratio = max(sb / sa, sa / sb) if sb else math.inf
            if ratio > t.max_std_ratio:
                yield Finding("distribution", name, f"the standard deviation changed {ratio:.2f} times, more than {t.max_std_ratio:g}", sa, sb)
        if t.fail_on_range_expansion:
            for k, worse in (("min", lambda x, y: y < x), ("max", lambda x, y: y > x)):
                if a.get(k) is not None and b.get(k) is not None and worse(a[k], b[k]):
                    yield Finding("range", name, f"a new {k} of {b[k]:g} beyond {a[k]:g}", a[k], b[k])
    if d.type == "boolean" and t.max_true_rate_drift_pp is not None and d.true_rate_change_pp is not None and abs(d.true_rate_change_pp) > t.max_true_rate_drift_pp:
        yield Finding("boolean", name, f"the share of true moved by {d.true_rate_change_pp:+.2f} points, more than {t.max_true_rate_drift_pp:g}", C.true_pct(a), C.true_pct(b))
    if d.type == "datetime" and t.require_max_ts_advances and a.get("max_ts") is not None and (b.get("max_ts") is None or b["max_ts"] <= a["max_ts"]):
        yield Finding("freshness", name, "the newest value did not move", a["max_ts"], b.get("max_ts"))


def check_payload(current: Mapping[str, Any], baseline: Baseline | Mapping[str, Any] | None = None, thresholds: Thresholds | None = None, now: float | None = None) -> CheckResult:
    """The thresholds that a payload crosses, by itself and against a baseline."""
    t = thresholds or Thresholds()
    found = list(_absolute(current, t, time.time() if now is None else now))
    if baseline is None:
        return CheckResult(tuple(found), (), tuple(t.notes()))
    before = baseline.summary if isinstance(baseline, Baseline) else baseline
    moved = C.change_pct(before["dataset"]["rows_est"], current["dataset"]["rows_est"])
    if t.max_rows_drift_pct is not None and moved is not None and abs(moved) > t.max_rows_drift_pct:
        found.append(Finding("rows", None, f"rows moved by {moved:+.2f} %, more than {t.max_rows_drift_pct:g} %", before["dataset"]["rows_est"], current["dataset"]["rows_est"]))
    a, b = before["columns"], current["columns"]
    found += [Finding("schema", c, f"the column is gone (it was {s['type']})", s["type"]) for c, s in a.items() if c not in b]
    found += [Finding("schema", c, f"the type changed from {a[c]['type']} to {s['type']}", a[c]["type"], s["type"]) for c, s in b.items() if c in a and a[c]["type"] != s["type"]]
    found += [Finding("schema", c, f"a new column ({s['type']})", None, s["type"]) for c, s in b.items() if c not in a and t.fail_on_new_column]
    shared = [c for c in b if c in a]
    for c in shared:
        if a[c]["type"] == b[c]["type"]:
            found += _drift(c, a[c], b[c], t)
    return CheckResult(tuple(found), tuple(shared), tuple(t.notes()))

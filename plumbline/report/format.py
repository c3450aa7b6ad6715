"""Numbers, sizes and times as people write them."""

from __future__ import annotations

import datetime as dt
import math
import re


def compact(value: float | None) -> str:
    """1.2K, 3.4M and so on; small numbers in full."""
    if value is None:
        return "–"
    size = abs(value)
    for limit, unit in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e4, "K")):
        if size >= limit:
            return f"{value / (1e3 if unit == 'K' else limit):.1f}{unit}"
    return number(value)


def number(value: float | None) -> str:
    """Up to six significant digits, in scientific form if very large or small."""
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "–"
    if isinstance(value, bool):
        return str(value).lower()
    if float(value).is_integer() and abs(value) < 1e15:
        return f"{int(value):,}"
    return f"{value:.3e}" if abs(value) >= 1e9 or abs(value) < 1e-4 else f"{value:,.6g}"


def size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if abs(n) < 1024 or unit == "TB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return ""


def duration(s: float | None) -> str:
    if s is None:
        return "–"
    for unit, length in (("d", 86400), ("h", 3600), ("min", 60)):
        if s >= length:
            return f"{s / length:.1f} {unit}"
    return f"{s:.3g} s"


def moment(ns: float | None) -> str:
    return "–" if ns is None else (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(ns) // 1000)).isoformat(sep=" ", timespec="seconds")


def ordinal(n: int) -> str:
    tail = "th" if 10 <= n % 100 <= 20 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    return f"{n}{tail}"


def ticks(lo: float, hi: float, n: int = 5) -> list[float]:
    """About ``n`` round numbers from lo to hi."""
    if not hi > lo:
        return [lo]
    raw = (hi - lo) / max(1, n)
    base = 10 ** math.floor(math.log10(raw))
    step = next(m * base for m in (1, 2, 5, 10) if m * base >= raw)
    first = math.ceil(lo / step) * step
    return [round(first + i * step, 12) for i in range(int((hi - first) / step + 1e-9) + 1)]


def log_ticks(lo: float, hi: float) -> list[float]:
    """Powers of ten from lo to hi, both above zero."""
    return [10.0**k for k in range(math.ceil(math.log10(lo)), math.floor(math.log10(hi)) + 1)]


#: Words of column names, and the units they stand for: fixed values.
UNITS = {
    "usd": "USD", "eur": "EUR", "gbp": "GBP", "pct": "%", "percent": "%", "ms": "ms", "sec": "s", "secs": "s", "seconds": "s", "minutes": "min", "hours": "h", "days": "days",
    "km": "km", "kg": "kg", "cm": "cm", "mm": "mm", "bytes": "B", "kb": "KB", "mb": "MB", "gb": "GB", "years": "years",
}


def unit(name: str) -> str:
    """The unit that the last or else the first word of a column's name stands for; empty if neither does."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1_\2", name).lower()) if w]
    return next((UNITS[w] for w in (words[-1:] + words[:1]) if w in UNITS), "")

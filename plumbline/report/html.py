"""A self-contained page: tables, bars in SVG, and a little script for search and sorting."""

from __future__ import annotations

import math
import re
from html import escape
from typing import Any

from plumbline.operators.temporal import MONTHS
from plumbline.plans.profile import composition, quick_facts
from plumbline.report import format as T
from plumbline.report.glossary import meanings

_STYLE = """
body{font:14px system-ui,sans-serif;margin:0;color:#1c2430;background:#f6f7f9}main{max-width:1080px;margin:auto;padding:24px}
section,article{background:#fff;border:1px solid #dfe3e8;border-radius:8px;padding:16px;margin:12px 0}h1{font-size:22px}h2{font-size:16px;margin:0 0 8px}
table{border-collapse:collapse}td,th{padding:3px 12px 3px 0;text-align:left;vertical-align:top}th{color:#5b6675;font-weight:500}.grid{display:flex;flex-wrap:wrap;gap:24px}
.flag{border-radius:4px;padding:1px 6px;margin-right:4px;font-size:12px;background:#e8edf3}.bad{background:#f8d3d3}.warn{background:#fbe7c3}.good{background:#d5efdb}rect{fill:#5b7fb5}text{font-size:10px;fill:#5b6675}line{stroke:#5b6675}.fence{stroke:#b5483a;stroke-dasharray:3 3}input{padding:6px;width:260px}
.numeric{fill:#5b7fb5}.categorical{fill:#6fa56a}.datetime{fill:#c08a3e}.boolean{fill:#8f6bb3}.identifier{fill:#8a94a3}[contenteditable]:focus{outline:1px dashed #8a94a3}
"""
_SCRIPT = """
const byId=i=>document.getElementById(i),q=byId('q'),k=byId('k'),s=byId('s'),all=[...document.querySelectorAll('article')],size=+byId('cards').dataset.size;let at=0;
const rank={name:(a,b)=>a.dataset.name.localeCompare(b.dataset.name),missing:(a,b)=>b.dataset.missing-a.dataset.missing,at:(a,b)=>a.dataset.at-b.dataset.at};
function show(){const t=q.value.toLowerCase(),found=all.filter(a=>a.dataset.name.toLowerCase().includes(t)&&(!k.value||a.dataset.kind==k.value)).sort(rank[s.value]),pages=Math.max(1,Math.ceil(found.length/size));
at=Math.min(Math.max(at,0),pages-1);all.forEach(a=>a.hidden=true);found.slice(at*size,(at+1)*size).forEach(a=>{a.hidden=false;a.parentNode.append(a)});byId('n').textContent=`page ${at+1} of ${pages}`}
q.oninput=k.onchange=s.onchange=()=>{at=0;show()};byId('prev').onclick=()=>{at--;show()};byId('next').onclick=()=>{at++;show()};show();
"""


def markdown(text: str) -> str:
    """Paragraphs, bold, italics, code, links and lists of a short description; all else is escaped."""
    out, items = [], []
    for block in re.split(r"\n\s*\n", text.strip()):
        lines = block.split("\n")
        if all(line.lstrip().startswith(("- ", "* ")) for line in lines):
            items = "".join(f"<li>{_inline(line.lstrip()[2:])}</li>" for line in lines)
            out.append(f"<ul>{items}</ul>")
        else:
            out.append(f"<p>{'<br>'.join(map(_inline, lines))}</p>")
    return "".join(out)


def _inline(text: str) -> str:
    text = escape(text)
    for pattern, put in ((r"`([^`]+)`", r"<code>\1</code>"), (r"\*\*([^*]+)\*\*", r"<b>\1</b>"), (r"\*([^*]+)\*", r"<i>\1</i>"), (r"\[([^\]]+)\]\((https?://[^)\s]+)\)", r'<a href="\2">\1</a>')):
        text = re.sub(pattern, put, text)
    return text


def strip(chunks: list[tuple[int, int, int]], most: int = 360) -> str:
    """Bars of (first row, last row, missing); neighbours are put together where there would be more bars than points of the drawing."""
    k = math.ceil(len(chunks) / most) or 1
    parts = [chunks[i : i + k] for i in range(0, len(chunks), k)]
    return bars([sum(m for *_, m in p) for p in parts], [f"rows {p[0][0]:,} to {p[-1][1]:,}" for p in parts])


def bars(values: list[float], labels: list[str] | None = None, width: int = 360, height: int = 90, below: list[str] | None = None) -> str:
    """Vertical bars with their labels as titles, round numbers at the left, and up to one text ``below`` for each bar."""
    if not values:
        return ""
    top, w = max(values) or 1, width / len(values)
    parts = []
    for i, v in enumerate(values):
        h = height * v / top
        label = escape(f"{labels[i]}: " if labels else "") + T.number(v)
        parts.append(f'<rect x="{_LEFT + i * w:.1f}" y="{height - h:.1f}" width="{max(0.5, w - 1):.1f}" height="{h:.1f}"><title>{label}</title></rect>')
        if below and below[i]:
            parts.append(f'<text x="{_LEFT + (i + 0.5) * w:.1f}" y="{height + 12}" text-anchor="middle">{escape(below[i])}</text>')
    for t in T.ticks(0, top, 2)[1:]:
        y = height * (1 - t / top)
        parts.append(f'<line x1="{_LEFT - 3}" x2="{_LEFT}" y1="{y:.1f}" y2="{y:.1f}"/><text x="{_LEFT - 5}" y="{y + 8:.1f}" text-anchor="end">{escape(T.compact(t))}</text>')
    return f'<svg width="{width + 2 * _LEFT}" height="{height + 18}" role="img">{"".join(parts)}</svg>'


#: Room beside a chart.
_LEFT = 44


def histogram(name: str, s: dict[str, Any], width: int = 360, height: int = 90) -> str:
    """Bars of a numeric column's bins, round values below them, and dashed lines at the quartile fences that lie within."""
    edges, counts = s["true_histogram_edges"] or [], s["true_histogram_counts"] or []
    if len(edges) < 2:
        return ""
    lo, hi = edges[0], edges[-1]
    labels = [f"{T.number(a)} to {T.number(b)}" for a, b in zip(edges, edges[1:], strict=False)]
    chart = bars(counts, labels, width, height)

    def x(v: float) -> float:
        return _LEFT + width * (v - lo) / (hi - lo)

    marks = [f'<text x="{x(t):.1f}" y="{height + 12}" text-anchor="middle">{escape(T.compact(t))}</text>' for t in T.ticks(lo, hi, 4)]
    if unit := T.unit(name):
        marks.append(f'<text x="{_LEFT + width + 4}" y="{height + 12}">{escape(unit)}</text>')
    if s["iqr"] is not None:
        for fence in (s["q1"] - 1.5 * s["iqr"], s["q3"] + 1.5 * s["iqr"]):
            if lo < fence < hi:
                marks.append(f'<line class="fence" x1="{x(fence):.1f}" x2="{x(fence):.1f}" y1="0" y2="{height}"><title>fence {T.number(fence)}</title></line>')
    return chart.replace("</svg>", "".join(marks) + "</svg>")


def kinds_bar(kinds: dict[str, tuple[int, int]], width: int = 360, height: int = 14) -> str:
    """One bar cut by the share of each kind of column."""
    parts, at = [], 0.0
    for kind, (n, share) in kinds.items():
        parts.append(f'<rect class="{escape(kind)}" x="{at:.1f}" y="0" width="{width * share / 100:.1f}" height="{height}"><title>{escape(kind)}: {n} ({share} %)</title></rect>')
        at += width * share / 100
    return f'<svg width="{width}" height="{height}" role="img">{"".join(parts)}</svg>'


def _table(rows: list[tuple[str, str]]) -> str:
    return "<table>" + "".join(f"<tr><th>{escape(a)}</th><td>{escape(b)}</td></tr>" for a, b in rows) + "</table>"


def _numeric(name: str, s: dict[str, Any]) -> str:
    left = [(k.replace("_", " "), T.number(s[k])) for k in ("count", "missing", "unique_est", "mean", "std", "min", "q1", "median", "q3", "max")]
    right = [(k.replace("_", " "), T.number(s[k])) for k in ("zeros", "negatives", "inf", "skew", "kurtosis", "cv", "mad", "outliers_iqr_est", "outliers_mod_zscore", "heap_pct", "gran_step", "jb_chi2")]
    top = _table([(T.number(v if not isinstance(v, str) else float(v)), T.number(n)) for v, n in (s["top_values"] or [])[:10] if n > 1])
    near = _table([(f"r with {c}", f"{r:.3f}") for c, r in s["corr_top"][:5]])
    return f'<div class="grid">{_table(left)}{_table(right)}<div>{histogram(name, s)}</div>{top}{near}</div>'


def _categorical(name: str, s: dict[str, Any]) -> str:
    left = [(k.replace("_", " "), T.number(s[k])) for k in ("count", "missing", "unique_est", "entropy", "gini_impurity", "avg_len", "len_p90", "empty_zero", "case_variants_est", "trim_variants_est", "singleton_levels")]
    top = [(str(v)[:60], f"{T.number(n)} ({100 * n / s['count']:.1f} %)") for v, n in s["top_items"][:10]] if s["count"] else []
    return f'<div class="grid">{_table(left)}{_table(top)}</div>'


def _datetime(name: str, s: dict[str, Any]) -> str:
    left = [("count", T.number(s["count"])), ("missing", T.number(s["missing"])), ("distinct", T.number(s["unique_est"])), ("first", T.moment(s["min_ts"])), ("last", T.moment(s["max_ts"])),
            ("span", T.duration(None if s["time_span_days"] is None else 86400 * s["time_span_days"])), ("mean interval", T.duration(s["avg_interval_seconds"])), ("season", str(s["seasonal_pattern"] or "–"))]
    days = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    years = list(s["by_year"])
    hours = [str(h) if h % 6 == 0 else "" for h in range(24)]
    few = [y if i % max(1, len(years) // 5) == 0 else "" for i, y in enumerate(years)]
    charts = bars(s["by_hour"], [f"{h}:00" for h in range(24)], below=hours) + bars(s["by_dow"], days, 140, below=[d[0] for d in days])
    charts += bars(s["by_month"], list(MONTHS), 180, below=[m[0] for m in MONTHS]) + bars(list(s["by_year"].values()), years, 240, below=few)
    return f'<div class="grid">{_table(left)}<div>{charts}</div></div>'


def _boolean(name: str, s: dict[str, Any]) -> str:
    return _table([(k.replace("_", " "), T.number(s[k])) for k in ("count", "missing", "true", "false", "true_ratio", "entropy")])


_CARDS = {"numeric": _numeric, "identifier": _numeric, "categorical": _categorical, "datetime": _datetime, "boolean": _boolean}


def page(summary: dict[str, Any], flags: list[dict[str, Any]], rows: list[dict[str, Any]], title: str, description: str | None = None, per_page: int = 50) -> str:
    """The whole page, ``per_page`` columns at a time; everything from the data is escaped. The description can be edited in the browser."""
    d, facts = summary["dataset"], quick_facts(summary)
    kinds = composition(summary)
    overview = [("rows", T.number(d["rows_est"])), ("columns", T.number(d["cols"])), ("missing cells", f"{T.number(d['missing_cells'])} ({d['missing_cells_pct']:.2f} %)"),
                ("duplicate rows", f"{T.number(d['duplicate_rows_est'])} ({d['duplicate_rows_pct_est']:.2f} %)"), ("size", T.size(d["memory_bytes"])),
                ("kinds", ", ".join(f"{k} {n} ({p} %)" for k, (n, p) in kinds.items())), ("constant columns", T.number(facts["constant"])), ("nearly unique columns", T.number(facts["unique"]))]
    missing = [(m["column"], f"{m['pct']:.2f} %") for m in d["top_missing"] if m["count"]]
    cards = []
    for at, (name, s) in enumerate(summary["columns"].items()):
        raised = "".join(f'<span class="flag {escape(f["severity"])}">{escape(f["flag"].replace("_", " "))}</span>' for f in flags if f["column_name"] == name)
        body = _CARDS[s["type"]](name, s) if s["count"] else "<p>no values</p>"
        cards.append(f'<article data-name="{escape(name)}" data-kind="{s["type"]}" data-at="{at}" data-missing="{s["missing"]}"><h2>{escape(name)} <small>{s["type"]}, {escape(s["dtype"])}</small></h2>{raised}{body}</article>')
    sample = ""
    if rows:
        head = "".join(f"<th>{escape(str(c))}</th>" for c in rows[0])
        sample = f"<section><h2>Sample</h2><table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{escape(str(v))[:80]}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table></section>"
    strips = "".join(f"<tr><th>{escape(c)}</th><td>{strip(p['chunks'])}</td><td>{escape(p['finding'])}</td></tr>" for c, p in d.get("missing_by_position", {}).items())
    places = f"<section><h2>Missing values by position</h2><table>{strips}</table></section>" if strips else ""
    pairs = {tuple(sorted((c, o))): r for c, s in summary["columns"].items() for o, r in s.get("corr_top", [])}
    strong = [(f"{a} and {b}", f"{r:.3f}") for (a, b), r in sorted(pairs.items(), key=lambda x: (-abs(x[1]), x[0]))[:100]]
    near = f"<section><h2>Correlations</h2>{_table(strong)}</section>" if strong else ""
    options = "".join(f"<option>{k}</option>" for k in kinds)
    tools = f'<p><input id="q" placeholder="search columns"> <select id="k"><option value="">all kinds</option>{options}</select> <select id="s"><option value="at">in order</option><option value="name">by name</option><option value="missing">by missing</option></select> <button id="prev">back</button> <span id="n"></span> <button id="next">on</button></p>'
    about = f'<div contenteditable="true">{markdown(description) if description else "<p>Description</p>"}</div>'
    told = meanings(flags)
    legend = f"<section><h2>Flags</h2>{_table(told)}</section>" if told else ""
    return (
        f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{_STYLE}</style></head><body><main><h1>{escape(title)}</h1>{about}'
        f'<section><h2>Overview</h2><div class="grid">{_table(overview)}{_table(missing)}{kinds_bar(kinds)}</div></section>{places}{near}{tools}<div id="cards" data-size="{per_page}">{"".join(cards)}</div>{legend}{sample}</main><script>{_SCRIPT}</script></body></html>'
    )

"""The verbs: profile, summarize, compare and check."""

from __future__ import annotations

import json
import logging
import sys
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from html import escape
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from plumbline.operators import check as K
from plumbline.operators import compare as C
from plumbline.operators import dataset as D
from plumbline.options import ComputeOptions, ProfileConfig, resolve
from plumbline.plans import profile as P
from plumbline.plans.kinds import select_columns
from plumbline.plans.together import together
from plumbline.report import html as H
from plumbline.sources import readers, sinks

log = logging.getLogger("plumbline")


@dataclass(frozen=True)
class Report:
    """A rendered profile and its statistics."""

    html: str
    stats: dict[str, Any]

    def save_html(self, path: str | Path) -> None:
        sinks.save_html(path, self.html)

    def save_json(self, path: str | Path) -> None:
        sinks.save_json(path, self.stats)

    def save(self, path: str | Path) -> None:
        """By the suffix: .json the statistics, .html the page."""
        if str(path).endswith(".json"):
            self.save_json(path)
        elif str(path).endswith((".html", ".htm")):
            self.save_html(path)
        else:
            raise ValueError(f"{path} ends in neither .html nor .json")

    def _repr_html_(self) -> str:
        return self.html


def _teller(options: ComputeOptions) -> Callable[[str], None]:
    progress, began, steps = options.progress, time.time(), 0

    def tell(step: str) -> None:
        nonlocal steps
        steps += 1
        if steps % options.log_every_n_chunks == 0:
            log.info("%s after %.1f s", step, time.time() - began)
        if callable(progress):
            progress({"step": step, "elapsed": time.time() - began})
        elif progress is True or progress == "auto" and sys.stderr.isatty():
            print(f"[{time.time() - began:6.1f} s] {step}", file=sys.stderr)

    return tell


def _keeper(options: ComputeOptions) -> Callable[[int, dict[str, Any]], None]:
    """Writes the statistics so far, as JSON and if asked for as a page, and leaves the newest files."""
    def keep(step: int, stats: dict[str, Any]) -> None:
        every = options.checkpoint_every_n_chunks
        if not every or step % every:
            return
        folder = Path(options.checkpoint_dir or ".")
        folder.mkdir(parents=True, exist_ok=True)
        sinks.save_json(folder / f"{options.checkpoint_prefix}_{step:04d}.json", stats)
        if options.checkpoint_write_html:
            cards = "".join(f"<li>{escape(c)}: {escape(s['type'])}, {s['count']} values</li>" for c, s in stats["columns"].items())
            sinks.save_html(folder / f"{options.checkpoint_prefix}_{step:04d}.html", f"<!DOCTYPE html><title>step {step}</title><ul>{cards}</ul>")
        for suffix in (".json", ".html"):
            sinks.rotate(folder, options.checkpoint_prefix, options.checkpoint_max_to_keep, suffix)

    return keep


def summarize(data: Any, config: ProfileConfig | None = None, *, preset: str | None = None, spark: SparkSession | None = None, **options: Any) -> dict[str, Any]:
    """The statistics of any supported data, without a page."""
    cfg = resolve(config, preset, options)
    return P.payload(readers.read(data, spark), cfg.compute, tell=_teller(cfg.compute), keep=_keeper(cfg.compute))


def profile(data: Any, config: ProfileConfig | None = None, *, preset: str | None = None, spark: SparkSession | None = None, **options: Any) -> Report:
    """The statistics of any supported data, and a self-contained page of them."""
    cfg = resolve(config, preset, options)
    df = readers.read(data, spark)
    tell = _teller(cfg.compute)
    stats = P.payload(df, cfg.compute, tell=tell, keep=_keeper(cfg.compute))
    tell("page")
    shown = select_columns(df, cfg.compute.columns)
    rows = [r.asDict() for r in D.sample_rows(shown, cfg.compute.random_seed, cfg.render.sample_rows).collect()] if cfg.render.include_sample and shown.columns else []
    flags = [r.asDict() for r in P.flag_table(df.sparkSession, stats).collect()]
    title = cfg.render.title or (Path(data).name if isinstance(data, (str, Path)) else "Dataset profile")
    return Report(H.page(stats, flags, rows, title, cfg.render.description, cfg.render.columns_per_page), stats)


def compare(before: Any, after: Any, *, seed: int = 0, **options: Any) -> C.Comparison:
    """What changed between two datasets, or payloads of them."""
    sides = [before, after]
    new = [i for i, side in enumerate(sides) if not (isinstance(side, Mapping) and "columns" in side and "dataset" in side)]
    if new:  # payloads alone need no session
        for i, found in zip(new, together(readers.session(), *[lambda side=sides[i]: summarize(side, seed=seed, **options) for i in new]), strict=True):
            sides[i] = found
    return C.compare_payloads(*sides)


def check(data: Any, baseline: Any = None, thresholds: K.Thresholds | None = None, *, now: float | None = None, **options: Any) -> K.CheckResult:
    """The thresholds that a dataset, or a payload of it, crosses; the baseline is a file, a Baseline or a payload."""
    current = data if isinstance(data, Mapping) and "columns" in data and "dataset" in data else summarize(data, **options)
    if isinstance(baseline, (str, Path)):
        baseline = K.read_baseline(baseline)
    return K.check_payload(json.loads(json.dumps(sinks.plain(current))), baseline, thresholds, now)

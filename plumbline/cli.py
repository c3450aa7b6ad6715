"""The command line: profile, summarize and check."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from plumbline import __version__, api
from plumbline.errors import PlumblineError
from plumbline.operators import check as K
from plumbline.options import ComputeOptions, ProfileConfig, RenderOptions
from plumbline.sources import sinks

PASS, BREACH, FAILED = 0, 1, 2


#: Limits that can be given without a file: the flag of each threshold and what it takes.
LIMITS = {
    "max_missing_pct": ("--max-missing-pct", float),
    "min_rows": ("--min-rows", int),
    "max_duplicate_pct": ("--max-duplicate-pct", float),
    "max_rows_drift_pct": ("--max-rows-drift-pct", float),
    "max_age": ("--max-age", str),
    "fail_on_new_column": ("--fail-on-new-column", bool),
    "fail_on_range_expansion": ("--fail-on-range-expansion", bool),
    "require_max_ts_advances": ("--require-fresh", bool),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline", description="Profiles a dataset with Spark.")
    top.add_argument("-v", "--version", action="version", version=f"plumbline {__version__}")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb, what in (("profile", "write a page"), ("summarize", "write statistics as JSON"), ("check", "hold against thresholds")):
        p = verbs.add_parser(verb, help=what)
        p.add_argument("data")
        p.add_argument("-s", "--seed", type=int, default=0)
        p.add_argument("--chunk-size", type=int, default=100_000)
        p.add_argument("--sample-size", type=int, default=20_000)
        p.add_argument("--no-correlations", action="store_true")
        p.add_argument("--approximate", action="store_true")
        p.add_argument("-q", "--quiet", action="store_true")
        if verb != "check":
            p.add_argument("-o", "--output", required=verb == "profile")
        if verb == "profile":
            p.add_argument("-t", "--title")
        if verb == "check":
            p.add_argument("-b", "--baseline")
            p.add_argument("--write-baseline")
            p.add_argument("--thresholds", help="a .json or .toml file; the limits below go before it")
            for name, (flag, form) in LIMITS.items():
                p.add_argument(flag, dest=name, **({"action": "store_const", "const": True} if form is bool else {"type": form}))
            p.add_argument("--warn-only", action="store_true")
            p.add_argument("--json", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    """0: done or passed; 1: a threshold is crossed; 2: it could not run."""
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return FAILED if e.code else PASS
    try:
        compute = ComputeOptions(chunk_size=a.chunk_size, numeric_sample_size=a.sample_size, random_seed=a.seed, compute_correlations=not a.no_correlations, approximate=a.approximate, progress=False if a.quiet else "auto")
        config = ProfileConfig(compute, RenderOptions(title=getattr(a, "title", None)))
        if a.verb == "profile":
            api.profile(a.data, config).save(a.output)
            return PASS
        limits = K.Thresholds()
        if a.verb == "check":  # before the table is read, so that a wrong limit costs nothing
            given = {name: getattr(a, name) for name in LIMITS if getattr(a, name) is not None}
            limits = replace(K.Thresholds.from_file(a.thresholds) if a.thresholds else limits, **given)
        stats = api.summarize(a.data, config)
        if a.verb == "summarize":
            if a.output:
                sinks.save_json(a.output, stats)
            else:
                print(json.dumps(sinks.plain(stats)))
            return PASS
        result = api.check(stats, a.baseline, limits)
        if a.write_baseline:
            K.write_baseline(a.write_baseline, sinks.plain(stats), a.data)
        print(json.dumps(sinks.plain(result.to_dict())) if a.json else result.render())
        return PASS if result.passed or a.warn_only else BREACH
    except (PlumblineError, OSError, ValueError) as e:
        print(f"plumbline: {e}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())

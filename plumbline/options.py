"""Options of a profile: what is computed, and how a report looks."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from typing import Any

from plumbline.errors import ConfigurationError

KINDS = ("numeric", "categorical", "datetime", "boolean")


#: What texts are tried as, from least to most.
STRATEGIES = ("conservative", "balanced", "aggressive")


@dataclass
class ComputeOptions:
    """What is computed.

    ``approximate`` takes quantiles, distinct counts and frequent values from mergeable
    sketches; otherwise all statistics are exact. ``order_by`` names the columns that give
    rows their order; without it rows have the order in which their source is read.
    ``exact_duplicates`` None counts duplicate rows exactly unless ``approximate`` is set.
    ``chunk_size`` is the resolution of missing-by-position, which None leaves out.
    ``numeric_sample_size`` and ``max_uniques`` bound what is estimated from samples and
    sketches in approximate mode, and ``max_uniques`` also the levels up to which
    singletons are told. ``corr_max_per_col`` is the number of partners that a column
    lists. ``inference`` says what texts are tried as, if ``infer_strings`` is set: numbers
    ("conservative"), times as well ("balanced"), or truth values too ("aggressive").
    Every ``log_every_n_chunks``-th step of a profile is logged, and after every
    ``checkpoint_every_n_chunks``-th the statistics so far are written to
    ``checkpoint_dir``, of which the newest ``checkpoint_max_to_keep`` stay.
    """

    chunk_size: int | None = 50_000
    columns: list[str] | None = None
    numeric_sample_size: int = 20_000
    max_uniques: int = 2_048
    top_k: int = 50
    random_seed: int = 0
    progress: bool | str | Callable[[dict], None] = False
    log_every_n_chunks: int = 1
    checkpoint_every_n_chunks: int = 0
    checkpoint_dir: str | None = None
    checkpoint_prefix: str = "plumbline_ckpt"
    checkpoint_write_html: bool = False
    checkpoint_max_to_keep: int = 3
    enable_auto_boolean_detection: bool = True
    boolean_detection_min_samples: int = 100
    boolean_detection_max_zero_ratio: float = 0.80
    boolean_detection_require_name_pattern: bool = False
    force_column_types: dict[str, str] | None = None
    compute_correlations: bool = True
    corr_threshold: float = 0.5
    corr_max_cols: int = 50
    corr_max_per_col: int = 10
    infer_strings: bool = True
    inference: str = "balanced"
    approximate: bool = False
    exact_duplicates: bool | None = None
    order_by: list[str] | None = None

    def __post_init__(self) -> None:
        self.validate()

    @property
    def hll_bits(self) -> int:
        """The size of a distinct-count sketch that errs by less than one of ``max_uniques`` minimum hashes."""
        return min(21, max(8, math.ceil(math.log2(self.max_uniques)) + 3))

    def validate(self) -> None:
        positive = ("numeric_sample_size", "max_uniques", "top_k", "log_every_n_chunks", "checkpoint_max_to_keep", "boolean_detection_min_samples", "corr_max_cols", "corr_max_per_col")
        for name in positive:
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ConfigurationError(f"{name} must be a positive integer, not {value!r}")
        if self.chunk_size is not None and (isinstance(self.chunk_size, bool) or not isinstance(self.chunk_size, int) or self.chunk_size < 1):
            raise ConfigurationError(f"chunk_size must be a positive integer or None, not {self.chunk_size!r}")
        if self.inference not in STRATEGIES:
            raise ConfigurationError(f"inference is {self.inference!r}; there are {', '.join(STRATEGIES)}")
        if self.checkpoint_every_n_chunks < 0:
            raise ConfigurationError("checkpoint_every_n_chunks must not be negative")
        for name in ("boolean_detection_max_zero_ratio", "corr_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ConfigurationError(f"{name} must lie between 0 and 1")
        for column, kind in (self.force_column_types or {}).items():
            if kind not in KINDS:
                raise ConfigurationError(f"force_column_types[{column!r}] is {kind!r}; the kinds are {', '.join(KINDS)}")


@dataclass
class RenderOptions:
    """How a report looks."""

    title: str | None = None
    description: str | None = None
    include_sample: bool = True
    sample_rows: int = 10
    columns_per_page: int = 50

    def __post_init__(self) -> None:
        if isinstance(self.columns_per_page, bool) or not isinstance(self.columns_per_page, int) or self.columns_per_page < 1:
            raise ConfigurationError(f"columns_per_page must be a positive integer, not {self.columns_per_page!r}")


@dataclass
class ProfileConfig:
    """All options of one profile."""

    compute: ComputeOptions = field(default_factory=ComputeOptions)
    render: RenderOptions = field(default_factory=RenderOptions)


PRESETS: dict[str, dict[str, Any]] = {
    "fast": {"numeric_sample_size": 5_000, "max_uniques": 1_024, "top_k": 20, "compute_correlations": False},
    "thorough": {"numeric_sample_size": 50_000, "max_uniques": 8_192, "top_k": 100, "compute_correlations": True, "corr_threshold": 0.0},
}
#: Keyword options of the verbs, and the fields they set.
KEYWORDS = {
    "chunk_size": "chunk_size", "columns": "columns", "sample": "numeric_sample_size", "correlations": "compute_correlations", "seed": "random_seed",
    "title": "title", "progress": "progress", "approximate": "approximate", "order_by": "order_by",
}


def resolve(config: ProfileConfig | None, preset: str | None, keywords: dict[str, Any]) -> ProfileConfig:
    """The options of a call: either ``config`` alone, or the defaults, then the preset, then keywords."""
    if config is not None:
        if not isinstance(config, ProfileConfig):
            raise ConfigurationError(f"config takes a ProfileConfig, not {type(config).__name__}")
        if preset or keywords:
            raise ConfigurationError("config can't be combined with a preset or keyword options")
        config.compute.validate()
        return config
    if preset is not None and preset not in PRESETS:
        raise ConfigurationError(f"there is no preset {preset!r}; there are {', '.join(sorted(PRESETS))}")
    unknown = sorted(set(keywords) - set(KEYWORDS))
    if unknown:
        known = {f.name for f in fields(ComputeOptions)}
        hints = [f"{n} is a field of ComputeOptions" + next((f" (keyword {k})" for k, v in KEYWORDS.items() if v == n), "") for n in unknown if n in known]
        raise ConfigurationError("; ".join([f"unknown options: {', '.join(unknown)}", *hints, f"keywords: {', '.join(sorted(KEYWORDS))}"]))
    compute = dict(PRESETS.get(preset or "", {}))
    render = {}
    for name, value in keywords.items():
        (render if name == "title" else compute)[KEYWORDS[name]] = value
    return ProfileConfig(ComputeOptions(**compute), replace(RenderOptions(), **render))

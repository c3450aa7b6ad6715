"""plumbline: a dataset profiler and data-pipeline engine made of Spark plans."""

from __future__ import annotations

import importlib
import warnings
from typing import Any

__version__ = "0.1.0"

_HOME = {
    "Comparison": "plumbline.operators.compare", "ComputeOptions": "plumbline.options", "ConfigurationError": "plumbline.errors", "PlumblineError": "plumbline.errors", "ProfileConfig": "plumbline.options",
    "RenderOptions": "plumbline.options", "Report": "plumbline.api", "Thresholds": "plumbline.operators.check", "UnsupportedDataError": "plumbline.errors", "check": "plumbline.api", "compare": "plumbline.api",
    "profile": "plumbline.api", "summarize": "plumbline.api",
}
__all__ = sorted([*_HOME, "__version__"])


def __getattr__(name: str) -> Any:
    """Public names, found when they are first used, so that importing a part doesn't import all."""
    if name == "ReportConfig":
        warnings.warn("ReportConfig is an old name of ProfileConfig and will go in 1.0", DeprecationWarning, stacklevel=2)
        name = "ProfileConfig"
    if name not in _HOME:
        raise AttributeError(f"plumbline has no {name!r}")
    return getattr(importlib.import_module(_HOME[name]), name)

"""Where results go: files on the driver for documents, Spark writers for tables."""

from __future__ import annotations

import json
import math
import os
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


def plain(value: Any) -> Any:
    """A value as JSON has it; NaN and infinite numbers are null."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (str, int, bool)) or value is None:
        return value
    return value.item() if hasattr(value, "item") else str(value)


def save_json(path: str | Path, payload: Any) -> None:
    Path(path).write_text(json.dumps(plain(payload), indent=1, ensure_ascii=False))


def save_html(path: str | Path, html: str) -> None:
    Path(path).write_text(html, encoding="utf-8")


def save_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).save(path)


def rotate(folder: str | Path, prefix: str, keep: int, suffix: str = "") -> list[Path]:
    """Leaves the newest ``keep`` files of a prefix and suffix, and says which went."""
    files = sorted(Path(folder).glob(f"{prefix}*{suffix}"), key=lambda p: (p.stat().st_mtime_ns, p.name))
    old = files[:-keep] if keep else files
    for p in old:
        os.remove(p)
    return old

"""Independent jobs at the same time.

A profile's statistics don't wait for one another, and most of a small job's time is
planning and scheduling. Threads of the driver submit such jobs together: their tasks share
the executors' cores, so that one job's last tasks don't leave the others idle.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def together(spark: SparkSession, *jobs: Callable[[], Any]) -> list[Any]:
    """The results of ``jobs``, each run in a thread with the caller's job group, tags and properties; the first of them that failed is raised when all have ended."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(len(jobs)) as pool:
        begun = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [b.result() for b in begun]

"""Small inputs over all cores.

A table of one small file is one task, whatever the number of cores. Operators that scan
their input more than once, or compute much from each row, deal such an input out first. A
large input has tasks enough and is left as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

#: Estimated bytes up to which an input is dealt out, and kept while it is scanned again.
SMALL = 256 << 20


def is_small(df: DataFrame) -> bool:
    return not df.isStreaming and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores if it is small and has columns."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.columns and cores > 1 and not _is_kept(df) and is_small(df) else df


def _is_kept(df: DataFrame) -> bool:
    """Whether a table's rows come from one that ``kept`` holds, through projections and filters at most."""
    plan = df._jdf.queryExecution().withCachedData()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.nodeName() == "InMemoryRelation"


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` for several scans: a small one is dealt out and held in memory or on disk until the block ends."""
    if not df.columns or _is_kept(df) or not is_small(df):
        yield df
        return
    held = spread(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()

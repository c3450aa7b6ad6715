"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.shared import durable, release


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (two long columns u, v): root is the least node of its component.

    Each round hangs a node's larger neighbours on its least one, then its smaller
    neighbours on their least; the number of rounds grows with the logarithm of the
    longest chain. A round's edges are written to the shared folder, and deleted after the
    next. Self-loops and
    repeated edges are allowed; a null end drops the edge; no edges give no rows.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    now = durable(edges.filter("u is not null and v is not null and u <> v").select(u.alias("u"), v.alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, durable(small.unionByName(nearest.select("u", F.col("m").alias("v"))).distinct())
        release(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

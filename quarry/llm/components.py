"""Connected components of a link table, by alternating star contraction.

Each round links every node's larger neighbours to its least neighbour, then
its smaller neighbours to the least one; the number of links never grows and
the rounds are logarithmic. Every round is written to the shared folder, so
its lineage is short and it survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize

ROUNDS = 64


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Links from each node's (larger or smaller) neighbours to the least of
    the node and its neighbours. ``links`` holds a > b."""
    if larger:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    least = both.groupBy("a").agg(F.min("b").alias("low")).select(
        "a", F.least("a", "low").alias("low"))
    near = both.join(least, "a")
    if larger:
        out = near.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b")))
    return out.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b; a > b): root is the
    least node of its component."""
    now = materialize(links.filter("a > b").distinct(), "links")
    mark = None
    for _ in range(ROUNDS):
        now = materialize(_stars(_stars(now, True), False), "links")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

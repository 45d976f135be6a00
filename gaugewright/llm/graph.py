"""Connected components by alternating large-star and small-star rounds.

Every round is two map-side-combined minima and two joins over the edge list. No node's neighbours are gathered
in one task: a hub only meets its minimum, through a join that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(links: DataFrame) -> DataFrame:
    """links(u, v): connect every larger neighbour v of u to the smallest node next to u."""
    least = links.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    return links.hint("merge").join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any orderable id, either direction, repeats and loops allowed -> (node, component).

    ``component`` is the smallest node reachable. Only nodes with an edge to another node are returned; rows with a
    null end are ignored; no edges give no rows.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = keep(ends.distinct(), "edges")
    before = _digest(current)
    while before[0]:
        both = current.union(current.select("v", "u"))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        small = (
            _star(large)
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = keep(small, "edges")
        forget(current)
        now = _digest(after)
        current, done, before = after, now == before, now
        if done:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))

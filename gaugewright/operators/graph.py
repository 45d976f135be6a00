"""Link graph operators over an edge table (source, target)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored


def outside_targets(edges: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """Targets that are not known pages, with the first source of each: (target, source). known(url)."""
    return edges.join(known.select(F.col("url").alias("target")), "target", "left_anti").groupBy("target").agg(F.min_by("source", order).alias("source"))


def orphans(pages: DataFrame, edges: DataFrame, root: str | None = None) -> DataFrame:
    """Pages that no edge points to, the root excepted."""
    out = pages.join(edges.select(F.col("target").alias("url")).distinct(), "url", "left_anti")
    return out.where(F.col("url") != root) if root is not None else out


def broken(edges: DataFrame, statuses: DataFrame) -> DataFrame:
    """Edges whose target answers with 400 or more. statuses(target, status)."""
    return edges.join(statuses.where("status >= 400"), "target")


def depths(pages: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Click depth of known pages from the roots: (url, depth); pages that no path reaches are absent.

    One frontier step after the other until none finds a new page, each an anti-join against what is reached. Every step is
    written to the shared folder, which cuts the lineage and survives lost executors.
    """
    inner = stored(edges.join(pages.select(F.col("url").alias("target")), "target").select("source", "target").distinct(), "edges")
    frontier = stored(roots.select("url").join(pages.select("url"), "url", "left_semi").distinct().withColumn("depth", F.lit(0)), "depths")
    reached, step = frontier, 0
    while not frontier.isEmpty():
        step += 1
        following = frontier.join(inner, F.col("url") == F.col("source")).select(F.col("target").alias("url")).distinct()
        frontier = stored(following.join(reached, "url", "left_anti").withColumn("depth", F.lit(step)), "depths")
        reached = reached.union(frontier)
    return reached

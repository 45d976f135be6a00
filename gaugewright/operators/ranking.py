"""Top rows, pairings by rank, and dealing in turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored


def top(df: DataFrame, group: list[str], order: list[Column], most: int | Column) -> DataFrame:
    """The first rows of each group. A constant limit is applied in every task before rows are shuffled."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rank") <= most)


def crawl_order(entries: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """entries(url, lastmod, pos, depth): shallow pages first, fresh ones before stale; the first ``cap``, and how many are left."""
    ordered = entries.orderBy("depth", F.desc(F.coalesce("lastmod", F.lit(""))), "pos").limit(cap)
    return ordered, entries.agg(F.greatest(F.lit(0), F.count("*") - cap).alias("remaining"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 1 in a total order: ranges of the order are numbered apart and shifted by what stands before them.

    ``order`` must tell all rows apart. Only the number of rows of each range meets in one place.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = dealt.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).select("_range", F.coalesce("_before", F.lit(0)).alias("_before"))
    return own.join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")  # a row a partition


def pair_by_rank(left: DataFrame, left_order: list[Column], right: DataFrame, right_order: list[Column]) -> DataFrame:
    """Row n of one list beside row n of the other; both orders are total."""
    return numbered(left, left_order, "rank").join(numbered(right, right_order, "rank"), "rank", "full")


def round_robin(needs: DataFrame, key: str, need: str) -> DataFrame:
    """Seats (turn, key, seat) dealt in passes, the biggest need first, one seat a pass: seat number s is dealt in pass s."""
    seats = needs.where(F.col(need) > 0).select(key, need, F.explode(F.sequence(F.lit(1).cast("long"), F.col(need).cast("long"))).alias("seat"))
    return numbered(seats, [F.col("seat"), F.desc(need), F.col(key)], "turn").select("turn", key, "seat")

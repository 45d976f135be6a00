"""Differences between two states of the same things."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MOST_COLUMNS = 10000


def compare(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison: (keys, old_value, new_value, state) with state identical, modified, added or missing."""
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(1).alias("_a"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(1).alias("_b"))
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "missing").when(F.col("old_value").eqNullSafe(F.col("new_value")), "identical").otherwise("modified")
    return a.join(b, keys, "full").withColumn("state", state).drop("_a", "_b")


def closed(before: DataFrame, now: DataFrame, key: str = "check_id") -> DataFrame:
    """Rows of ``before`` that are gone from ``now``, those that the platform limits excepted."""
    return before.where(~F.coalesce("platform_limit", F.lit(False))).join(now.select(key).distinct(), key, "left_anti")


def grid_holes(declared_rows: DataFrame, declared_columns: DataFrame, seen: DataFrame) -> DataFrame:
    """Cells of a declared grid that were not seen. The columns are a declared list, read whole and refused if it is long."""
    (name,) = declared_columns.columns
    listed = [r[0] for r in declared_columns.distinct().limit(MOST_COLUMNS + 1).collect()]
    if len(listed) > MOST_COLUMNS:
        raise ValueError(f"a grid has {MOST_COLUMNS} columns at most")
    grid = declared_rows.withColumn(name, F.explode(F.array(*map(F.lit, listed)))) if listed else declared_rows.withColumn(name, F.lit(None)).where("false")
    return grid.join(seen.select(*grid.columns).distinct(), grid.columns, "left_anti")


def grid_extras(declared: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return seen.select(key).distinct().join(declared.select(key), key, "left_anti")


def missing_numbers(numbers: DataFrame, group: str, number: str, least: int = 10) -> DataFrame:
    """Numbers that a numbered list skips, for groups that reach ``least``."""
    tops = numbers.groupBy(group).agg(F.max(number).alias("top")).where(F.col("top") >= least)
    wanted = tops.select(group, F.explode(F.sequence(F.lit(1).cast("long"), F.col("top").cast("long"))).alias(number))
    return wanted.join(numbers.select(group, F.col(number).cast("long").alias(number)), [group, number], "left_anti")


def reusable(inventory: DataFrame, state: DataFrame) -> DataFrame:
    """inventory(url, lastmod) with ``reuse``: remembered in state(url, lastmod) with the same known lastmod."""
    known = state.select("url", F.col("lastmod").alias("seen_lastmod"))
    return inventory.join(known, "url", "left").withColumn("reuse", F.coalesce(F.col("lastmod") == F.col("seen_lastmod"), F.lit(False)))


def wanted_and_got(wanted: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """wanted(key, n), got(key, n) -> (key, wants, gets, shortage); absent sides count 0."""
    a, b = wanted.select(key, F.col("n").alias("wants")), got.select(key, F.col("n").alias("gets"))
    out = a.join(b, key, "full").na.fill(0, ["wants", "gets"])
    return out.withColumn("shortage", F.greatest(F.lit(0).cast("long"), F.col("wants") - F.col("gets")))

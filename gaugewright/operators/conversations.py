"""Ordered texts: turns and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_consecutive(text: Column, separator: str) -> Column:
    """Drop paragraphs equal to the one just before them; blank ones stay, and separate equal neighbours."""
    parts = F.split(text, separator)
    keep = F.filter(parts, lambda x, i: (F.trim(x) == "") | (i == 0) | (F.trim(x) != F.trim(F.get(parts, i - 1))))
    return F.array_join(keep, separator)


def merged(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> one row each: joined text, flags by or, length used (0 is unknown), number of roles.

    A conversation is one row of output, so its turns have to meet; they meet nothing else.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    used = F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0))
    return turns.groupBy("conv_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"),
        F.bool_or(F.col("role") == "system").alias("has_system"),
        F.nullif(used, F.lit(0)).alias("used"),
        F.size(F.collect_set("role")).cast("long").alias("roles"),
    )

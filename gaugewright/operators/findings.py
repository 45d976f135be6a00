"""Declarative checks: a table of predicates over facts becomes ranked findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """Fires for each row of its population (``scope``) on which ``fails`` holds."""

    id: str
    title: str
    priority: int
    fails: Column
    scope: Column | None = None


def duplicates(df: DataFrame, key: str, name: str = "duplicate") -> DataFrame:
    """Mark rows that share a non-empty key with another row; counted before rows meet, so hot keys are one row a task."""
    shared = df.where((F.col(key).isNotNull()) & (F.col(key) != "")).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.lit(True).alias(name))
    return df.join(shared, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def hits(facts: DataFrame, checks: list[Check], key: str) -> DataFrame:
    """(check_ordinal, check_id, title, priority, key) of each failing row; facts are read once for all checks."""
    fired = F.filter(
        F.array(
            *(
                F.when(c.fails & (c.scope if c.scope is not None else F.lit(True)), F.struct(F.lit(i).alias("check_ordinal"), F.lit(c.id).alias("check_id"), F.lit(c.title).alias("title"), F.lit(c.priority).alias("priority")))
                for i, c in enumerate(checks)
            )
        ),
        lambda x: x.isNotNull(),
    )
    return facts.select(F.col(key).alias("subject"), F.explode(fired).alias("c")).select("c.*", "subject")


def findings(facts: DataFrame, checks: list[Check], key: str, order: str, samples: int = 20) -> DataFrame:
    """One row per check that fires: count, and the first ``samples`` subjects in ``order``.

    Samples are cut by rank before rows are gathered, so no task holds all subjects of a check.
    """
    fired = hits(facts.withColumn("_order", F.col(order)).withColumn("_subject", F.struct("_order", F.col(key).alias("key"))), checks, "_subject")
    by = ["check_ordinal", "check_id", "title", "priority"]
    counts = fired.groupBy(*by).agg(F.count("*").alias("count"))
    first = fired.withColumn("_rank", F.row_number().over(Window.partitionBy("check_id").orderBy("subject"))).where(F.col("_rank") <= samples)
    listed = first.groupBy("check_id").agg(F.transform(F.array_sort(F.collect_list("subject")), lambda x: x["key"]).alias("subjects"))
    return counts.join(listed, "check_id")


def ranked(found: DataFrame) -> DataFrame:
    """Priority first, then larger counts; equal ones in the checks' own order."""
    return found.orderBy("priority", F.desc("count"), "check_ordinal")

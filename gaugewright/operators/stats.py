"""Statistics of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(df: DataFrame, group: str, value: str, digits: int = 4) -> DataFrame:
    """Mean, sample deviation (0 for one value), smallest and largest value of each group."""
    x = F.col(value)
    return df.groupBy(group).agg(
        F.round(F.avg(x), digits).alias("mean"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), digits).alias("stddev"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n")
    )


def trigger_rates(runs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """runs(query, should, triggered) -> rate per query and whether it passes: at or above for positives, below for negatives."""
    rates = runs.groupBy("query", "should").agg(F.avg(F.col("triggered").cast("int")).alias("rate"), F.count("*").alias("runs"))
    return rates.withColumn("passed", F.when(F.col("should"), F.col("rate") >= threshold).otherwise(F.col("rate") < threshold))


def precision_recall(true_positive: Column, false_positive: Column, false_negative: Column, true_negative: Column) -> list[Column]:
    """Precision, recall (1 over nothing) and accuracy (0 over nothing)."""
    right, everything = true_positive + true_negative, true_positive + true_negative + false_positive + false_negative
    return [
        F.coalesce(F.try_divide(true_positive, true_positive + false_positive), F.lit(1.0)).alias("precision"),
        F.coalesce(F.try_divide(true_positive, true_positive + false_negative), F.lit(1.0)).alias("recall"),
        F.coalesce(F.try_divide(right, everything), F.lit(0.0)).alias("accuracy"),
    ]


def holdout(df: DataFrame, label: str, ident: str, share: float, seed: str = "42") -> DataFrame:
    """Stratified split by hash: max(1, floor(n * share)) rows of each label are ``test``. Ranks are dealt by label and salt.

    The cut is a hash threshold found from counts in 256 buckets, then refined within one bucket, so no label's rows meet.
    """
    mark = F.sha2(F.concat_ws(":", F.lit(seed), F.col(ident).cast("string")), 256)
    rows = df.withColumn("_mark", mark).withColumn("_bucket", F.substring("_mark", 1, 2))
    counts = rows.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(label).orderBy("_bucket")
    counts = counts.withColumn("_before", F.sum("_n").over(order) - F.col("_n")).withColumn("_quota", F.greatest(F.lit(1), F.floor(F.sum("_n").over(Window.partitionBy(label)) * share)))
    placed = rows.join(counts, [label, "_bucket"])
    rank = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_mark", ident)) + F.col("_before")
    return placed.withColumn("test", rank <= F.col("_quota")).select(*df.columns, "test")


def best_iteration(df: DataFrame, by: str, score: str, iteration: str) -> DataFrame:
    """The first iteration with the largest score."""
    return df.groupBy(by).agg(F.max(F.struct(F.col(score), -F.col(iteration))).alias("_b")).select(by, (-F.col("_b")["col2"]).alias(iteration), F.col("_b")[score].alias(score))

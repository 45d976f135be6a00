"""Helpers that the corpus operators share."""

from __future__ import annotations

from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stored import fresh, store


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder below the one that driver and executors share that nothing has used yet."""
    return fresh(spark, name)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``keep`` wrote and nothing reads any more; they stay where Arrow does not know the store."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        with suppress(pa.ArrowInvalid, FileNotFoundError):
            files, path = store(name)
            files.delete_dir(path)


MANY = 10_000  #: classes up to which their sizes are broadcast


def bounded_sample(rows: DataFrame, by: str | None, most: int, salt: str) -> DataFrame:
    """At most ``most`` distinct rows of each value of ``by`` (of all rows without it), all there are if they are fewer.

    Rows are picked by a hash of all their columns, so repeated rows count once and cannot crowd out others. A first cut by the
    hash leaves about four times as many as wanted and some more, however many rows a value has, so that no task ranks more than that.
    The sizes of up to MANY classes are broadcast; of more, joined.
    """
    pick = F.xxhash64(F.lit(salt), *rows.columns)
    named = rows.withColumn("_class", F.col(by).cast("string") if by else F.lit("")).withColumn("_pick", pick).distinct()
    named = keep(named, "sampled")
    share = F.lit(4.0 * most + 64) / F.col("_size")
    sizes = keep(named.groupBy("_class").agg(F.count("*").alias("_size")), "sizes")
    few = sizes.limit(MANY + 1).count() <= MANY
    cut = named.join(F.broadcast(sizes) if few else sizes, "_class").where(F.col("_pick") / float(1 << 64) + 0.5 < share)
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("_class").orderBy("_pick", *rows.columns)))
    return ranked.where(F.col("_rank") <= most).select(rows.columns)


def one_text(rows: DataFrame, text: str, *by: str) -> DataFrame:
    """rows(by..., text) -> one row for each ``by``, with the text of the smallest hash where an id has several; repeats meet where they lie."""
    return rows.groupBy(*by).agg(F.min_by(text, F.xxhash64(text)).alias(text))

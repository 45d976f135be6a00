"""Streams over files that run until the available input is used up.

State and sink tables lie in a folder that the caller gives, or in a fresh one of the shared folder. A query that is
started again with the same folder goes on from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stored import fresh


def file_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The files of a table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{table}.parquet*")


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key; only keys are kept in the stream's state."""
    return stream.dropDuplicates(keys)


def drained(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Run the stream over what is available and return its result table. A batch that is run again replaces itself."""
    spark = stream.sparkSession
    path = folder or fresh(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table" if mode == "complete" else f"{path}/table/{number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/table")


def upserted(stream: DataFrame, keys: list[str], order: str, folder: str | None = None, merge_every: int = 16) -> DataFrame:
    """Latest row of each key over all micro-batches of the stream, those of earlier runs with the same folder included.

    A batch writes only its own latest rows, so its cost does not grow with the state; a batch that is run again replaces
    itself. Every ``merge_every`` batches, and in the result, the latest of the written rows is taken.
    """
    spark = stream.sparkSession
    path = folder or fresh(spark, "state")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_number", T.LongType())])

    def latest(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_rank = 1").drop("_rank")

    def fold(batch: DataFrame, number: int) -> None:
        rows = batch
        if number and number % merge_every == 0:  # this batch takes over what stands before it
            since = number - merge_every
            before = spark.read.schema(schema).option("basePath", f"{path}/table").parquet(f"{path}/table").where(F.col("batch_number").between(since, number - 1)).drop("batch_number")
            rows = batch.unionByName(before)
        latest(rows).write.mode("overwrite").parquet(f"{path}/table/batch_number={number}")

    stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(fold).start().awaitTermination()
    written = spark.read.schema(schema).parquet(f"{path}/table")
    newest = written.agg(F.max("batch_number")).first()[0]
    base = (newest or 0) // merge_every * merge_every
    return latest(written.where(F.col("batch_number") >= base).drop("batch_number"))

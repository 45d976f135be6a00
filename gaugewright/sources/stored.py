"""Tables written between steps, in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}  #: temporary folders of local sessions without a shared one, by application


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme; one without belongs to Hadoop's default file system, as it does for Spark's readers and writers."""
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = named.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(named).toString()
    return re.sub("^file:/+", "file:///", full)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it, with its scheme.

    Where that is unset, a temporary folder if all runs on this machine (tests), else an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _made:
            _made[app] = "file://" + tempfile.mkdtemp(prefix="gaugewright-")
        base = _made[app]
    return qualified(spark, base).rstrip("/")


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a qualified URI, and the path in it; tasks read and write their own files through it."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def fresh(spark: SparkSession, name: str) -> str:
    """A folder below the shared one that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read back."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

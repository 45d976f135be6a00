"""Corpus preparation: stages over ``documents``, each written as Parquet and read again as the next one's input.

All stages take null, empty and very long texts, null ids, repeated rows, empty tables and further columns of any name, and
all but the last return the columns that they got. Rows that a stage neither drops nor changes pass as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.llm import decontaminate, langid, linededup, nearcopies
from gaugewright.llm.common import keep, read
from gaugewright.llm.queries import mixed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language ID rejects; the model is learned from the rows that are not held out.

    The test runs where the documents lie: they are neither joined nor shuffled. Texts that are null or without a letter are
    rejected, and all texts where no language can be learned; repeated rows share their fate.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang").where(langid.fold() != 1))
    return langid.accepted(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs; documents that lose all their lines go, texts that change are recounted.

    Rows that repeat id and text are one document and all stay; null and empty texts stay.
    """
    out = linededup.line_dedup(docs)
    changed = F.size("lines_removed") > 0
    count = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.where(~changed | (F.col("text") != "")).withColumn("n_chars", count).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one whose id names it.

    Groups are those of SimHash on five words, verified, and completed to all links at a Jaccard similarity of 0.8 or more.
    Null and empty texts are one group. Rows that repeat the id that stays all stay; documents without an id are never dropped.
    """
    groups = nearcopies.near_copies(docs)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark text, whole, interrupted or reordered; null and empty texts stay, an empty benchmark drops nothing."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every document its tokens, domain posteriors and the rate that brings the mixture to its targets.

    Every row stays, texts without words too; without labelled rows all targets' domains are equally likely.
    """
    return mixed(spark, docs, sf_dir)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("mixture", mixture)]

#: Fingerprints, tilings and fitted rates are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

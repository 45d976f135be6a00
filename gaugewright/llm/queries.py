"""Queries over the whole test tables, one per operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, fingerprints, langid, licenses, linededup, mixing, neighbours, oracles, secrets, simhash, spelling, toxicity, warc
from .common import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(read(spark, sf_dir, "documents"))


#: Domains of the labelled table, and the shares of tokens that the mixture aims at.
DOMAINS = "case when quality = 0 then 'junk' when toxic = 1 then 'toxic' else 'clean' end"
TARGETS = {"clean": 0.85, "junk": 0.1, "toxic": 0.05}


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = read(spark, sf_dir, "labels").selectExpr("doc_id", f"{DOMAINS} as domain")
    return mixing.mix(docs, labelled, TARGETS)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir).drop("text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.line_dedup(read(spark, sf_dir, "documents"))
    return rows.selectExpr("doc_id", "lines_total", "size(lines_removed) as n_removed", "array_join(lines_removed, ',') as removed", "text")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = warc.archive(read(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "key", "file", "offset", "length")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_dedup(read(spark, sf_dir, "embeddings"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _misspelt() -> Column:
    """The word, or for one in 97 pairs of document and word the word without one code point."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary"))
    at = (h % F.char_length("word")).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))).otherwise(F.col("word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(spelling.words(read(spark, sf_dir, "documents"), _misspelt())))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, heads = F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return conversations.trie(conversations.rebuilt(read(spark, sf_dir, "conversations"), base, heads))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_mixing, op3_toxicity, op4_licenses, op5_language, op6_line_dedup, op7_warc, op8_neighbours, op9_secrets, op10_decontaminate, op11_spelling, op12_conversation_trie, op13_fingerprints)}


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; the others are held against brute force, round trips or held-out rows in the tests."""
    return {"op11_spelling": oracles.SPELLING, "op12_conversation_trie": oracles.CONVERSATION_TRIE}

"""Inventories: coverage, shortages, references and event notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage_line(declared: list[str], measured: DataFrame, group: str, key: str) -> DataFrame:
    """(group, measured, not_measured): names of a declared list in its own order, by whether they were measured."""
    order = F.array(*map(F.lit, declared))
    on = measured.groupBy(group).agg(F.collect_set(F.when(F.col(key).isin(*declared), F.col(key))).alias("_on"))  # at most the declared names
    names = lambda has: F.array_join(F.filter(order, lambda x: F.array_contains("_on", x) == has), ", ")
    return on.select(group, names(True).alias("measured"), names(False).alias("not_measured"))


def shortages(slots: DataFrame, stock: DataFrame, key: str) -> DataFrame:
    """slots(key, fill, wants), stock(key, have) -> totals by key: slots of each fill, wants, and what is lacking."""
    totals = slots.groupBy(key).agg(F.count_if(F.col("fill") == "own").alias("own"), F.count_if(F.col("fill") == "mixed").alias("mixed"), F.count_if(F.col("fill") == "empty").alias("empty"), F.sum("wants").alias("wants"))
    have = F.coalesce("have", F.lit(0))
    return totals.join(stock, key, "left").withColumn("have", have).withColumn("shortage", F.greatest(F.lit(0), F.col("wants") - F.col("have")))


def dangling(citations: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """References to what is not there, each once."""
    return citations.select(*keys).distinct().join(present.select(*keys), keys, "left_anti")


def stored_reference(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """wanted(key, version), stored(key, version): found, or why not: another version is stored, or none."""
    exact = stored.select(key, "version", F.lit(True).alias("_exact")).distinct()
    known = stored.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions"))
    joined = wanted.join(exact, [key, "version"], "left").join(known, key, "left")
    return joined.withColumn("state", F.when(F.col("_exact"), "found").when(F.col("versions").isNotNull(), "version gap").otherwise("coverage gap")).drop("_exact")


def next_requirement(current: Column, needed: Column, unknown: Column) -> Column:
    """What an upgrade asks of its host: nothing, a change, or a reading first."""
    from ..functions.versions import parts

    return F.when(needed == "", "none").when(unknown, "read first").when(parts(current) >= parts(needed), "none").otherwise("change")


def best_answers(pairs: DataFrame, question: str, answer: str, pos: str) -> DataFrame:
    """The longest answer of each question, the first of equals; and how many pairs were dropped for it."""
    order = F.struct(F.length(answer), -F.col(pos))
    return pairs.groupBy(question).agg(F.max_by(answer, order).alias(answer), (F.count("*") - 1).alias("dropped"))


def alt_passes(images: DataFrame, page: str, alt: str) -> DataFrame:
    """Is an alternative text useful: four words or more, at most 125 characters, no file name, and used once on its page."""
    shared = F.count("*").over(Window.partitionBy(page, alt))
    text = F.trim(F.coalesce(F.col(alt), F.lit("")))
    good = (F.size(F.split(text, "\\s+")) >= 4) & (F.length(text) <= 125) & ~text.rlike("(?i)\\.(jpe?g|png|gif|webp|svg)$") & (text != "")
    return images.withColumn("passes", good & (shared == 1))


def notes(events: DataFrame, kind: str, number: str) -> DataFrame:
    """Progress events as sentences; kinds without one are silent."""
    n = F.col(number).cast("string")
    said = F.when(F.col(kind) == "view", F.concat(F.lit("Read "), n, F.lit(" pages"))).when(F.col(kind) == "error", F.concat(n, F.lit(" pages failed"))).when(F.col(kind) == "purchase", F.concat(F.lit("Found "), n, F.lit(" products")))
    return events.withColumn("note", said).where("note is not null")

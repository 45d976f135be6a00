"""Resolving names to records, and checking that mentions agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unambiguous(records: DataFrame, key: str, ident: str) -> DataFrame:
    """(key, ident) of keys that one record owns; a key of two records is dropped, not resolved."""
    filled = records.where(F.coalesce(F.col(key), F.lit("")) != "")
    return filled.groupBy(key).agg(F.count("*").alias("_n"), F.max(ident).alias(ident)).where("_n = 1").drop("_n")


def by_longest_prefix(names: DataFrame, name: str, titles: DataFrame, title: str, ident: str, least: int = 5) -> DataFrame:
    """names, with the record whose title is the longest prefix of the name.

    Prefixes of the name, from ``least`` characters on, meet the titles by equality: a hash join in place of a test of
    every name with every title.
    """
    starts = names.select(name).distinct().where(F.length(name) >= least).withColumn("_prefix", F.explode(F.transform(F.sequence(F.lit(least), F.length(name)), lambda n: F.substring(F.col(name), F.lit(1), n))))
    found = starts.join(titles.select(F.col(title).alias("_prefix"), ident), "_prefix").groupBy(name).agg(F.max_by(ident, F.length("_prefix")).alias(ident))
    return names.join(found, name, "left")


def mentions(names: DataFrame, name: str, texts: DataFrame, ident: str, words: str) -> DataFrame:
    """(name, ident) of texts that hold a name as consecutive words. texts(ident, words array).

    A text's words are zipped with themselves, shifted, so that each place is a row with as many words as the longest name
    has; its runs, one a length, meet the names by equality. Small sets of names are broadcast by Spark itself, and then no
    word is shuffled. The lengths of names are few numbers.
    """
    spelled = names.select(F.col(name), F.lower(name).alias("_run"), F.size(F.split(F.lower(name), " ")).alias("_n"))
    lengths = sorted(r[0] for r in spelled.select("_n").distinct().collect())
    if not lengths:
        return names.select(name).join(texts.select(ident).where("false"), F.lit(True))
    most = lengths[-1]
    shifted = texts.select(ident, *((F.col(words) if k == 0 else F.slice(words, k + 1, 1 << 30)).alias(f"_w{k}") for k in range(most)))
    places = shifted.select(ident, F.explode(F.arrays_zip(*(f"_w{k}" for k in range(most)))).alias("_r"))
    run = lambda n: F.when(F.col(f"_r._w{n - 1}").isNotNull(), F.concat_ws(" ", *(F.col(f"_r._w{k}") for k in range(n))))
    runs = run(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*map(run, lengths)))
    return places.select(ident, runs.alias("_run")).where("_run is not null").join(spelled, "_run").select(name, ident).distinct()


def inconsistent(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with two or more distinct values, and how many. Distinct pairs are taken before the count."""
    return pairs.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value).distinct().groupBy(key).agg(F.count("*").alias("variants")).where("variants >= 2")


def first_positions(found: DataFrame, cell: str, offset: str, index: str) -> DataFrame:
    """Expected rank of each entity by where its name first stands; null for the cell if any name was not found."""
    w = Window.partitionBy(cell)
    rank = F.row_number().over(w.orderBy(offset, index))
    return found.withColumn("expected", F.when(F.min(F.when(F.col(offset) >= 0, 1).otherwise(0)).over(w) == 1, rank))


def positions_complete(found: DataFrame, cell: str, position: str) -> DataFrame:
    """Do the positions of a cell run from 1 to their number without gap or repetition? Only counts are gathered."""
    counted = found.groupBy(cell).agg(F.count("*").alias("n"), F.countDistinct(position).alias("d"), F.min(position).alias("low"), F.max(position).alias("high"))
    return counted.select(cell, F.coalesce((F.col("n") == F.col("d")) & (F.col("low") == 1) & (F.col("high") == F.col("n")), F.lit(False)).alias("complete"))


def claims(packages: DataFrame) -> DataFrame:
    """packages(ordinal, label, type, element, grp): the last claim of each exact key, the first of each key without group."""
    rows = packages.where("element <> ''").select("ordinal", "label", F.lower("type").alias("type"), F.lower("element").alias("element"), F.lower("grp").alias("grp"))
    exact = rows.groupBy("type", "element", "grp").agg(F.max_by("label", "ordinal").alias("label"))
    loose = rows.groupBy("type", "element").agg(F.min_by("label", "ordinal").alias("loose"), F.max_by("label", F.when(F.col("grp") == "", F.col("ordinal"))).alias("blank"))
    return exact.where("grp <> ''").union(loose.select("type", "element", F.lit(""), F.coalesce("blank", "loose")))

"""Answers of engines: citations, support of named entities, verdicts of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls


def distinct_citations(rows: DataFrame, cell: str, url: str, pos: str) -> DataFrame:
    """The first citation of each url of a cell."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(cell, url).orderBy(pos))).where("_rank = 1").drop("_rank")


def citations_by_domain(rows: DataFrame, cell: str, url: str, title: str, pos: str, most: int = 3) -> DataFrame:
    """(cell, domain, title, urls, first): first title and at most ``most`` urls of each domain, ranks cut before they are gathered."""
    domain = urls.host(F.col(url))
    ranked = rows.withColumn("domain", domain).withColumn("_rank", F.row_number().over(Window.partitionBy(cell, "domain").orderBy(pos))).where(F.col("_rank") <= most)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, url))), lambda x: x[url]), " ")
    return ranked.groupBy(cell, "domain").agg(F.min_by(title, pos).alias("title"), listed.alias("urls"), F.min(pos).alias("first"))


def supported(name: Column, domain: Column, evidence: Column, answer: Column, cited: Column) -> Column:
    """Does an answer bear out a named entity: by its name, by a cited domain, or by a quotation that holds part of the name."""
    said, called, quoted = text.fuzz(answer), text.fuzz(name), text.fuzz(evidence)
    by_name = (F.length(called) >= text.min_fuzz_length(called)) & F.contains(said, called)
    by_domain = F.exists(cited, lambda c: domain_fits(c, domain))
    parts = F.filter(text.tokens(name), lambda x: F.length(x) >= 4)
    by_quote = (F.length(quoted) >= 12) & F.contains(said, quoted) & F.exists(parts, lambda x: F.contains(quoted, x))
    return F.coalesce(by_name, F.lit(False)) | F.coalesce(by_domain, F.lit(False)) | F.coalesce(by_quote, F.lit(False))


def domain_fits(host: Column, domain: Column) -> Column:
    """The domain itself or a part of it; names that merely end alike do not fit."""
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def cell_verdict(found: DataFrame, cell: str) -> DataFrame:
    """found(cell, name, position, is_target) -> number named, whether and where the target stands, and the first three names."""
    order = Window.partitionBy(cell).orderBy(F.asc_nulls_last("position"), "name")
    ranked = found.withColumn("_rank", F.row_number().over(order))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_rank") <= 3, F.struct("_rank", "name")))), lambda x: x["name"]), ", ")
    return ranked.groupBy(cell).agg(F.count("*").alias("named"), F.bool_or("is_target").alias("has_target"), F.min(F.when(F.col("is_target"), F.col("position"))).alias("target_position"), top.alias("first_three"))


def gate_codes(found: DataFrame, cell: str) -> DataFrame:
    """(cell, code) of everything that bars a cell: nameless entities, several targets, positions that do not run from 1."""
    per = found.groupBy(cell).agg(
        F.count_if(F.coalesce(F.trim("name"), F.lit("")) == "").alias("nameless"), F.count_if("is_target").alias("targets"),
        F.count("*").alias("n"), F.countDistinct("position").alias("d"), F.min("position").alias("low"), F.max("position").alias("high"),
    )
    even = F.coalesce((F.col("n") == F.col("d")) & (F.col("low") == 1) & (F.col("high") == F.col("n")), F.lit(False))
    codes = F.array(F.when(F.col("nameless") > 0, "EMPTY_NAME"), F.when(F.col("targets") > 1, "MULTIPLE_TARGETS"), F.when(~even, "BAD_POSITIONS"))
    return per.select(cell, F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("code"))


def breaker(log: DataFrame, source: str, pos: str, failed: str, most: int = 10) -> DataFrame:
    """Position at which each source of a response log has ``most`` failures in a row, if it ever has."""
    w = Window.partitionBy(source).orderBy(pos)
    streak = log.withColumn("_ok", F.sum((~F.col(failed)).cast("int")).over(w)).withColumn("_run", F.sum(F.col(failed).cast("int")).over(Window.partitionBy(source, "_ok").orderBy(pos)))
    return streak.where(F.col("_run") == most).groupBy(source).agg(F.min(pos).alias("opened_at"))

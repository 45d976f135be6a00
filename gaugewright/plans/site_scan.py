"""Site scan: raw pages -> facts -> link graph -> findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls
from ..operators import findings
from ..operators.findings import Check
from ..sources.stored import stored


def edges(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, source, link, target, internal), one row per distinct link of a page."""
    links = pages.select("page_id", F.col("url").alias("source"), F.explode(urls.links(F.col("html"))).alias("link"))
    target = urls.resolve(F.col("link"), F.col("source"))
    return links.withColumn("target", target).where("target is not null").withColumn("internal", urls.same_site(F.col("source"), F.col("target")))


def seo_checks() -> list[Check]:
    c = F.col
    return [
        Check("missing-title", "Pages without a title", 1, c("title") == ""),
        Check("missing-meta-description", "Pages without a description", 1, c("meta_description").isNull()),
        Check("duplicate-title", "Pages that share a title", 2, c("duplicate_title")),
        Check("thin-content", "Pages under 150 words", 2, c("word_count") < 150),
        Check("missing-canonical", "Pages without a canonical address", 3, c("canonical").isNull()),
    ]


def seo_findings(pages: DataFrame) -> DataFrame:
    """Ranked findings of pages(page_id, url, html)."""
    narrow = stored(html.page_facts(pages).select("page_id", "url", "title", "word_count", "meta_description", "canonical"), "facts")  # so that pages are parsed once
    facts = findings.duplicates(narrow, "title", "duplicate_title")
    return findings.ranked(findings.findings(facts, seo_checks(), "url", "page_id"))

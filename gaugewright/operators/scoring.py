"""Weighted multi-level scores in which what was not measured stays unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Share of the total that each factor holds.
FACTORS = {"discoverability": 28, "content": 30, "entity-trust": 30, "merchant": 12}

#: Criterion, factor, group, weight, impact.
CRITERIA = [
    ("ai-bots-allowed", "discoverability", "access-findability", 3, "Critical"),
    ("google-merchant-feed", "discoverability", "access-findability", 3, "Critical"),
    ("internal-linking", "discoverability", "access-findability", 1, "Medium"),
    ("crawlable-text", "discoverability", "content-readability", 2, "High"),
    ("image-alt-text", "discoverability", "content-readability", 1, "Medium"),
    ("heading-hierarchy", "discoverability", "content-readability", 1, "Medium"),
    ("brand-in-title", "discoverability", "content-readability", 3, "Critical"),
    ("product-schema", "discoverability", "machine-readability", 3, "Critical"),
    ("product-schema-rich", "discoverability", "machine-readability", 2, "High"),
    ("review-schema", "discoverability", "machine-readability", 2, "High"),
    ("shipping-schema", "discoverability", "machine-readability", 2, "High"),
    ("faq-schema", "discoverability", "machine-readability", 2, "High"),
    ("organization-schema", "discoverability", "machine-readability", 3, "Critical"),
    ("breadcrumb-schema", "discoverability", "machine-readability", 1, "Medium"),
    ("video-schema", "discoverability", "machine-readability", 1, "Medium"),
    ("specifications", "content", "product-facts", 3, "Critical"),
    ("original-media", "content", "product-facts", 1, "Medium"),
    ("compatibility-sizing", "content", "product-facts", 2, "High"),
    ("safety-materials", "content", "product-facts", 2, "High"),
    ("benefits-outcomes", "content", "decision-support", 2, "High"),
    ("limitations-honest", "content", "decision-support", 1, "Medium"),
    ("comparison-alternatives", "content", "decision-support", 2, "High"),
    ("who-is-it-for", "content", "decision-support", 2, "High"),
    ("faq-product", "content", "questions-answered", 3, "Critical"),
    ("troubleshooting-care", "content", "questions-answered", 1, "Medium"),
    ("unique-description", "content", "ai-readiness", 3, "Critical"),
    ("freshness", "content", "ai-readiness", 1, "Medium"),
    ("answer-formatting", "content", "ai-readiness", 3, "Critical"),
    ("about-page", "entity-trust", "business-credibility", 1, "Medium"),
    ("contact-info", "entity-trust", "business-credibility", 2, "High"),
    ("policies-quality", "entity-trust", "business-credibility", 2, "High"),
    ("onsite-reviews", "entity-trust", "business-credibility", 1, "Medium"),
    ("google-reviews", "entity-trust", "reviews-buzz", 2, "High"),
    ("trustpilot", "entity-trust", "reviews-buzz", 2, "High"),
    ("reddit", "entity-trust", "reviews-buzz", 3, "Critical"),
    ("social-video-mentions", "entity-trust", "reviews-buzz", 2, "High"),
    ("press-and-lists", "entity-trust", "authority-recognition", 3, "Critical"),
    ("entity-databases", "entity-trust", "authority-recognition", 1, "Medium"),
    ("price-competitive", "merchant", "merchant", 2, "High"),
    ("shipping-competitive", "merchant", "merchant", 1, "Medium"),
]


def criteria(spark: SparkSession) -> DataFrame:
    """The criterion dimension with each criterion's share of the total; shares add up to 100."""
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CRITERIA)], "ordinal int, key string, factor string, sub_group string, weight int, impact string")
    budget = F.create_map(*(F.lit(x) for pair in FACTORS.items() for x in pair))
    return rows.withColumn("global_weight", F.element_at(budget, F.col("factor")) * F.col("weight") / F.sum("weight").over(Window.partitionBy("factor")))


def evaluated(dimension: DataFrame, answers: DataFrame) -> DataFrame:
    """Every criterion of every audit; one without an answer is inactive. answers(audit, key, status, score)."""
    audits = answers.select("audit").distinct()
    grid = audits.join(F.broadcast(dimension))  # the dimension has 40 rows
    return grid.join(answers, ["audit", "key"], "left").withColumn("status", F.coalesce("status", F.lit("inactive")))


def weighted_mean(weight: Column, score: Column, status: Column) -> Column:
    """Mean over scored rows only; null where they weigh nothing."""
    on = status == "scored"
    return F.sum(F.when(on, weight * score)) / F.nullif(F.sum(F.when(on, weight)), F.lit(0))


def tier(total: Column) -> Column:
    return F.when(total.isNull(), None).when(total < 50, "weak").when(total < 80, "moderate").otherwise("strong")


def impact(rows: DataFrame) -> DataFrame:
    """What each scored criterion costs its audit: (100 - score) by its share among the scored ones."""
    on = F.when(F.col("status") == "scored", F.col("global_weight"))
    share = on / F.nullif(F.sum(on).over(Window.partitionBy("audit")), F.lit(0))
    return rows.withColumn("impact_rank", (100 - F.col("score")) * share)


def root_score(count: Column, factor: float) -> Column:
    """Mentions count less and less: factor times the square root, at most 100."""
    return F.least(F.lit(100.0), F.round(factor * F.sqrt(count)))


def gap_score(gap: Column) -> Column:
    """Price gap in per cent to a score: five below is full marks, forty above none."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(100 * (40 - gap) / 35)))


def rating_score(rating: Column, count: Column, low: float, high: float, enough: int = 50) -> Column:
    """No profile or a rating under ``low`` is 0; ``high`` with enough votes 100; else 50."""
    return F.when(rating.isNull() | (rating < low), 0).when((rating >= high) & (count >= enough), 100).otherwise(50)


#: Weights of the parts of a question-and-answer score.
FAQ_WEIGHTS = {"count": 0.2, "intent": 0.2, "phrasing": 0.1, "length": 0.1, "complete": 0.3, "format": 0.1}


def faq_score(pairs: Column, intent: Column, phrasing: Column, stubs: Column, complete: Column, fmt: Column) -> Column:
    """Score of a set of question-answer pairs from counts of the good ones; three pairs at least are expected."""
    most = F.greatest(pairs, F.lit(3))
    parts = {"count": F.least(pairs / 3, F.lit(1.0)), "intent": intent / most, "phrasing": phrasing / most, "length": (pairs - stubs) / most, "complete": complete / most, "format": fmt / most}
    total = sum((F.lit(100 * FAQ_WEIGHTS[k]) * x for k, x in parts.items()), F.lit(0.0))
    return F.when(pairs == 0, 0.0).otherwise(F.round(total))


def lane_impact(rows: DataFrame, *by: str) -> DataFrame:
    """rows(ordinal, key, impact, global_weight, ...) -> per group the number of criteria, the critical keys in order, and the weight to a tenth."""
    critical = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("impact") == "Critical", F.struct("ordinal", "key")))), lambda x: x["key"]), ",")
    return rows.groupBy(*by).agg(F.count("*").alias("criteria"), F.nullif(critical, F.lit("")).alias("critical"), F.round(F.sum("global_weight"), 1).alias("weight"))


def rival_gaps(items: DataFrame, rivals: DataFrame, item: str, price: str, currency: str, least: int = 2) -> DataFrame:
    """items and rivals, both (item, price, currency) -> (item, rivals, median, gap, score), an item a row.

    Only rivals' prices above zero in the item's own currency count; the median of an even number is the mean of the middle
    two. With fewer than ``least`` of them, or without a price of its own, an item has no median, gap in percent or score.
    """
    theirs = rivals.where(F.col(price) > 0).select(item, currency, F.col(price).alias("_theirs"))
    per = theirs.groupBy(item, currency).agg(F.count("*").alias("rivals"), F.median("_theirs").alias("_median"))
    enough = F.when((F.col("rivals") >= least) & (F.col(price) > 0), F.col("_median"))
    gap = F.round(100 * (F.col(price) - enough) / enough, 6)
    return items.join(per, [item, currency], "left").select(item, F.coalesce("rivals", F.lit(0)).alias("rivals"), F.round(enough, 6).alias("median"), gap.alias("gap"), F.when(enough.isNotNull(), gap_score(gap)).alias("score"))

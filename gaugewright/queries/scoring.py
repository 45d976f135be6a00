"""Scores, statistics and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring, stats
from .registry import query, read

#: Criteria of the oracle, written out as rows.
DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{f}', '{g}', {w}, '{m}', {scoring.FACTORS[f]})" for i, (k, f, g, w, m) in enumerate(scoring.CRITERIA)) + ") t(ordinal, key, factor, sub_group, weight, impact, pct))"
#: Every document is an audit that answers some criteria; the rest is inactive.
ANSWERS = """ans AS (SELECT doc_id AS audit, ordinal AS o, CASE WHEN (doc_id + ordinal) % 7 = 0 THEN 'na' ELSE 'scored' END AS status, CASE WHEN (doc_id + ordinal) % 7 <> 0 THEN (doc_id * 13 + ordinal * 29) % 101 END AS score FROM documents, dim WHERE (doc_id + ordinal) % 5 <> 0)"""
ROWS = f"WITH {DIM}, {ANSWERS}, r AS (SELECT d.doc_id AS audit, dim.*, coalesce(status, 'inactive') AS status, score, pct * weight / (sum(weight) OVER (PARTITION BY d.doc_id, factor)) AS gw FROM documents d CROSS JOIN dim LEFT JOIN ans ON ans.audit = d.doc_id AND ans.o = dim.ordinal)"


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimension = scoring.criteria(spark)
    i, o = F.col("doc_id"), F.col("ordinal")
    grid = read(spark, sf_dir, "documents").select("doc_id").join(F.broadcast(dimension.select("ordinal", "key"))).where((i + o) % 5 != 0)
    na = (i + o) % 7 == 0
    answers = grid.select(i.alias("audit"), "key", F.when(na, "na").otherwise("scored").alias("status"), F.when(~na, ((i * 13 + o * 29) % 101).cast("double")).alias("score"))
    return scoring.evaluated(dimension, answers)


@query(f"{ROWS} SELECT audit, key, factor, round(gw, 6) AS global_weight FROM r WHERE status = 'scored'")
def a14_global_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each scored criterion of each audit weighs."""
    return audits(spark, sf_dir).where("status = 'scored'").select("audit", "key", "factor", F.round("global_weight", 6).alias("global_weight"))


@query(f"""{ROWS} SELECT audit, coalesce(factor, '-') AS factor, coalesce(sub_group, '-') AS sub_group, round(sum(CASE WHEN status = 'scored' THEN gw * score END) / nullif(sum(CASE WHEN status = 'scored' THEN gw END), 0), 6) AS score
FROM r GROUP BY GROUPING SETS ((audit, factor, sub_group), (audit, factor), (audit))""")
def a13_weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of groups, factors and audits; groups are summed first, so that only sums are repeated for the levels above."""
    on = F.col("status") == "scored"
    sums = audits(spark, sf_dir).groupBy("audit", "factor", "sub_group").agg(F.sum(F.when(on, F.col("global_weight") * F.col("score"))).alias("held"), F.sum(F.when(on, F.col("global_weight"))).alias("weight"))
    levels = sums.groupingSets([["audit", "factor", "sub_group"], ["audit", "factor"], ["audit"]], "audit", "factor", "sub_group")
    mean = F.sum("held") / F.nullif(F.sum("weight"), F.lit(0))
    return levels.agg(F.round(mean, 6).alias("score")).select("audit", F.coalesce("factor", F.lit("-")).alias("factor"), F.coalesce("sub_group", F.lit("-")).alias("sub_group"), "score")


@query(f"""{ROWS}, t AS (SELECT audit, sum(CASE WHEN status = 'scored' THEN gw * score END) / nullif(sum(CASE WHEN status = 'scored' THEN gw END), 0) AS total FROM r GROUP BY 1)
SELECT audit, round(total, 6) AS total, CASE WHEN total IS NULL THEN NULL WHEN total < 50 THEN 'weak' WHEN total < 80 THEN 'moderate' ELSE 'strong' END AS tier FROM t""")
def a17_verdict_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = audits(spark, sf_dir).groupBy("audit").agg(scoring.weighted_mean(F.col("global_weight"), F.col("score"), F.col("status")).alias("total"))
    return total.select("audit", F.round("total", 6).alias("total"), scoring.tier(F.col("total")).alias("tier"))


@query(f"{ROWS} SELECT audit, CAST(sum(CASE WHEN status = 'scored' THEN 1 ELSE 0 END) AS BIGINT) AS scored, CAST(sum(CASE WHEN status = 'na' THEN 1 ELSE 0 END) AS BIGINT) AS na, CAST(sum(CASE WHEN status = 'inactive' THEN 1 ELSE 0 END) AS BIGINT) AS inactive FROM r GROUP BY 1")
def a15_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("scored", "na", "inactive")]
    return audits(spark, sf_dir).groupBy("audit").agg(*counts)


@query(f"""{ROWS}, i AS (SELECT audit, key, ordinal, (100 - score) * (CASE WHEN status = 'scored' THEN gw END) / sum(CASE WHEN status = 'scored' THEN gw END) OVER (PARTITION BY audit) AS impact_rank FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY audit ORDER BY round(impact_rank, 9) DESC, ordinal) AS n FROM i WHERE impact_rank > 0) SELECT audit, key, round(impact_rank, 6) AS impact_rank, CAST(n AS INTEGER) AS rank FROM k WHERE n <= 3""")
def a16_top_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import top

    rows = scoring.impact(audits(spark, sf_dir)).where("impact_rank > 0")
    return top(rows, ["audit"], [F.desc(F.round("impact_rank", 9)), F.col("ordinal")], 3).select("audit", "key", F.round("impact_rank", 6).alias("impact_rank"), "rank")


@query(f"{ROWS} SELECT audit, factor, count(*) AS criteria, string_agg(CASE WHEN impact = 'Critical' THEN key END, ',' ORDER BY ordinal) AS critical, round(sum(gw), 1) AS weight FROM r WHERE status <> 'scored' GROUP BY 1, 2")
def a18_lane_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each audit leaves unmeasured, by factor: how many criteria, the critical ones, and their weight."""
    return scoring.lane_impact(audits(spark, sf_dir).where("status <> 'scored'"), "audit", "factor")


@query("""WITH m AS (SELECT p_brand, median(p_retailprice) AS mid, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, round(mid, 4) AS median, round(100 * (p_retailprice - mid) / mid, 6) AS gap,
CASE WHEN n >= 2 THEN CAST(least(100, greatest(0, round(100 * (40 - round(100 * (p_retailprice - mid) / mid, 6)) / 35))) AS DOUBLE) END AS score FROM part JOIN m USING (p_brand)""")
def c39_price_competitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    mids = parts.groupBy("p_brand").agg(F.median("p_retailprice").alias("mid"), F.count("*").alias("n"))
    gap = F.round(100 * (F.col("p_retailprice") - F.col("mid")) / F.col("mid"), 6)
    return parts.join(mids, "p_brand").select("p_partkey", F.round("mid", 4).alias("median"), gap.alias("gap"), F.when(F.col("n") >= 2, scoring.gap_score(gap)).alias("score"))


@query("""WITH r AS (SELECT l_partkey AS k, CASE l_suppkey % 3 WHEN 0 THEN 'USD' ELSE 'EUR' END AS cur, l_extendedprice / l_quantity AS theirs FROM lineitem WHERE l_discount > 0), i AS (SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN 'USD' ELSE 'EUR' END AS cur, CASE WHEN p_size % 11 <> 0 THEN p_retailprice END AS own FROM part),
m AS (SELECT k, cur, count(*) AS n, median(theirs) AS mid FROM r GROUP BY 1, 2), j AS (SELECT i.k, coalesce(n, 0) AS n, CASE WHEN n >= 2 AND own > 0 THEN mid END AS mid, own FROM i LEFT JOIN m USING (k, cur))
SELECT k, n AS rivals, round(mid, 6) AS median, round(100 * (own - mid) / mid, 6) AS gap, CASE WHEN mid IS NOT NULL THEN CAST(least(100, greatest(0, round(100 * (40 - round(100 * (own - mid) / mid, 6)) / 35))) AS DOUBLE) END AS score FROM j""")
def a19_rival_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's price against those of its suppliers in the same currency."""
    rivals = read(spark, sf_dir, "lineitem").where("l_discount > 0").selectExpr("l_partkey as k", "l_extendedprice / l_quantity as price", "if(l_suppkey % 3 = 0, 'USD', 'EUR') as cur")
    items = read(spark, sf_dir, "part").selectExpr("p_partkey as k", "if(p_size % 11 <> 0, p_retailprice, null) as price", "if(p_size % 4 = 0, 'USD', 'EUR') as cur")
    return scoring.rival_gaps(items, rivals, "k", "price", "cur")


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) SELECT user_id, CAST(least(100, round(12.5 * sqrt(n))) AS DOUBLE) AS reddit, CAST(least(100, round(45 * sqrt(n))) AS DOUBLE) AS press FROM n""")
def c35_c37_mention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", scoring.root_score(F.col("n"), 12.5).alias("reddit"), scoring.root_score(F.col("n"), 45).alias("press"))


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, CAST(least(100, round(7 * sum(sqrt(n)))) AS DOUBLE) AS score FROM n GROUP BY 1""")
def c36_social_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.least(F.lit(100.0), F.round(7 * F.sum(F.sqrt("n")))).alias("score"))


@query("""WITH r AS (SELECT s_suppkey, 1 + (s_suppkey * 7 % 41) / 10.0 AS rating, s_suppkey * 13 % 120 AS votes FROM supplier)
SELECT s_suppkey, CASE WHEN rating < 3.5 THEN 0 WHEN rating >= 4.3 AND votes >= 50 THEN 100 ELSE 50 END AS google, CASE WHEN rating < 3.0 THEN 0 WHEN rating >= 4.0 AND votes >= 50 THEN 100 ELSE 50 END AS trustpilot FROM r""")
def c33_c34_rating_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "supplier").select("s_suppkey", (1 + (F.col("s_suppkey") * 7 % 41) / 10.0).alias("rating"), (F.col("s_suppkey") * 13 % 120).alias("votes"))
    score = lambda low, high: scoring.rating_score(F.col("rating"), F.col("votes"), low, high)
    return r.select("s_suppkey", score(3.5, 4.3).alias("google"), score(3.0, 4.0).alias("trustpilot"))


@query("""WITH q AS (SELECT conv_id, count(*) FILTER (role = 'user') AS n, count(*) FILTER (role = 'user' AND length(text) > 100) AS i, count(*) FILTER (role = 'user' AND length(text) > 50) AS p, count(*) FILTER (role = 'user' AND len(string_split(text, ' ')) < 20) AS s FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN n = 0 THEN 0.0 ELSE round(20 * least(n / 3.0, 1) + 20.0 * i / greatest(n, 3) + 10.0 * p / greatest(n, 3) + 10.0 * (n - s) / greatest(n, 3) + 30.0 * i / greatest(n, 3) + 10.0 * p / greatest(n, 3)) END AS score FROM q""")
def c26_question_answer_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("role") == "user"
    n = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(user).alias("n"), F.count_if(user & (F.length("text") > 100)).alias("i"), F.count_if(user & (F.length("text") > 50)).alias("p"), F.count_if(user & (F.size(F.split("text", " ")) < 20)).alias("s")
    )
    c = F.col
    return n.select("conv_id", scoring.faq_score(c("n"), c("i"), c("p"), c("s"), c("i"), c("p")).alias("score"))


@query("""SELECT event_type, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS stddev, min(value) AS min, max(value) AS max, count(value) AS n FROM events GROUP BY 1""")
def a28_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(read(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH s AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY 1) SELECT user_id, round(a - b, 4) AS delta FROM s WHERE a IS NOT NULL AND b IS NOT NULL""")
def a29_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = read(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    return wide.where("click is not null and view is not null").select("user_id", F.round(F.col("click") - F.col("view"), 4).alias("delta"))


@query("""WITH r AS (SELECT user_id AS query, user_id % 2 = 0 AS should, avg(CAST(value > 10 AS INTEGER)) AS rate, count(*) AS runs FROM events GROUP BY 1, 2) SELECT query, should, round(rate, 6) AS rate, runs, CASE WHEN should THEN rate >= 0.5 ELSE rate < 0.5 END AS passed FROM r""")
def a31_trigger_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "events").selectExpr("user_id as query", "user_id % 2 = 0 as should", "value > 10 as triggered")
    return stats.trigger_rates(runs).select("query", "should", F.round("rate", 6).alias("rate"), "runs", "passed")


@query("""WITH c AS (SELECT event_type, sum(CAST(value > 10 AND user_id % 2 = 0 AS INTEGER)) AS tp, sum(CAST(value > 10 AND user_id % 2 = 1 AS INTEGER)) AS fp, sum(CAST(value <= 10 AND user_id % 2 = 0 AS INTEGER)) AS fn, sum(CAST(value <= 10 AND user_id % 2 = 1 AS INTEGER)) AS tn FROM events GROUP BY 1)
SELECT event_type, round(coalesce(tp / nullif(tp + fp, 0), 1), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 1), 6) AS recall, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy FROM c""")
def a32_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit, yes = F.col("value") > 10, F.col("user_id") % 2 == 0
    c = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))
    out = c.select("event_type", *stats.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))
    return out.select("event_type", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "accuracy")))


@query("""WITH p AS (SELECT user_id, CAST(event_id % 6 AS INTEGER) AS iteration, count(*) FILTER (value > 10) AS passed FROM events GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY passed DESC, iteration) AS r FROM p) SELECT user_id, iteration, passed FROM b WHERE r = 1""")
def a33_best_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 6).cast("int").alias("iteration")).agg(F.count_if(F.col("value") > 10).alias("passed"))
    return stats.best_iteration(runs, "user_id", "passed", "iteration")


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('42:' || event_id), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_id, event_type, r <= greatest(1, floor(n * 0.4)) AS test FROM r""")
def a34_stratified_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.holdout(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 0.4)

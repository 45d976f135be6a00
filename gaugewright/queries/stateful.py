"""Incremental and stream-shaped queries, held against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reconcile
from ..streaming import incremental
from .registry import query, read

STATE = """i AS (SELECT o_orderkey AS url, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS VARCHAR) END AS lastmod FROM orders WHERE o_orderkey % 11 <> 0), s AS (SELECT o_orderkey AS url, CASE WHEN o_orderkey % 4 = 0 THEN '1999' ELSE CAST(o_orderdate AS VARCHAR) END AS lastmod FROM orders WHERE o_orderkey % 13 <> 0)"""


def crawl_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders").selectExpr("o_orderkey as url", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') as d")
    inventory = orders.where("url % 11 <> 0").selectExpr("url", "if(url % 9 <> 0, d, null) as lastmod")
    return inventory, orders.where("url % 13 <> 0").selectExpr("url", "if(url % 4 = 0, '1999', d) as lastmod")


@query(f"WITH {STATE} SELECT i.url, coalesce(i.lastmod = s.lastmod, false) AS reuse FROM i LEFT JOIN s ON s.url = i.url")
def j02_w01_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reusable(*crawl_state(spark, sf_dir)).select("url", "reuse")


@query(f"WITH {STATE} SELECT coalesce(i.url, s.url) AS url, CASE WHEN s.url IS NULL THEN 'added' WHEN i.url IS NULL THEN 'missing' ELSE 'modified' END AS state FROM s FULL JOIN i ON s.url = i.url WHERE s.url IS NULL OR i.url IS NULL OR i.lastmod IS DISTINCT FROM s.lastmod")
def w02_state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory, state = crawl_state(spark, sf_dir)
    return reconcile.compare(state, inventory, ["url"], "lastmod").where("state <> 'identical'").select("url", "state")


@query("""SELECT DISTINCT event_type || user_id AS check_id FROM events WHERE event_id % 2 = 0 AND NOT (user_id % 10 = 0) AND event_type || user_id NOT IN (SELECT event_type || user_id FROM events WHERE event_id % 2 = 1 AND value > 25)""")
def j06_w03_closed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "events").selectExpr("concat(event_type, user_id) as check_id", "event_id", "value", "user_id % 10 = 0 as platform_limit")
    return reconcile.closed(found.where("event_id % 2 = 0"), found.where("event_id % 2 = 1 and value > 25")).select("check_id").distinct()


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def w04_first_record_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("""SELECT user_id, arg_min(event_type, event_id) AS decided FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1""")
def w09_first_decisive_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where("event_type in ('purchase', 'error')").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("decided"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def w10_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs kept by a stream's state, one micro-batch per available file."""
    return incremental.drained(incremental.first_seen(incremental.file_stream(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type"), "append")


@query("""SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def w12_stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = incremental.file_stream(spark, sf_dir, "events")
    return incremental.drained(events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")), "complete")


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def w01_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after upserting the stream's micro-batches one by one."""
    return incremental.upserted(incremental.file_stream(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id")


@query("""WITH e AS (SELECT event_type AS source, 'user ' || user_id AS line, min(event_id) AS pos FROM events WHERE event_type IN ('error', 'signup', 'view') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS k, count(*) OVER (PARTITION BY source) AS total FROM e)
SELECT source, line, CAST(total AS BIGINT) AS total FROM r WHERE k <= 25""")
def a64_capped_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three sources, first of equals, at most 25 a source, with the true number beside them."""
    from ..operators.ranking import top

    lines = read(spark, sf_dir, "events").where("event_type in ('error', 'signup', 'view')").groupBy(F.col("event_type").alias("source"), F.concat(F.lit("user "), F.col("user_id")).alias("line")).agg(F.min("event_id").alias("pos"))
    totals = lines.groupBy("source").agg(F.count("*").alias("total"))
    return top(lines, ["source"], [F.col("pos")], 25).join(totals, "source").select("source", "line", "total")

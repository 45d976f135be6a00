"""Site diagnostics, inventories and readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import diagnostics, ranking
from .registry import query, read

BODY = "element_at(array('page page-template-full', 'single-post', 'archive category', 'home blog', 'homepage', 'single-product', 'search-results', ''), cast(page_id % 8 + 1 as int))"


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'custom-template' WHEN 1 THEN 'post' WHEN 2 THEN 'archive' WHEN 3 THEN 'blog-list' WHEN 4 THEN 'unknown' WHEN 5 THEN 'product' WHEN 6 THEN 'search' ELSE 'unknown' END AS template FROM pages""")
def f60_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", diagnostics.template(F.expr(BODY), F.lit("/x")).alias("template"))


@query("""SELECT page_id, 'strict' AS mode FROM pages WHERE starts_with(lower(html), '<!doctype html>') UNION ALL SELECT page_id, 'quirks' FROM pages WHERE NOT starts_with(lower(html), '<!doctype html>')""")
def f58_doctype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", diagnostics.doctype_mode(F.col("html")).alias("mode"))


@query("""SELECT page_id, 'Warning: x in /a/f' || page_id % 3 || '.php on line ' || page_id AS line, '/a/f' || page_id % 3 || '.php' AS file, CAST(page_id AS INTEGER) AS at FROM pages
UNION ALL SELECT page_id, 'Fatal error: y /b.php:' || page_id, '/b.php', CAST(page_id AS INTEGER) FROM pages""")
def f59_error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.expr("concat('<b>Warning</b>: x in /a/f', page_id % 3, '.php on line ', page_id, '<br />Fatal error: y /b.php:', page_id, '<br>', 'Warning: x in /a/f', page_id % 3, '.php on line ', page_id, '\n', html)")
    return diagnostics.error_lines(read(spark, sf_dir, "pages").select("page_id", shown.alias("h")), "page_id", "h")


@query("SELECT event_id, event_type IN ('error', 'view') AS is_error FROM events")
def r22_log_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("if(event_type = 'view', 'bare line', concat('2024\t', event_type, '\ttext'))")
    return read(spark, sf_dir, "events").select("event_id", diagnostics.log_error(line).alias("is_error"))


@query("""WITH i AS (SELECT p_partkey, p_size * 40 AS w, 100 + p_partkey % 7 * 150 AS h FROM part) SELECT p_partkey, CASE WHEN w < 800 AND abs(w / CAST(h AS DOUBLE) - 1.5) / 1.5 > 0.25 THEN 'narrow+ratio' WHEN w < 800 THEN 'narrow' WHEN abs(w / CAST(h AS DOUBLE) - 1.5) / 1.5 > 0.25 THEN 'ratio' END AS why FROM i""")
def r21_image_misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", diagnostics.misfit(F.col("p_size") * 40, 100 + F.col("p_partkey") % 7 * 150, F.lit(800), F.lit(1.5)).alias("why"))


@query("""SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents) WHERE token <> '' GROUP BY 1 ORDER BY n DESC, token LIMIT 30""")
def a50_token_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.frequencies(read(spark, sf_dir, "documents"), F.split("text", " "))


@query("""WITH r AS (SELECT l_orderkey AS page, l_returnflag AS box, round(l_quantity * 10 / 240) AS k, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) SELECT page, max(n) AS columns FROM r GROUP BY 1""")
def a43_column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as page", "l_returnflag as box", "l_quantity * 10 as top")
    return diagnostics.columns_of(boxes, "page", "box", "top", 240.0)


@query("""WITH p AS (SELECT c_nationkey AS site, c_custkey * 37 % 256 AS r, c_custkey * 91 % 256 AS g, c_custkey * 53 % 256 AS b, c_custkey % 9 + 1 AS share FROM customer), o AS (SELECT s_nationkey AS site, s_suppkey * 37 % 256 AS r, s_suppkey * 91 % 256 AS g, s_suppkey * 53 % 256 AS b FROM supplier)
SELECT site, round(sum(CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.site = p.site AND (o.r - p.r) * (o.r - p.r) + (o.g - p.g) * (o.g - p.g) + (o.b - p.b) * (o.b - p.b) <= 4800) THEN share ELSE 0 END) / CAST(sum(share) AS DOUBLE), 6) AS carried FROM p GROUP BY 1""")
def j27_a40_palette_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours = lambda k: [f"{k} * 37 % 256 as r", f"{k} * 91 % 256 as g", f"{k} * 53 % 256 as b"]
    reference = read(spark, sf_dir, "customer").selectExpr("c_nationkey as site", *colours("c_custkey"), "c_custkey % 9 + 1 as share")
    own = read(spark, sf_dir, "supplier").selectExpr("s_nationkey as site", *colours("s_suppkey"))
    return diagnostics.carried_share(reference, own, "site").select("site", F.round("carried", 6).alias("carried"))


STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN NULL ELSE 'available' END"


@query(f"""WITH p AS (SELECT o_custkey AS site, CASE WHEN o_orderkey % 29 = 0 THEN 'discontinued' ELSE {STATUS} END AS status, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 4 END AS hops, 3 + o_custkey % 4 AS major FROM orders),
g AS (SELECT site, count(status) AS read, count(*) FILTER (status = 'discontinued') AS gone, count(*) FILTER (status IN ('none', 'unknown')) AS blocking, max(hops) AS hops, max(major) AS major FROM p GROUP BY 1)
SELECT site, CASE WHEN major >= 6 AND gone = 0 THEN 'already_there' WHEN gone > 0 THEN 'must_replace' WHEN blocking > 0 OR coalesce(hops > 1, major < 5) OR read = 0 THEN 'work_needed' ELSE 'ready' END AS level, read, gone, blocking FROM g""")
def a36_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = read(spark, sf_dir, "orders").selectExpr("o_custkey as site", f"case when o_orderkey % 29 = 0 then 'discontinued' else {STATUS} end as status", "case when o_custkey % 3 <> 0 then o_custkey % 4 end as hops", "3 + o_custkey % 4 as major")
    return diagnostics.readiness(products, "site")


VERSION = "{0} % 5 || '.' || {0} % 13"


@query("""WITH w AS (SELECT p_partkey AS k, p_size // 10 AS a, p_size % 10 AS b FROM part), o AS (SELECT l_partkey AS k, CAST(count(*) // 10 AS INTEGER) AS a, CAST(count(*) % 10 AS INTEGER) AS b, max(l_discount) >= 0.05 AS enabled FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
SELECT w.k, w.a || '.' || w.b AS wanted, o.a || '.' || o.b AS version, CASE WHEN o.k IS NULL THEN 'missing' WHEN NOT enabled THEN 'disabled' ELSE 'older' END AS state FROM w LEFT JOIN o ON o.k = w.k WHERE o.k IS NULL OR NOT enabled OR o.a < w.a OR (o.a = w.a AND o.b < w.b)""")
def j16_extension_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every part wants, against what its kept items amount to."""
    wanted = read(spark, sf_dir, "part").selectExpr("p_partkey as k", "concat(p_size div 10, '.', p_size % 10) as version")
    kept = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"), (F.max("l_discount") >= 0.05).alias("enabled"))
    return diagnostics.compare_versions(wanted, kept.selectExpr("k", "concat(n div 10, '.', n % 10) as version", "enabled"), ["k"])


@query("""WITH g AS (SELECT o_custkey AS category, o_orderstatus AS status, count(*) AS n, min(o_orderkey) AS sample FROM orders GROUP BY 1, 2) SELECT category, status, n, sample FROM g ORDER BY n DESC, category, status LIMIT 12""")
def a55_template_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("category"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("sample"))
    return groups.orderBy(F.desc("n"), "category", "status").limit(12)


@query("""SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS refreshed, CASE WHEN count(*) FILTER (event_type = 'error') = 0 AND max(ts) FILTER (event_type = 'purchase') IS NULL THEN 'never' ELSE 'known' END AS state FROM events GROUP BY 1""")
def a54_latest_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
    per = read(spark, sf_dir, "events").groupBy("user_id").agg(latest.alias("refreshed"), F.count_if(F.col("event_type") == "error").alias("updates"))
    return per.select("user_id", "refreshed", F.when((F.col("updates") == 0) & F.col("refreshed").isNull(), "never").otherwise("known").alias("state"))


@query("""SELECT l_suppkey AS target, count(*) FILTER (l_discount >= 0.08) AS broken, count(*) FILTER (l_discount BETWEEN 0.03 AND 0.079) AS moved, count(*) AS checked FROM lineitem GROUP BY 1""")
def a61_link_check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("target")).agg(F.count_if(d >= 0.08).alias("broken"), F.count_if(d.between(0.03, 0.079)).alias("moved"), F.count("*").alias("checked"))


@query("""SELECT p_brand AS slot, CAST(sum(p_size % 4) AS BIGINT) AS wants, CAST(least(sum(p_size % 4), 100) AS BIGINT) AS gets FROM part GROUP BY 1""")
def a63_image_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wants = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("slot")).agg(F.sum(F.col("p_size") % 4).alias("wants"))
    return wants.select("slot", "wants", F.least("wants", F.lit(100)).alias("gets"))


@query("""SELECT l_orderkey AS page, l_linenumber AS box, l_quantity AS overflow, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS k FROM lineitem WHERE l_quantity > 8) WHERE k <= 5""")
def a44_overflow_culprits(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = read(spark, sf_dir, "lineitem").where("l_quantity > 8")
    top = ranking.top(wide, ["l_orderkey"], [F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")], 5)
    return top.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("box"), F.col("l_quantity").alias("overflow"), "rank")


@query("""WITH c AS (SELECT c_custkey, c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN ' Ltd.' WHEN 1 THEN ', Inc' ELSE ' House' END AS a, c_mktsegment AS s, c_custkey % 4 AS k FROM customer)
SELECT c_custkey, CASE WHEN k = 3 THEN 'skip' WHEN k = 2 THEN 'mismatch' ELSE 'match' END AS name, CASE WHEN k = 3 THEN 'skip' WHEN k = 1 THEN 'mismatch' ELSE 'match' END AS address FROM c""")
def j33_business_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "concat(c_mktsegment, element_at(array(' Ltd.', ', Inc', ' House'), cast(c_custkey % 3 + 1 as int))) as a", "case c_custkey % 4 when 3 then ' ' when 2 then 'Zzz Qqq' else c_mktsegment end as b",
        "concat(c_custkey, ' Main St.') as x", "case c_custkey % 4 when 3 then null when 1 then 'Elsewhere 9' else concat('Suite 1, ', c_custkey, ' MAIN street') end as y",
    )
    return c.select("c_custkey", text.same_business(F.col("a"), F.col("b")).alias("name"), text.same_address(F.col("x"), F.col("y")).alias("address"))


@query("""SELECT DISTINCT url FROM (SELECT split_part(url, '?', 1) AS url FROM pages UNION ALL SELECT split_part(url, '#', 1) FROM pages)""")
def u02_u04_url_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return pages.select(F.split("url", "\\?")[0].alias("url")).union(pages.select(F.split("url", "#")[0])).distinct()


@query("""WITH f AS (SELECT c_custkey AS k, c_nationkey AS check_id FROM customer WHERE c_acctbal < -900) SELECT n_nationkey AS check_id, n_regionkey IN (0, 1) AS trusted FROM nation WHERE n_nationkey NOT IN (SELECT check_id FROM f)""")
def j08_silent_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ran = read(spark, sf_dir, "nation").selectExpr("n_nationkey as check_id", "n_regionkey in (0, 1) as trusted")
    fired = read(spark, sf_dir, "customer").where("c_acctbal < -900").selectExpr("c_nationkey as check_id")
    return ran.join(fired.distinct(), "check_id", "left_anti")


@query("""SELECT o_orderstatus AS pool, count(*) AS total, min(o_totalprice) AS low, max(o_totalprice) FILTER (o_totalprice > 1000) AS high, round(sum(o_totalprice), 2) AS sum FROM orders WHERE o_totalprice > 0 GROUP BY 1""")
def a10_a12_report_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = read(spark, sf_dir, "orders").where("o_totalprice > 0")
    p = F.col("o_totalprice")
    return priced.groupBy(F.col("o_orderstatus").alias("pool")).agg(F.count("*").alias("total"), F.min(p).alias("low"), F.max(F.when(p > 1000, p)).alias("high"), F.round(F.sum(p), 2).alias("sum"))

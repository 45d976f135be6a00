"""Judgements over whole tables; the inputs are written out from business columns and judged from what is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import judgements as J
from ..sources.sitemap import robots_rules
from .registry import query, read

joined = lambda c: F.array_join(c, ",")


@query("""SELECT s_suppkey AS site, CASE WHEN s_acctbal < 0 THEN true WHEN s_acctbal < 3000 THEN s_nationkey < 12 WHEN s_acctbal < 6000 THEN false ELSE s_nationkey < 12 END AS blocked FROM supplier""")
def r02_blocked_bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr(
        r"""concat(case when s_acctbal < 0 then 'User-Agent: GPTBot\nAllow: /x\nDisallow: /products/\n' when s_acctbal < 3000 then '' when s_acctbal < 6000 then 'user-agent: gptbot # ours\nDisallow: /cart\n' else 'User-agent: gptbot-image\nDisallow: /\n' end,
        '\nUser-agent: *\n', case when s_nationkey < 12 then 'Disallow: /collections/s\n' else 'Disallow: /products/other\nDisallow:\n' end)"""
    )
    return J.blocked_from_shop(robots_rules(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), body.alias("body"))), "GPTBot")


@query("""SELECT o_orderkey, o_orderstatus = 'P' OR o_orderdate < TIMESTAMP '1998-06-01' - INTERVAL 400 DAY AS due FROM orders""")
def r12_refresh_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return read(spark, sf_dir, "orders").select("o_orderkey", J.needs_refresh(seen, F.lit("1998-06-01").cast("timestamp"), 400).alias("due"))


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN true WHEN 'HOUSEHOLD' THEN c_nationkey < 10 WHEN 'MACHINERY' THEN false ELSE false END AS supports FROM customer""")
def r14_citation_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").selectExpr("*", "concat('shark', c_custkey, '.com') as domain")
    host = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("WWW."), "domain")).when(F.col("c_mktsegment").isin("HOUSEHOLD", "MACHINERY"), "proxy.example").otherwise(F.concat(F.lit("shop."), "domain"))
    title = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.when(F.col("c_nationkey") < 10, F.concat(F.lit("Read: shop."), "domain", F.lit(" today"))).otherwise(F.concat(F.lit("gym"), "domain"))).otherwise(F.concat(F.lit("gym"), "domain"))
    return c.select("c_custkey", J.citation_supports(host, title, F.col("domain"), "proxy.example").alias("supports"))


@query("""WITH p AS (SELECT p_partkey AS k, CASE p_type WHEN 'ECONOMY' THEN 'client' WHEN 'STANDARD' THEN 'mixed' WHEN 'PROMO' THEN 'empty' ELSE 'own' END AS fill, p_size AS wants, CASE WHEN p_retailprice >= 1000 THEN 1 END AS source, p_size % 7 * 6 AS articles, CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN p_size - p_size % 7 * 6 END AS gen, p_size % 10 <> 9 AS explained FROM part)
SELECT k, array_to_string(list_filter([CASE WHEN NOT explained THEN 'no-reason' END, CASE WHEN fill IN ('client', 'mixed') AND source IS NULL THEN 'no-source' END, CASE WHEN fill = 'client' AND source IS NOT NULL AND articles < wants THEN 'too-few-articles' END,
 CASE WHEN fill = 'mixed' AND source IS NOT NULL AND coalesce(gen, 0) <> wants - articles THEN 'wrong-generate' END, CASE WHEN fill IN ('client', 'empty') AND coalesce(gen, 0) <> 0 THEN 'generates' END], lambda x: x IS NOT NULL), ',') AS problems FROM p""")
def r16_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").selectExpr(
        "p_partkey as k", "case p_type when 'ECONOMY' then 'client' when 'STANDARD' then 'mixed' when 'PROMO' then 'empty' else 'own' end as fill", "p_size as wants", "if(p_retailprice >= 1000, 1, null) as source",
        "p_size % 7 * 6 as articles", "case when p_size % 3 = 0 then 0 when p_size % 3 = 1 then p_size - p_size % 7 * 6 end as gen", "if(p_size % 10 = 9, ' ', 'fits') as why",
    )
    c = F.col
    return p.select("k", joined(J.map_problems(c("fill"), c("why"), c("wants"), c("source"), c("articles"), c("gen"))).alias("problems"))


@query("""WITH l AS (SELECT l_orderkey AS k, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 2 ELSE 0 END) AS BIGINT) AS total FROM lineitem GROUP BY 1) SELECT k, total AS count, least(total, 3) AS listed FROM l""")
def r19_risky_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file an order: a line an item, harmless, risky once, or risky twice by two lines."""
    line = F.expr(r"""case l_returnflag when 'A' then '  Options +Indexes' when 'R' then 'php_flag display_errors on\r\nRewriteRule ^a b [L,R=301]' else '# Deny from all\nX Options +Indexes' end""")
    files = read(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("line")).groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.collect_list("line"), "\n").alias("body"))
    return J.risky_flags(files, "k", "body", 3).select("k", F.col("count").cast("long").alias("count"), F.size("flags").cast("long").alias("listed"))


BANDS = """element_at(array('0', '50', '100', 'na', ' 50 ', '75', null), cast(p_size % 7 + 1 as int))"""
DUCK_BANDS = """CASE p_size % 7 WHEN 0 THEN '0' WHEN 1 THEN '50' WHEN 2 THEN '100' WHEN 3 THEN 'na' WHEN 4 THEN '50' END"""
#: Criteria that a stated band decides by itself.
BAND_CRITERIA = ["specifications", "compatibility-sizing", "safety-materials", "benefits-outcomes", "limitations-honest", "comparison-alternatives", "who-is-it-for", "troubleshooting-care", "unique-description", "about-page"]


@query(f"""WITH p AS (SELECT p_partkey AS k, {DUCK_BANDS} AS b FROM part), c AS (SELECT unnest({BAND_CRITERIA!r}) AS criterion) SELECT k, criterion, CASE WHEN b IS NULL OR b = 'na' THEN 'na' ELSE 'scored' END AS status, TRY_CAST(b AS INTEGER) AS score FROM p, c""")
def c16_c25_f68_stated_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, score = J.band_score(F.expr(BANDS))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.explode(F.array(*map(F.lit, BAND_CRITERIA))).alias("criterion"), status.alias("status"), score.alias("score"))


@query(f"""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 AND p_size % 5 >= 3 THEN 100 WHEN p_size % 2 = 0 OR p_size % 5 >= 2 THEN 50 ELSE 0 END AS own, TRY_CAST({DUCK_BANDS} AS INTEGER) AS b FROM part)
SELECT k, CASE WHEN b IS NULL THEN own WHEN (own + b) / 2.0 < 25 THEN 0 WHEN (own + b) / 2.0 < 75 THEN 50 ELSE 100 END AS score FROM p""")
def c29_answer_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five paragraphs, of which as many are of a readable length as p_size % 5 says, and a list in half of the texts."""
    cut = F.expr("concat_ws('</p>', transform(sequence(0, 4), i -> concat('<p>', if(i < p_size % 5, repeat('word ', 12), 'short one'))))")
    text = F.concat(cut, F.when(F.col("p_size") % 2 == 0, "</p><ul>").otherwise(""))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), J.formatting_score(text, F.expr(BANDS)).alias("score"))


@query("""WITH c AS (SELECT *, CAST(c_nationkey % 2 = 0 AS INTEGER) + CAST(c_nationkey % 3 = 0 AS INTEGER) + CAST(c_nationkey % 5 = 0 OR c_acctbal < 0 AS INTEGER) AS n FROM customer)
SELECT c_custkey, CASE WHEN n = 0 THEN 0 WHEN n >= 2 AND c_mktsegment <> 'BUILDING' AND c_acctbal < 5000 THEN 100 ELSE 50 END AS score FROM c""")
def c30_contact_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.expr("concat('<p>', if(c_nationkey % 2 = 0, 'Write to Info@Shop-x.example.com', 'write us'), if(c_nationkey % 3 = 0, ' or call +49 (30) 123-4567', ''), if(c_nationkey % 5 = 0, ', 12 Old Mill Road', ''), '</p>')")
    score = J.contact_score(page, F.col("c_acctbal") < 0, F.col("c_mktsegment") != "BUILDING", F.when(F.col("c_acctbal") >= 5000, True))
    return read(spark, sf_dir, "customer").select("c_custkey", score.alias("score"))


@query(f"""SELECT p_partkey AS k, CASE WHEN p_type = 'PROMO' OR p_size > 45 OR p_retailprice >= 1500 THEN 0 ELSE coalesce(TRY_CAST({DUCK_BANDS} AS INTEGER), 50) END AS score FROM part""")
def c31_policies_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    refund, shipping = F.expr("if(p_type = 'PROMO', null, if(p_retailprice >= 1500, '<p>Returns within [number of days] days</p>', '<p>Returns within 30 days</p>'))"), F.expr("if(p_size > 45, null, 'We ship (fast and far)')")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), J.policies_score(refund, shipping, F.expr(BANDS)).alias("score"))


@query(f"""SELECT p_partkey AS k, greatest(CASE WHEN p_size >= 20 THEN 100 WHEN p_size >= 2 THEN 50 ELSE 0 END, coalesce(TRY_CAST({DUCK_BANDS} AS INTEGER), 0)) AS score FROM part""")
def c32_onsite_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = F.expr("case when p_size >= 2 then cast(p_size as string) when p_size = 1 then 'many' end")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), J.reviews_score(count, F.expr(BANDS)).alias("score"))


@query("""SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'own' WHEN n_chars % 3 = 1 THEN 'data' ELSE '' END AS source FROM documents""")
def f36_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two texts stands on the page: the document's own text stands for the page."""
    own = F.concat(F.lit("qq "), F.col("doc_id").cast("string"), F.lit(" own"))
    data = F.concat(F.lit("qq "), F.col("doc_id").cast("string"), F.lit(" data"))
    page = F.lower(F.concat("text", F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit(" "), own)).when(F.col("n_chars") % 3 == 1, F.concat(F.lit(" "), data)).otherwise("")))
    return read(spark, sf_dir, "documents").select("doc_id", F.substring_index(J.description(own, data, page), " ", -1).alias("source"))


@query("""SELECT page_id, array_to_string(list_filter([CASE WHEN page_id % 2 = 0 THEN 'generator meta tag' END, CASE WHEN page_id % 3 = 0 THEN 'wp-content asset urls' END, CASE WHEN page_id % 5 = 0 THEN 'WordPress body classes' END, CASE WHEN page_id % 7 = 0 THEN 'wp-json REST api' END], lambda x: x IS NOT NULL), ',') AS signals,
 array_to_string(list_filter([CASE WHEN page_id % 4 = 0 THEN 'WPBakery' END, CASE WHEN page_id % 6 = 0 THEN 'Divi' END], lambda x: x IS NOT NULL), ',') AS made_with FROM pages""")
def f61_platform_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.expr("""concat(html, if(page_id % 2 = 0, '<META name="generator" content="WordPress 6">', ''), if(page_id % 3 = 0, '<img src="/wp-content/a.png">', ''), if(page_id % 5 = 0, '<body class="x page-id-4">', '<body class="homes">'), if(page_id % 4 = 0, '<div class="a vc_row b">', ''), if(page_id % 6 = 0, "<div class='et_pb_section'>", '<div class="et_pb_sections">'))""")
    return read(spark, sf_dir, "pages").select("page_id", joined(J.platform_signals(page, F.col("page_id") % 7 == 0)).alias("signals"), joined(J.builders(page)).alias("made_with"))


@query("""SELECT event_id, event_type NOT IN ('view', 'error') AS advice FROM events""")
def f64_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("case event_type when 'view' then 'The page was added late: additions help.' when 'error' then 'It failed\nagain' when 'click' then 'It is slow; Consider caching' when 'purchase' then 'Titles are short. You Should know' else 'Prices lack currency\nfix: none' end")
    return read(spark, sf_dir, "events").select("event_id", J.prescribes(said).alias("advice"))


@query("""WITH RECURSIVE n AS (SELECT l_orderkey AS k, count(*) AS lines FROM lineitem GROUP BY 1), s AS (SELECT k, lines AS kept FROM n UNION ALL SELECT k, greatest(1, CAST(floor(kept * 0.9) AS BIGINT)) FROM s WHERE kept > 1 AND kept * 11 - 1 > 40) SELECT k, min(kept) AS kept FROM s GROUP BY 1""")
def a11_fit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten bytes; forty bytes hold three."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.lpad(F.col("l_linenumber").cast("string"), 10, "0")).alias("lines"))
    return lines.select("k", J.fit_budget(F.col("lines"), 40).cast("long").alias("kept"))


@query("""SELECT DISTINCT event_type AS eval_id FROM events""")
def a30_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("eval_id")).distinct().orderBy("eval_id")


EXTENSIONS = """SELECT l_orderkey AS site, l_linenumber AS i, 'ext' || l_partkey AS name, CASE WHEN l_quantity < 10 THEN 'core' WHEN l_quantity < 20 THEN 'part' WHEN l_quantity < 40 THEN 'matched' ELSE 'unrecognised' END AS state, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' END AS verdict, CASE WHEN l_linestatus = 'F' THEN 'declared' END AS evidence FROM lineitem"""


def extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem_of_judgements")
    return spark.sql(EXTENSIONS.replace("FROM lineitem", "FROM lineitem_of_judgements"))


@query(f"""WITH e AS ({EXTENSIONS}) SELECT site, count(*) AS total, count(*) FILTER (state = 'core') AS core, count(*) FILTER (state = 'matched') AS matched, count(*) FILTER (state = 'unrecognised') AS unrecognised, count(*) FILTER (state = 'part') AS part, count(*) FILTER (state IN ('matched', 'unrecognised')) AS lookups FROM e GROUP BY 1""")
def a35_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.state_counts(extensions(spark, sf_dir), "site")


@query(f"""WITH e AS ({EXTENSIONS}) SELECT name, CASE WHEN state = 'matched' AND verdict = 'yes' THEN 'available' WHEN state = 'matched' AND verdict = 'no' THEN 'none' ELSE 'unknown' END AS status, CASE WHEN state <> 'matched' THEN 'unlisted' WHEN evidence = 'declared' THEN 'vendor' ELSE 'registry' END AS source FROM e WHERE state IN ('matched', 'unrecognised')""")
def a37_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.profile(extensions(spark, sf_dir))


@query("""SELECT l_orderkey AS k, l_linenumber AS i, l_partkey AS p, array_to_string(list_filter([CASE WHEN l_quantity - 20 > 8 THEN 'overflow-x' END, CASE WHEN l_discount > 0.05 THEN 'nav-overlap' END, CASE WHEN l_returnflag = 'A' THEN 'text-clip' END, CASE WHEN l_tax > 0.04 THEN 'asset-404' END], lambda x: x IS NOT NULL), ',') AS visual,
 array_to_string(list_filter([CASE WHEN l_quantity - 20 > 8 THEN 'page-width' END, CASE WHEN l_quantity + 50 >= 97 THEN 'content-measure' END, CASE WHEN l_quantity * 50 < 500 THEN 'page-height' END, CASE WHEN l_discount > 0.05 THEN 'section-overlap' END, CASE WHEN l_linestatus = 'F' AND abs(l_quantity * 50 - 1000) / 1000 > 0.25 THEN 'height-drift' END, CASE WHEN l_linestatus = 'F' AND l_linenumber <> 3 THEN 'section-drift' END], lambda x: x IS NOT NULL), ',') AS layout FROM lineitem""")
def a41_page_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.expr("""named_struct('overflow_x', l_quantity - 20, 'nav_overlaps', if(l_discount > 0.05, 2, 0), 'edge_bleeds', 0, 'text_clips', if(l_returnflag = 'A', 1, 0), 'broken_images', 0, 'asset_errors', if(l_tax > 0.04, 1, 0), 'script_errors', 0,
     'overflow', l_quantity - 20, 'measure', l_quantity + 50, 'height', l_quantity * 50, 'overlaps', if(l_discount > 0.05, 1, 0), 'escapes', 0, 'collapsed', 0, 'sections', l_linenumber)""")
    base = F.expr("if(l_linestatus = 'F', named_struct('height', 1000, 'sections', 3), null)")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"), joined(J.visual_problems(m)).alias("visual"), joined(J.layout_problems(m, base)).alias("layout"))


@query("""WITH o AS (SELECT p_partkey AS path, p_type AS type, CAST(v AS VARCHAR) AS viewport, CASE WHEN v = 'desktop' THEN 1 + p_size % 4 ELSE 1 + p_size % 3 END AS cols FROM part, (SELECT unnest(['desktop', 'mobile']) AS v)),
t AS (SELECT * FROM (VALUES ('ECONOMY', 3, 1), ('STANDARD', 2, 2), ('PROMO', 4, 2)) x(type, wide, narrow)), j AS (SELECT o.*, wide, narrow, max(CASE WHEN viewport = 'desktop' THEN cols END) OVER (PARTITION BY path) AS own_wide FROM o LEFT JOIN t ON t.type = o.type)
SELECT path, type, viewport, 'info' AS level, 'not in reference' AS what FROM j WHERE wide IS NULL
UNION ALL SELECT path, type, viewport, CASE WHEN narrow <= 1 OR narrow < wide THEN 'FAIL' ELSE 'warn' END, CASE WHEN narrow <= 1 OR narrow < wide THEN 'keeps its columns' ELSE 'folds' END FROM j WHERE viewport = 'mobile' AND wide IS NOT NULL AND (narrow <= 1 OR narrow < wide) <> (cols <= 1 OR cols < own_wide)""")
def a42_j26_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", F.explode(F.array(F.lit("desktop"), F.lit("mobile"))).alias("viewport")).selectExpr("p_partkey as path", "p_type as type", "viewport", "if(viewport = 'desktop', 1 + p_size % 4, 1 + p_size % 3) as cols", "true as visible", "false as overflow", "16 as heading")
    rows = [(t, v, c, True, False, h) for t, wide, narrow in (("ECONOMY", 3, 1), ("STANDARD", 2, 2), ("PROMO", 4, 2)) for v, c, h in (("desktop", wide, 16), ("mobile", narrow, 14))]
    return J.fold_findings(own, spark.createDataFrame(rows, "type string, viewport string, cols int, visible boolean, overflow boolean, heading int"))


@query("""SELECT source AS level, lang AS what, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2""")
def a42_last_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").selectExpr("source as level", "lang as what", "doc_id")
    return J.last_of_each(rows, ["level", "what"], "doc_id")


@query("""SELECT o_custkey AS menu, count(*) FILTER (o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n FROM orders GROUP BY 1 HAVING n >= 2""")
def a51_legal_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "orders").selectExpr("o_custkey as menu", "case o_orderpriority when '1-URGENT' then 'Our Privacy policy' when '2-HIGH' then 'LICENCE' else 'Products' end as title", "o_orderstatus <> 'P' as published")
    return J.legal_menus(items)


@query("""SELECT l_orderkey AS k, l_linenumber AS i, l_partkey AS p, CASE WHEN l_quantity >= 40 THEN CASE WHEN l_discount > 0.05 THEN 'route-missing' ELSE 'content-missing' END END AS diagnosis FROM lineitem""")
def a51_route_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, plain = F.expr("if(l_quantity >= 40, 404, 200)"), F.expr("if(l_discount > 0.05, 200, if(l_discount > 0.02, 404, null))")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"), J.route_diagnosis(status, plain).alias("diagnosis"))


@query("""SELECT CASE WHEN p_size < 20 THEN p_type ELSE p_type || '/' || p_brand END AS namespace, count(*) AS n FROM part GROUP BY 1""")
def a52_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    asset = F.expr("concat_ws('/', p_type, p_brand, if(p_size < 20, null, 'a.css'))")
    asset = F.when(F.col("p_size") < 20, F.concat_ws("/", "p_type", F.lit("x.css"))).otherwise(asset)
    return read(spark, sf_dir, "part").groupBy(J.namespace(asset).alias("namespace")).agg(F.count("*").alias("n"))


CHECKS = "WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1), s AS (SELECT c_custkey AS engine, CASE WHEN t IS NULL THEN 'missing' WHEN t = 'view' THEN 'ok' WHEN t = 'error' THEN 'unreachable' WHEN t = 'click' THEN 'inconclusive' ELSE 'rejected' END AS state, CASE c_mktsegment WHEN 'BUILDING' THEN 'skip' WHEN 'HOUSEHOLD' THEN 'include' END AS decision FROM customer LEFT JOIN last ON user_id = c_custkey)"


@query(f"{CHECKS} SELECT engine, state, decision, CASE WHEN state = 'ok' THEN 'none' WHEN state IN ('unreachable', 'inconclusive') THEN 'retry' ELSE 'decide' END AS gap, CASE WHEN decision = 'skip' THEN 'skipped' WHEN state = 'ok' THEN 'declared' ELSE 'blocked' END AS place FROM s")
def a60_j15_engine_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").selectExpr("c_custkey as engine", "c_custkey as key", "case c_mktsegment when 'BUILDING' then 'skip' when 'HOUSEHOLD' then 'include' end as decision")
    checks = read(spark, sf_dir, "events").selectExpr("user_id as key", "case event_type when 'view' then 'ok' when 'error' then 'unreachable' when 'click' then 'inconclusive' else 'rejected' end as state", "event_id as pos")
    states = J.engine_statuses(c.select("engine", "key"), checks).select("engine", "state").join(c.select("engine", "decision"), "engine")
    return J.engine_plan(states).select("engine", "state", "decision", "gap", "place")


@query(r"""WITH e AS (SELECT url, min(page_id) AS pos FROM pages GROUP BY 1 ORDER BY pos LIMIT 2000), t AS (SELECT url, min(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))) AS title FROM pages WHERE length(html) > 3000 GROUP BY 1) SELECT e.url, pos, nullif(title, '') AS title FROM e LEFT JOIN t ON t.url = e.url""")
def j07_k03_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.html import title

    pages = read(spark, sf_dir, "pages")
    fetched = pages.where(F.length("html") > 3000).select("url", title(F.col("html")).alias("title"))
    return J.with_titles(pages.groupBy("url").agg(F.min("page_id").alias("pos")), fetched)


@query("""SELECT c_custkey AS menu_id, o_orderkey AS article_id, o_orderstatus AS state FROM customer JOIN orders ON o_orderkey = c_custkey * 3 WHERE c_mktsegment <> 'BUILDING'""")
def j17_menu_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    menus = read(spark, sf_dir, "customer").selectExpr("c_custkey as menu_id", "if(c_mktsegment = 'BUILDING', '#', concat('index.php?option=com_content&view=article&id=', c_custkey * 3, '&layout=x')) as link")
    return J.menu_articles(menus, read(spark, sf_dir, "orders").selectExpr("o_orderkey as article_id", "o_orderstatus as state")).select("menu_id", "article_id", "state")


@query("""WITH a AS (SELECT l_orderkey AS site, l_linenumber + l_partkey * 10 AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber + l_partkey * 10) - 1 AS at, 'p' || l_partkey AS theirs FROM lineitem WHERE l_returnflag <> 'A'), b AS (SELECT l_orderkey AS site, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber + l_partkey * 10) - 1 AS at, 'p' || l_partkey AS own FROM lineitem WHERE l_returnflag = 'A')
SELECT coalesce(a.site, b.site) AS site, CAST(coalesce(a.at, b.at) AS INTEGER) AS at, theirs, own FROM a FULL JOIN b ON a.site = b.site AND a.at = b.at""")
def j23_page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    listed = lambda where: items.where(where).groupBy(F.col("l_orderkey").alias("site")).agg(F.transform(F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") + F.col("l_partkey") * 10).alias("o"), F.concat(F.lit("p"), "l_partkey").alias("p")))), lambda x: x["p"]).alias("paths"))
    return J.page_pairs(listed("l_returnflag <> 'A'"), listed("l_returnflag = 'A'"))


@query("""WITH b AS (SELECT l_orderkey AS k, list_distinct(list(CAST(10 * (l_linenumber % 5 + 6) AS INTEGER))) AS theirs, list_distinct(list(CAST(10 * (CAST(l_quantity AS INTEGER) % 5 + 6) AS INTEGER))) AS own FROM lineitem GROUP BY 1)
SELECT k, CASE WHEN len(list_filter(theirs, lambda x: x < 95)) > 0 AND len(list_filter(theirs, lambda x: x < 95 AND list_contains(own, x))) = 0 THEN 'FAIL' WHEN len(list_filter(theirs, lambda x: NOT list_contains(own, x))) > 0 THEN 'warn' END AS level FROM b""")
def j28_band_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set((F.col("l_linenumber") % 5 + 6) * 10).alias("theirs"), F.collect_set((F.col("l_quantity").cast("int") % 5 + 6) * 10).alias("own"))
    return bands.select("k", J.band_losses(F.col("theirs"), F.col("own")).alias("level"))


@query("""SELECT DISTINCT l_orderkey AS skill, 's' || l_suppkey || '.' AS needs FROM lineitem WHERE l_returnflag <> 'A' AND l_orderkey || ':' || l_suppkey NOT IN (SELECT l_orderkey || ':' || l_suppkey FROM lineitem WHERE l_returnflag = 'A')""")
def j32_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as skill", "concat('s', l_suppkey, '.') as needs", "l_returnflag")
    texts = items.groupBy("skill").agg(F.concat(F.lit(" "), F.array_join(F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("needs"))), " ")).alias("body"))
    spaced = items.select("skill", F.concat(F.lit(" "), "needs").alias("needs")).distinct()
    return J.undeclared(spaced, texts).select("skill", F.trim("needs").alias("needs"))


@query("""WITH b AS (SELECT o_custkey AS page, o_orderkey AS pos, 'el' || o_orderkey AS element, '/img/' || o_orderpriority AS needle FROM orders), f AS (SELECT DISTINCT o_custkey AS page, 'https://cdn.example/x/img/' || o_orderpriority AS url FROM orders WHERE o_orderstatus <> 'P')
SELECT f.page, f.url, arg_min(element, pos) AS element FROM f JOIN b ON b.page = f.page AND ends_with(f.url, needle) GROUP BY 1, 2""")
def j34_background_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    backgrounds = orders.selectExpr("o_custkey as page", "o_orderkey as pos", "concat('el', o_orderkey) as element", "concat('http://own.example/img/', o_orderpriority) as url").union(orders.selectExpr("o_custkey", "-1L", "'none'", "'https://own.example'"))
    failures = orders.where("o_orderstatus <> 'P'").selectExpr("o_custkey as page", "concat('https://cdn.example/x/img/', o_orderpriority) as url").distinct()
    return J.first_owner(failures, backgrounds)


@query("""SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS train FROM documents""")
def j35_train_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.split_members(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@query("""WITH r AS (SELECT l_partkey AS id, count(*) FILTER (l_returnflag = 'A') AS errors FROM lineitem WHERE l_quantity > 25 GROUP BY 1) SELECT p_partkey AS id, p_name AS name, CASE WHEN r.id IS NULL THEN 'skipped' WHEN errors > 0 THEN 'drifted' ELSE 'clean' END AS state FROM part LEFT JOIN r ON r.id = p_partkey WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""")
def j37_schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    results = items.where("l_quantity > 25").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("l_orderkey"))).alias("errors"))
    return J.schema_checks(read(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_name as name"), items.selectExpr("l_partkey as id"), results)


DIFFERENCES = "SELECT p_partkey AS k, p_brand AS element, CASE p_type WHEN 'ECONOMY' THEN 'module' WHEN 'STANDARD' THEN 'plugin' WHEN 'PROMO' THEN 'component' ELSE 'library' END AS type, CASE WHEN p_type = 'STANDARD' THEN 'system' END AS folder, CASE WHEN p_size < 15 THEN 'disabled' WHEN p_size < 30 THEN 'missing' ELSE 'older' END AS state FROM part"


@query(f"""WITH d AS ({DIFFERENCES}), h AS (SELECT *, CASE type WHEN 'module' THEN 'modules/' || element WHEN 'plugin' THEN 'plugins/system/' || element WHEN 'component' THEN 'administrator/components/' || element END AS home FROM d)
SELECT k, home, CASE state WHEN 'disabled' THEN 'enable' WHEN 'missing' THEN 'install' ELSE 'upgrade' END AS action FROM h WHERE element <> 'Brand#3' AND (state = 'disabled' OR home IS NOT NULL)""")
def j39_f73_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "part").createOrReplaceTempView("part_of_judgements")
    return J.wanted_actions(spark.sql(DIFFERENCES.replace("FROM part", "FROM part_of_judgements")), [], ["Brand#3"]).select("k", "home", "action")


@query("""SELECT l_orderkey AS k, l_linenumber AS i, l_partkey AS p, 't' || l_partkey AS table_name, CASE WHEN l_returnflag <> 'A' AND l_linestatus = 'F' THEN 'c' || l_suppkey END AS column_name FROM lineitem""")
def f71_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("case l_returnflag when 'A' then 'ADD_INDEX' when 'R' then 'ADD_COLUMN' else 'DROP_COLUMN' end")
    elements = F.expr("if(l_linestatus = 'F', array(concat('t', l_partkey), concat('c', l_suppkey)), array(concat('t', l_partkey)))")
    table, column = J.schema_drift(kind, elements)
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"), table.alias("table_name"), column.alias("column_name"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part) SELECT k, CASE WHEN s > 45 THEN 'frontmatter_missing' ELSE array_to_string(list_filter([CASE WHEN s % 2 = 0 AND s % 4 <> 0 THEN 'requires_mcp_undeclared' END, CASE WHEN s % 3 = 0 THEN 'proven_on_missing' END, CASE WHEN s % 5 = 0 THEN 'version_invalid' END, CASE WHEN s % 7 IN (1, 2) THEN 'platforms_contradict_record' END], lambda x: x IS NOT NULL), ',') END AS problems FROM p""")
def r04_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.expr(
        r"""concat(if(p_size > 45, '', '---\n'), 'name: x\n', if(p_size % 4 = 0, 'requires-mcp: [a]\n', ''), if(p_size % 3 = 0, 'provenOn:  \n', 'provenOn: here\n'), if(p_size % 5 = 0, 'version: 1.2\n', 'version: 1.20.3\n'),
        case p_size % 7 when 1 then 'platforms: any\n' when 2 then 'platforms: Web, ios\n' when 3 then 'platforms: WEB\n' else '' end, if(p_size > 45, '', '---\n'), if(p_size % 2 = 0, 'call mcp__a__b', 'text'))"""
    )
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), joined(J.front_matter_problems(source, F.array(F.lit("web")), ["web", "desktop"])).alias("problems"))


@query("""SELECT p_partkey AS k, CAST((p_size > 10)::INTEGER + (p_size > 20)::INTEGER + (p_size > 30)::INTEGER AS INTEGER) AS n FROM part""")
def r05_private_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.expr("concat('see host.inner.docs and /opt/inner.docs/x, innerxdocs/y', if(p_size > 10, ' then inner.docs/guide.md', ''), if(p_size > 20, ' and Acme/inner.docs.', ''), if(p_size > 30, ' https://github.com/acme/inner.docs', ''))")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), J.private_references(F.replace(source, F.lit("docs."), F.lit("docs ")), ["inner.docs"]).alias("n"))


@query("""SELECT page_id, array_to_string(list_filter([CASE WHEN page_id % 3 = 0 THEN 'status' END, CASE WHEN page_id % 2 = 1 THEN 'missing:marker' END, CASE WHEN page_id % 5 = 0 THEN 'forbidden:Lorem' END, CASE WHEN page_id % 7 = 0 THEN 'denied:demo' END], lambda x: x IS NOT NULL), ',') AS problems FROM pages""")
def r17_r18_page_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("concat('<p>our Demo day democratic', if(page_id % 2 = 0, ' marker', ''), if(page_id % 5 = 0, ' Lorem', ''), if(page_id % 7 = 0, ' a demo site', ''))")
    return read(spark, sf_dir, "pages").select("page_id", joined(J.page_problems(F.expr("if(page_id % 3 = 0, 500, 200)"), body, ["marker"], ["Lorem"], ["demo"], ["Demo day"])).alias("problems"))


@query("""WITH i AS (SELECT o_custkey AS site, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_custkey) AS n, o_totalprice AS p, o_orderstatus AS s FROM orders)
SELECT site, 'h' || k AS handle, CASE WHEN s = 'P' THEN '' ELSE printf('%.2f', p) END AS low, CASE WHEN s = 'P' THEN '' ELSE printf('%.2f', p * 2) END AS high FROM i WHERE r < 7""")
def s09_catalog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of three items a site; a price that is no number does not count; seven items at most."""
    item = F.expr("named_struct('id', o_orderkey, 'handle', concat('h', o_orderkey), 'variants', if(o_orderstatus = 'P', array(named_struct('price', 'ask')), array(named_struct('price', cast(o_totalprice as string)), named_struct('price', cast(o_totalprice * 2 as string)), named_struct('price', 'NaN'))))")
    listed = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("site")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("i")))), lambda x: x["i"]).alias("all"))
    paged = listed.select("site", F.explode(F.sequence(F.lit(0), F.floor(F.size("all") / 3).cast("int"))).alias("page"), "all").select("site", "page", F.to_json(F.struct(F.slice("all", F.col("page") * 3 + 1, F.lit(3)).alias("items"))).alias("body"))
    broken = listed.select("site", F.lit(1000), F.lit("<html>"))
    return J.catalog_items(paged.union(broken), 3, 7)


@query("""SELECT DISTINCT 'images/' || p_name || '.png' AS path FROM part UNION SELECT DISTINCT 'b/' || p_type FROM part WHERE p_size > 25""")
def s30_image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.expr("""to_json(named_struct('image_intro', concat(' /images/', p_name, '.png#joomlaImage://x'), 'image_fulltext', if(p_size > 25, concat('b/', p_type), ' ')))""")
    return J.image_paths(read(spark, sf_dir, "part").select(held.alias("images")), "images", ["image_intro", "image_fulltext"])


@query("""SELECT p_type AS factor, p_brand AS grp, p_partkey AS key, CASE WHEN p_size > 25 THEN 'scored' ELSE 'na' END AS status, CASE WHEN p_size > 25 THEN p_size END AS score, CASE WHEN p_size <= 10 THEN 'no data' WHEN p_size <= 25 THEN 'not measured (na)' END AS reason FROM part""")
def k06_wire_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    criterion = F.expr("named_struct('key', p_partkey, 'status', if(p_size > 25, 'scored', 'na'), 'score', p_size, 'reason', if(p_size <= 10, 'no data', null))")
    groups = read(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.collect_list(criterion).alias("criteria"))
    report = groups.groupBy("p_type").agg(F.collect_list(F.struct(F.col("p_brand").alias("name"), "criteria")).alias("groups"))
    return J.wire_rows(report.agg(F.collect_list(F.struct(F.col("p_type").alias("key"), "groups")).alias("factors")))


@query("""WITH RECURSIVE e AS (SELECT p_partkey // 4 AS s, p_partkey AS t FROM part WHERE p_partkey > 0), b AS (SELECT p_partkey AS k FROM part WHERE p_size = 7 AND p_partkey > 0), w AS (SELECT CAST(0 AS BIGINT) AS k, 0 AS depth UNION ALL SELECT t, depth + 1 FROM w JOIN e ON s = w.k WHERE depth < 3 AND w.k NOT IN (SELECT k FROM b))
SELECT 'p' || k AS url, depth, k NOT IN (SELECT k FROM b) AS allowed FROM w ORDER BY depth, k LIMIT 40""")
def a08_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    edges = parts.where("p_partkey > 0").selectExpr("concat('p', p_partkey div 4) as source", "concat('p', p_partkey) as target", "p_partkey % 4 as at")
    blocked = parts.where("p_size = 7 and p_partkey > 0").selectExpr("concat('p', p_partkey) as url")
    return J.frontier(parts.selectExpr("concat('p', p_partkey) as url"), edges, "p0", blocked, 3, 40)


@query("""SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events) WHERE rank <= 3""")
def t03_top_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import top

    return top(read(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id", "rank")


@query("""SELECT doc_id, array_to_string(list_filter(['desktop', 'laptop', 'tablet', 'mobile'], lambda v: (v IN ('desktop', 'mobile') AND n_chars % 2 = 0) OR (v IN ('tablet', 'desktop') AND n_chars % 3 = 0) OR (v = 'laptop' AND n_chars % 5 = 0)), ',') AS viewports FROM documents""")
def u06_viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of what several tiers look at, in canonical order."""
    wanted = F.expr("flatten(array(if(n_chars % 2 = 0, array('mobile', 'desktop'), array()), if(n_chars % 3 = 0, array('tablet', 'desktop'), array()), if(n_chars % 5 = 0, array('laptop'), array())))")
    order = F.array(*map(F.lit, ["desktop", "laptop", "tablet", "mobile"]))
    return read(spark, sf_dir, "documents").select("doc_id", wanted.alias("w")).select("doc_id", joined(F.filter(order, lambda v: F.array_contains("w", v))).alias("viewports"))

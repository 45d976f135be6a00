"""Files, sinks and text functions over whole tables; what is read was written out before, in the formats that users have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..operators import findings, layout, publish, records, scoring
from ..operators.findings import Check
from ..sources import files, sitemap
from ..sources.stored import fresh
from .facts import P, shop
from .registry import query, read, spread


@query("""SELECT 'n' || s_nationkey AS namespace, 's' || s_suppkey AS slug, '{"name":"' || s_name || '"}' AS text FROM supplier""")
def s01_s16_s28_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a record, in a folder a namespace; found by walking the tree."""
    folder = fresh(spark, "records")
    rows = spread(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name"), "s_suppkey")
    files.write_files(rows.selectExpr("concat('n', s_nationkey, '/s', s_suppkey, '.txt') as name", """cast(coalesce(concat('{"name":"', s_name, '"}'), '') as binary) as content"""), folder)
    found = files.documents(spark, folder, "*.txt")
    slug = F.regexp_replace(files.path_part(F.col("path"), 1), "\\.txt$", "")
    return found.select(files.path_part(F.col("path"), 2).alias("namespace"), slug.alias("slug"), F.regexp_replace("text", "\\s+$", "").alias("text"))


@query("""SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'missing' WHEN c_mktsegment = 'BUILDING' THEN 'malformed' ELSE 'ok' END AS state, CASE WHEN c_acctbal >= 0 AND c_mktsegment <> 'BUILDING' THEN c_name END AS name FROM customer""")
def s02_missing_and_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumn("path", F.concat(F.lit("r/"), F.col("c_custkey").cast("string")))
    body = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit('{"name": '), "c_name")).otherwise(F.to_json(F.struct(F.col("c_name").alias("name"))))
    found = files.parsed(c.where("c_acctbal >= 0").select("path", body.alias("text")), "name string")
    return files.with_missing(c.select("path", F.col("c_custkey").alias("k")), found).select("k", "state", F.col("record.name").alias("name"))


@query("""WITH c AS (SELECT o_custkey AS site, ascii(o_orderpriority) - 48 AS priority, o_orderkey AS pos, 'u' || o_orderkey % 3 AS loc, o_orderstatus AS lastmod FROM orders), b AS (SELECT site, min(priority) AS priority FROM c GROUP BY 1)
SELECT site, loc, arg_min(lastmod, pos) AS lastmod, min(pos) AS pos FROM c JOIN b USING (site, priority) GROUP BY 1, 2""")
def s07_first_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr("o_custkey as site", "ascii(o_orderpriority) - 48 as priority", "o_orderkey as pos", "concat('u', o_orderkey % 3) as loc", "o_orderstatus as lastmod")
    return sitemap.first_sitemap(rows)


@query("""SELECT s_suppkey AS site, unnest(['a', 'b', '*']) AS agent, unnest([CASE WHEN s_acctbal > 0 THEN 'disallow' END, CASE WHEN s_acctbal > 0 THEN 'disallow' END, 'allow']) AS kind, unnest([CASE WHEN s_acctbal > 0 THEN '/x' END, CASE WHEN s_acctbal > 0 THEN '/x' END, '/y: z']) AS path FROM supplier""")
def s08_robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr(r"concat('# top\nUser-Agent: A\nuser-agent: b # two\n', if(s_acctbal > 0, 'Disallow: /x\n', 'Disallow:\n'), 'Crawl-delay: 3\n\nUser-agent: *\nAllow: /y: z\n')")
    return sitemap.robots_rules(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), body.alias("body")))


@query("""SELECT 'u' || user_id AS slug, arg_max(value, event_id) AS value FROM events GROUP BY 1""")
def s14_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed lines of JSON, one record of a key after the other; the last counts."""
    folder = fresh(spark, "catalog")
    lines = read(spark, sf_dir, "events").select(F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("slug"), "value", F.col("event_id").alias("at"))).alias("value"))
    lines.union(spark.createDataFrame([("not json",), ("{}",)], "value string")).write.option("compression", "gzip").text(folder)
    held = spark.read.text(folder).withColumn("pos", F.get_json_object("value", "$.at").cast("long"))
    return files.catalog(held, "slug string, value double").select("slug", "record.value")


@query("""SELECT 'e' || o_custkey AS eval_id, o_orderstatus AS config, 'r' || o_orderkey AS run, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS pass_rate, CASE WHEN o_orderpriority = '5-LOW' THEN 7.5 ELSE 3.0 END AS seconds, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS tool_calls FROM orders WHERE o_orderpriority <> '1-URGENT'""")
def s17_evaluation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.expr("concat('file:/runs/e', o_custkey, '/', o_orderstatus, '/r', o_orderkey)")
    body = F.expr(
        """case when o_orderpriority = '1-URGENT' then '{broken' else concat('{"summary":{', if(o_orderstatus = 'P', '', concat('"pass_rate":', o_totalprice)), '},"timing":{"total_duration_seconds":', if(o_orderpriority = '5-LOW', '0', '3'), '}', if(o_orderstatus = 'F', ',"execution_metrics":{"total_tool_calls":2}', ''), '}') end"""
    )
    o = read(spark, sf_dir, "orders").select(F.concat(folder, F.lit("/grading.json")).alias("path"), body.alias("text"), F.concat(folder, F.lit("/timing.json")).alias("clock"))
    return files.evaluation_runs(o.select("path", "text"), o.select(F.col("clock").alias("path"), F.lit('{"total_duration_seconds": 7.5}').alias("text")))


@query("""SELECT s_suppkey AS k, s_name AS host, CAST(NULL AS VARCHAR) AS nothing FROM supplier""")
def s22_config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("<?php class C {\n  public $hosted = 'no';\n  public $host  = '"), "s_name", F.lit("';\n  public $empty = '';\n}"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), files.config_value(body, "host").alias("host"), files.config_value(body, "empty").alias("nothing"))


@query("""SELECT event_id, value FROM events WHERE event_type IN ('view', 'click')""")
def s27_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server-sent lines, plain JSON lines, comments and broken lines."""
    event = F.to_json(F.struct("event_id", "value"))
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("data: "), event)).when(F.col("event_type") == "click", event).when(F.col("event_type") == "error", F.concat(F.lit("data: "), F.substring(event, 1, 8))).otherwise(": ping")
    return files.event_lines(read(spark, sf_dir, "events").select(line.alias("value")), "event_id long, value double").select("event.event_id", "event.value")


@query(f"""WITH {P} SELECT k, CASE WHEN stub THEN '' ELSE name || CASE WHEN named THEN ' | ACME-Shop' ELSE '' END END AS title, CASE WHEN stub THEN 'https://elsewhere.example/' || k END AS canonical, CASE WHEN stub THEN '' ELSE name END AS first, CASE WHEN NOT stub AND one_heading THEN 'Details' ELSE '' END AS second,
 CASE WHEN stub THEN 1 ELSE len(string_split(name, ' ')) + 1 + 1 + s + 5 END AS words FROM p""")
def f01_f02_page_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = html.page_facts(shop(spark, sf_dir))
    listed = lambda n: F.array_join(html.headings(F.col("html"), n), "|")
    return facts.select("k", "title", "canonical", listed(1).alias("first"), listed(2).alias("second"), F.col("word_count").cast("long").alias("words"))


@query("""SELECT p_partkey AS k, p_size % 5 = 0 AS safe FROM part""")
def f17_safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("element_at(array('skills/x/SKILL.md', '/etc/passwd', 'a/../../b', 'C:/x', 'a\\\\\\\\b'), cast(p_size % 5 + 1 as int))")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), urls.is_safe_path(path).alias("safe"))


@query("""SELECT p_partkey AS k, CASE WHEN p_size > 5 THEN p_name END AS name, CASE WHEN p_size > 5 AND p_size % 2 = 0 THEN 'says: ' || p_type END AS description FROM part""")
def f19_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.expr("""concat(if(p_size > 5, '---\n', ''), 'name: "', p_name, '"\n', if(p_size % 2 = 0, concat('description: says: ', p_type, '\n'), ''), '---\nbody: x\n')""")
    held = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), files.front_matter(source).alias("m"))
    return held.select("k", F.try_element_at("m", F.lit("name")).alias("name"), F.try_element_at("m", F.lit("description")).alias("description"))


@query("""SELECT p_partkey AS k, p_name || ' & ' || p_brand || ' end' AS stripped, p_name || ' & ' || p_brand || ' <b> end.' AS plain FROM part""")
def f20_f21_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.expr("concat('<p class=\"x\">', p_name, '&nbsp;&amp;', '<script>var a = 1;</script> ', p_brand, '<style>p {}</style>&copy;<br>end</p>')")
    b = F.expr("concat('<p>', p_name, '&nbsp;&amp; ', p_brand, '<script>var a = 1;</script> &lt; b&gt; &lt;i&gt;end&lt;/i&gt; .</p>')")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text.strip_tags(a).alias("stripped"), F.replace(text.html_text(b), F.lit("< b>"), F.lit("<b>")).alias("plain"))


@query("""SELECT c_custkey AS k, lower(c_mktsegment) AS name, c_custkey || ' old street suite ' || c_nationkey AS address FROM customer""")
def f39_business_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    name = F.expr("concat(c_mktsegment, element_at(array(' Ltd.', ', Inc', ' GmbH & Co'), cast(c_custkey % 3 + 1 as int)))")
    address = F.expr("concat(c_custkey, ' Old St., Ste ', c_nationkey)")
    return c.select(F.col("c_custkey").alias("k"), text.business_name(name).alias("name"), F.array_join(text.address_tokens(address), " ").alias("address"))


@query("""SELECT event_id, event_type NOT IN ('view', 'error') AS money FROM events""")
def f43_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("case event_type when 'view' then 'costs 5 coins, EURO 2024' when 'error' then 'USD and more' when 'click' then 'only €5' when 'purchase' then '20 USD a month' else 'about 3 ¥' end")
    return read(spark, sf_dir, "events").select("event_id", text.states_money(said).alias("money"))


@query("""SELECT s_suppkey AS k, 'abc商' || s_nationkey AS key, 'abc' || s_nationkey AS squashed FROM supplier""")
def f44_f47_merge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("A B・C の商ー"), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "公式店").otherwise("本店"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), text.merge_key(name).alias("key"), text.squash(name).alias("squashed"))


@query("""SELECT doc_id, CAST(round((n_chars % 256) / 32.0) * 32 AS INTEGER) AS level, (n_chars % 256 - 128) * (n_chars % 256 - 128) * 3 <= 4800 AS near FROM documents""")
def f52_f53_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("n_chars") % 256
    return read(spark, sf_dir, "documents").select("doc_id", layout.quantise(c).alias("level"), (layout.colour_distance([c, c, c], [F.lit(128)] * 3) <= 3 * 40 * 40).alias("near"))


@query("""WITH h AS (SELECT 'cheap' AS id, 2 AS p, 0 AS o, o_orderkey AS k FROM orders WHERE o_totalprice < 50000 UNION ALL SELECT 'old', 1, 1, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' UNION ALL SELECT 'open-urgent', 1, 2, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' UNION ALL SELECT 'never', 1, 3, o_orderkey FROM orders WHERE o_totalprice < 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM h), f AS (SELECT id, p, o, count(*) AS count, string_agg(CASE WHEN n <= 20 THEN CAST(k AS VARCHAR) END, ',' ORDER BY k) AS samples FROM r GROUP BY 1, 2, 3)
SELECT id AS check_id, CAST(p AS INTEGER) AS priority, count, samples, row_number() OVER (ORDER BY p, count DESC, o) AS place FROM f""")
def a02_a06_u01_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks over orders: the union of what they find, counted, with the first twenty samples, in order of weight."""
    c = F.col
    checks = [Check("cheap", "", 2, c("o_totalprice") < 50000), Check("old", "", 1, c("o_orderdate") < F.lit("1996-01-01").cast("timestamp")), Check("open-urgent", "", 1, c("o_orderpriority") == "1-URGENT", c("o_orderstatus") == "O"), Check("never", "", 1, c("o_totalprice") < 0)]
    found = findings.findings(read(spark, sf_dir, "orders"), checks, "o_orderkey", "o_orderkey")
    rows = found.select("check_id", "priority", "count", F.array_join(F.transform("subjects", lambda x: x.cast("string")), ",").alias("samples"), "check_ordinal")
    placed = F.array_sort(F.collect_list(F.struct("priority", (-F.col("count")).alias("less"), "check_ordinal", "check_id", "count", "samples")))  # a row a check
    return rows.agg(placed.alias("r")).select(F.posexplode("r").alias("at", "r")).select("r.check_id", "r.priority", "r.count", "r.samples", (F.col("at") + 1).cast("long").alias("place"))


@query("""WITH d AS (SELECT DISTINCT l_returnflag || l_linestatus AS key FROM lineitem), a AS (SELECT l_suppkey AS audit, l_returnflag || l_linestatus AS key, max(l_quantity) AS score FROM lineitem WHERE l_discount >= 0.1 GROUP BY 1, 2)
SELECT u.audit, d.key, CASE WHEN a.key IS NULL THEN 'inactive' ELSE 'scored' END AS status, score FROM (SELECT DISTINCT audit FROM a) u CROSS JOIN d LEFT JOIN a ON a.audit = u.audit AND a.key = d.key""")
def j09_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").withColumn("key", F.concat("l_returnflag", "l_linestatus"))
    answers = items.where("l_discount >= 0.1").groupBy(F.col("l_suppkey").alias("audit"), "key").agg(F.max("l_quantity").alias("score")).withColumn("status", F.lit("scored"))
    return scoring.evaluated(items.select("key").distinct(), answers).select("audit", "key", "status", "score")


@query("""SELECT n_regionkey AS region, count(*) AS records, count(DISTINCT n_name) AS searchable FROM nation GROUP BY 1""")
def k01_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published twice: the second replaces the first."""
    folder, rows = fresh(spark, "published"), read(spark, sf_dir, "nation")
    for part in (rows.limit(3), rows):
        publish.snapshot(part, folder, ["n_regionkey", "n_name"], "n_regionkey")
    index = spark.read.json(f"{folder}/index").groupBy(F.col("n_regionkey").cast("int").alias("region")).agg(F.count("*").alias("records"))
    found = spark.read.json(f"{folder}/search").groupBy(F.col("n_regionkey").cast("int").alias("region")).agg(F.countDistinct("n_name").alias("searchable"))
    return index.join(found, "region")


@query("""SELECT 'INSERT INTO t (a, b, c) VALUES (' || '''' || s_suppkey || ''', ''' || 'it''''s \\\\ ' || s_name || ''', ' || CASE WHEN s_acctbal < 0 THEN 'NULL' ELSE '''x''' END || ');' AS statement FROM supplier""")
def k09_insert_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.concat(F.lit("it's \\ "), "s_name").alias("b"), F.when(F.col("s_acctbal") >= 0, "x").alias("c"))
    return rows.select(publish.insert_statement("t", ["a", "b", "c"]).alias("statement"))


@query("""SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN 'new' ELSE 'old' END AS put, 'old' AS kept FROM customer WHERE c_nationkey < 20 UNION ALL SELECT c_custkey, 'new', 'new' FROM customer WHERE c_nationkey >= 20 AND c_acctbal > 5000""")
def k10_k11_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows put in or replaced, rows put in only, and a table restored to what it was."""
    c = read(spark, sf_dir, "customer")
    table = c.where("c_nationkey < 20").selectExpr("c_custkey as k", "'old' as v")
    rows = c.where("c_acctbal > 5000").selectExpr("c_custkey as k", "'new' as v")
    put, kept = publish.upserted(table, rows, ["k"]), publish.inserted(table, rows, ["k"])
    added = table.union(table.selectExpr("k + 1000000000", "'later'"))
    whole = publish.restored(added, "k", 1000000000).join(table.select("k"), "k", "full")
    return put.withColumnRenamed("v", "put").join(kept.withColumnRenamed("v", "kept"), "k").join(whole.select("k").union(rows.select("k")).distinct(), "k").select("k", "put", "kept")


@query("""SELECT s_suppkey AS k, CASE WHEN s_acctbal < 0 THEN 'partial' ELSE 'ok' END AS status, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS lacking, s_name AS first FROM supplier""")
def k12_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.when(F.col("s_acctbal") < 0, F.array(F.lit("log"))).otherwise(F.array().cast("array<string>"))
    out = read(spark, sf_dir, "supplier").select("s_suppkey", publish.envelope("probe", "site", F.array(F.col("s_name")), gone).alias("e"))
    return out.select(F.col("s_suppkey").alias("k"), F.get_json_object("e", "$.status").alias("status"), F.json_array_length(F.get_json_object("e", "$.unavailable")).alias("lacking"), F.get_json_object("e", "$.findings[0]").alias("first"))


@query("""SELECT o_custkey AS k, max(o_orderdate) AS fetched, CASE WHEN date_diff('day', max(o_orderdate), TIMESTAMP '2000-01-01') <= 0 THEN 'today' WHEN date_diff('day', max(o_orderdate), TIMESTAMP '2000-01-01') = 1 THEN '1 day' ELSE date_diff('day', max(o_orderdate), TIMESTAMP '2000-01-01') || ' days' END AS age FROM orders GROUP BY 1""")
def k13_dated_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("fetched")).distinct()
    return files.latest_first(rows, "k", "fetched").select("k", "fetched", files.age_in_days(F.col("fetched"), F.lit("2000-01-01").cast("timestamp")).alias("age"))


@query(f"""WITH {P} SELECT k, NOT stub AND NOT blog AND k <> 0 AS product_page FROM p""")
def r08_product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.facts import redirect_stub
    from ..operators.discoverability import is_product_page

    facts = html.page_facts(shop(spark, sf_dir))
    stub = redirect_stub(F.col("url"), F.col("canonical"), F.size(html.headings(F.col("html"), 1)), F.col("word_count"))
    return facts.select("k", "url", stub.alias("stub")).select("k", is_product_page().alias("product_page"))


@query(f"""WITH {P} SELECT k, rank FROM (SELECT k, row_number() OVER (ORDER BY CASE WHEN k = 0 THEN 0 ELSE 2 END, k) AS rank FROM p) WHERE rank <= 50""")
def t07_shallow_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of pages from the root down."""
    pages = shop(spark, sf_dir).select("k", urls.depth(F.col("url")).alias("depth")).orderBy("depth", "k").limit(50)
    listed = F.array_sort(F.collect_list(F.struct("depth", "k")))  # fifty rows
    return pages.agg(listed.alias("r")).select(F.posexplode("r").alias("at", "r")).select("r.k", (F.col("at") + 1).cast("long").alias("rank"))


@query("""SELECT c_custkey AS k, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'remote' WHEN c_acctbal < 0 THEN 'refused' ELSE 'local' END AS source FROM customer""")
def s03_source_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr("concat('https://github.com/', if(c_mktsegment = 'BUILDING', 'AcMe/Skills.git', concat('acme', c_custkey, '/skills')))")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), records.source_choice(url, "acme/skills", F.expr("if(c_acctbal < 0, '../x', 'a/b')")).alias("source"))


@query("""SELECT c_custkey AS k, coalesce((SELECT min(o_orderstatus) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000), (SELECT max(o_orderstatus) FROM orders WHERE o_custkey = c_custkey), 'none') AS state FROM customer""")
def s13_first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a customer's large orders say, else what any order says, else the default."""
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    large = orders.where("o_totalprice > 100000").groupBy("k").agg(F.min("o_orderstatus").alias("state"))
    return records.first_known(read(spark, sf_dir, "customer").selectExpr("c_custkey as k"), [large, orders.groupBy("k").agg(F.max("o_orderstatus").alias("state"))], "k", "state", F.lit("none"))


@query("""SELECT s_suppkey AS k, CASE WHEN s_acctbal < 0 THEN '' ELSE '2026-01-' || lpad(CAST(1 + s_nationkey AS VARCHAR), 2, '0') END AS observed FROM supplier""")
def s15_observed_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("""concat('{"platforms":[{"platform":"wordpress","observedAt":"2020-01-01"}', if(s_acctbal < 0, '', concat(',{"platform":"joomla","observedAt":"2026-01-', lpad(1 + s_nationkey, 2, '0'), '"}')), ']}')""")
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), records.observed_at(body, "joomla").alias("observed"))


@query("""SELECT l_orderkey AS k, l_linenumber AS i, l_partkey AS p, 4 AS n, CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END AS second, '' AS last FROM lineitem""")
def s21_separated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("\u001f", F.col("l_orderkey").cast("string"), F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag")), F.lit("a b"), F.lit(""))
    cut = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", records.separated(line).alias("f"))
    return cut.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"), F.size("f").alias("n"), F.col("f")[1].alias("second"), F.col("f")[3].alias("last"))


@query("""SELECT o_orderpriority || '/' || o_custkey AS path, arg_min('a' || o_orderkey, o_orderkey) AS author FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""")
def s24_first_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = read(spark, sf_dir, "orders").selectExpr("concat(o_orderpriority, '/', o_custkey) as path", "concat('a', o_orderkey) as author", "o_orderkey as at", "if(o_orderstatus = 'O', 'A', 'M') as change")
    return records.first_author(commits, "path")


@query("""SELECT p_name AS page, count(*) AS n, 'baseline' AS place FROM part WHERE p_size > 3 GROUP BY 1 UNION ALL SELECT DISTINCT p_name, 0, 'dropped' FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 3)""")
def k08_promoted_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").withColumnRenamed("p_name", "page")
    new, gone = records.promoted(parts.select("page").distinct(), parts.where("p_size > 3").groupBy("page").agg(F.count("*").alias("n")), "page")
    return new.withColumn("place", F.lit("baseline")).union(gone.select("page", F.lit(0).cast("long"), F.lit("dropped")))


@query("""SELECT DISTINCT l_orderkey AS skill, '--f' || l_suppkey AS flag FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey || ':' || l_suppkey NOT IN (SELECT l_orderkey || ':' || l_suppkey FROM lineitem WHERE l_returnflag = 'R')""")
def j31_f70_unhonoured_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as skill", "concat('--f', l_suppkey) as flag", "l_returnflag")
    joined = lambda kind, before, name: items.where(F.col("l_returnflag") == kind).groupBy("skill").agg(F.concat(F.lit(before), F.array_join(F.collect_list("flag"), "` and `"), F.lit("`.")).alias(name))
    return records.unhonoured_flags(joined("A", "Run it with `--help` `", "body"), joined("R", "case in `", "source"), "skill", ["--help"])


@query("""SELECT s_suppkey AS skill, 'TOKEN_' || s_nationkey AS variable FROM supplier WHERE s_acctbal < 5000""")
def j31_unread_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr(r"concat('HOST_A=x\n  export PORT=1\n', if(s_acctbal < 5000, '', concat('TOKEN_', s_nationkey, '=y\n')), 'run ${HOST_A} $PORT ${TOKEN_', s_nationkey, '} $small')")
    return records.unread_variables(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("skill"), code.alias("source")), "skill")


@query("""SELECT DISTINCT s_suppkey AS skill, '--pages' AS flag, 'run' || l_partkey AS script FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_acctbal > 0 AND l_returnflag = 'A' AND s_suppkey || ':' || l_partkey NOT IN (SELECT l_suppkey || ':' || l_partkey FROM lineitem WHERE l_returnflag <> 'A')""")
def a57_flag_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("skill"), F.when(F.col("s_acctbal") > 0, "Note: every gate takes a list, --pages.\nIt needs `--host`.").otherwise("Each tier declares its own pages. Use --pages").alias("body"))
    texts = texts.withColumn("body", F.replace("body", F.lit("a list, --pages"), F.lit("a list --pages")))
    items = read(spark, sf_dir, "lineitem")
    accepted = items.groupBy(F.col("l_suppkey").alias("skill"), F.concat(F.lit("run"), "l_partkey").alias("script")).agg(F.collect_set(F.when(F.col("l_returnflag") == "A", "--host").otherwise("--pages")).alias("flags"))
    return records.lacking_peers(records.claimed_flags(texts, "skill"), accepted, "skill")


@query("""SELECT trim(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '[^a-z0-9.-]+|-{2,}', '-', 'g'), '-') AS page_key, count(*) AS pages, min(page_id) AS first FROM pages GROUP BY 1""")
def k02_scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written under their keys, and counted from what was written."""
    folder = fresh(spark, "scan")
    pages = read(spark, sf_dir, "pages").select("page_id", "url", html.title(F.col("html")).alias("title"))
    records.scan_tree(pages, folder, urls.slug(F.col("url")))
    written = spark.read.schema("page_id long, url string, title string, page_key string").json(f"{folder}/pages")
    return written.groupBy("page_key").agg(F.count("*").alias("pages"), F.min("page_id").alias("first"))


@query("""SELECT s_suppkey AS site, s_acctbal > 0 AS answered, s_nationkey % 3 <> 0 AS found, CASE s_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END AS addresses, s_acctbal > 5000 AS blocks_all FROM supplier""")
def s12_probed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    robots = F.expr(r"case when s_acctbal > 5000 then 'User-agent: *\nDisallow: /\n' when s_acctbal > 0 then 'User-agent: *\nDisallow: /cart\n' end")
    xml = F.expr("case s_nationkey % 3 when 1 then '<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>b</loc></sitemap></sitemapindex>' when 2 then '<urlset><url><loc>a</loc></url><url><loc>b</loc></url><url></url></urlset>' end")
    return records.probed(s.select(F.col("s_suppkey").alias("site"), robots.alias("robots"), xml.alias("sitemap")))


@query("""SELECT 'n' || s_nationkey AS page, 's' || s_suppkey || '.png' AS shot FROM supplier WHERE s_acctbal >= 0""")
def s19_screenshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files in folders of pages; differences between shots, and other files, are left out."""
    from ..sources import images

    folder = fresh(spark, "shots")
    s = read(spark, sf_dir, "supplier")
    name = F.expr("concat('n', s_nationkey, '/', if(s_acctbal < 0, 'diff-', ''), 's', s_suppkey, '.png')")
    shots = s.select(name.alias("name"), images.encoded(F.lit(2), F.lit(1), F.unhex(F.lit("000000FFFFFFFFFF"))).alias("content"))
    notes = s.select(F.expr("concat('n', s_nationkey, '/s', s_suppkey, '.txt')").alias("name"), F.lit("x").cast("binary").alias("content"))
    files.write_files(shots.unionByName(notes), folder)
    return images.shots(spark, folder)


@query("""SELECT c_custkey AS k, CASE WHEN c_nationkey % 4 = 0 THEN 'grid' WHEN c_nationkey % 4 = 1 THEN 'mod_' || lower(c_mktsegment) WHEN c_nationkey % 4 = 2 THEN 'unknown' ELSE 'a:b' END AS block FROM customer""")
def f56_block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.expr("""case c_nationkey % 4 when 0 then '{":type":"kit:grid"}' when 1 then '{":type":7}' when 2 then 'broken' else '{":type":"kit:a:b"}' end""")
    parameters = F.to_json(F.struct(F.lit(1).alias("x"), inner.alias("block")))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), records.block_type(parameters, F.expr("if(c_nationkey % 4 = 2, '', concat('mod_', lower(c_mktsegment)))"), "block").alias("block"))


@query("""SELECT event_id, event_type IN ('view', 'click') AS foreign_line FROM events""")
def f62_not_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("case event_type when 'view' then 'xin chảo' when 'click' then 'Xem, then go' when 'error' then 'voilà, xems echo cho2' when 'purchase' then 'plain English' else 'très bien' end")
    return read(spark, sf_dir, "events").select("event_id", records.not_english(line).alias("foreign_line"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, p_name AS n FROM part) SELECT k, CASE WHEN s > 45 THEN '' WHEN s % 7 = 0 THEN 'Bad Name' ELSE 'my-skill' END AS name, CASE WHEN s > 45 THEN '' WHEN s % 2 = 0 THEN n || ' in two lines' ELSE n || CASE WHEN s % 5 = 0 THEN ' <b>' ELSE '' END END AS description,
 CASE WHEN s > 45 THEN 'no front matter' WHEN s % 3 = 0 THEN 'unexpected: extra' WHEN s % 7 = 0 THEN 'bad name' WHEN s % 2 = 1 AND s % 5 = 0 THEN 'angle brackets' END AS problem FROM p""")
def f72_r20_skill_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(
        r"""concat(if(p_size > 45, '', '---\n'), if(p_size % 7 = 0, 'name: "Bad Name"\n', "name: 'my-skill'\n"), if(p_size % 2 = 0, concat('description: >-\n  ', p_name, '\n\tin two lines\n'), concat('description: ', p_name, if(p_size % 5 = 0, ' <b>', ''), '\n')), if(p_size % 3 = 0, 'extra: 1\n', 'license: MIT\n'), 'metadata:\n  a: b\n---\n# Body\nname: other\n')"""
    )
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("k"), records.skill_head(text).alias("h"), records.skill_problem(text).alias("problem")).select("k", "h.name", "h.description", "problem")


@query("""SELECT DISTINCT user_id AS log, 'ERROR é ' || event_type AS line FROM events WHERE event_type <> 'view'""")
def w11_new_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs read from the byte at which they ended before: what was there, two bytes a letter, is not read again."""
    lines = F.array_join(F.collect_list(F.when(F.col("event_type") != "view", F.concat(F.lit("ERROR\té  "), "event_type"))), "\n")
    logs = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("log")).agg(lines.alias("new")).withColumn("body", F.concat(F.lit("ERROR é old\n"), "new", F.lit("\n# comment\n\n")))
    return records.new_lines(logs, "log", "body", F.octet_length(F.lit("ERROR é old\n")))


@query("""SELECT s_suppkey AS k, 'Shop ' || s_name || CASE WHEN s_acctbal > 0 THEN chr(10) || 'known as n' || s_nationkey ELSE '' END || chr(10) || '{other}' AS text, 'other' AS unknown FROM supplier""")
def f66_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, unknown = records.rendered(F.lit("Shop {shopName}\nknown as {shopAliases}\n{other}"), {"shopName": F.col("s_name"), "shopAliases": F.when(F.col("s_acctbal") > 0, F.concat(F.lit("n"), "s_nationkey"))})
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), text.alias("text"), F.array_join(unknown, ",").alias("unknown"))


@query("""SELECT 's' || s_suppkey || '.png' AS name, CASE WHEN s_nationkey IN (3, 5) THEN NULL WHEN s_acctbal < 5000 THEN 1 ELSE 0 END AS changed, CASE WHEN s_nationkey NOT IN (3, 5) THEN 12 END AS total, CASE WHEN s_nationkey IN (3, 5) THEN NULL WHEN s_acctbal < 5000 THEN 8.3333 ELSE 0.0 END AS percent,
 CASE s_nationkey WHEN 3 THEN 'missing' WHEN 5 THEN 'size-changed' ELSE 'same-size' END AS state FROM supplier""")
def s18_k07_a38_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of PNG files, written and read back, compared pixel by pixel."""
    from ..sources import images

    s = read(spark, sf_dir, "supplier").withColumn("dot", F.concat(F.repeat(F.lpad(F.hex(F.col("s_nationkey") * 8), 2, "0"), F.lit(3)), F.lit("FF")))
    one = lambda first, n: F.unhex(F.concat(first, F.repeat("dot", F.lit(n))))
    name, folder = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".png")), fresh(spark, "images")
    before = s.select(name.alias("name"), images.encoded(F.lit(4), F.lit(3), one(F.col("dot"), 11)).alias("content"))
    other = F.when(F.col("s_acctbal") < 5000, F.when(F.col("s_nationkey") > 12, "000000FF").otherwise("FFFFFFFF")).otherwise(F.col("dot"))
    width = F.when(F.col("s_nationkey") == 5, 6).otherwise(4)
    after = s.where("s_nationkey <> 3").select(name.alias("name"), images.encoded(width, (12 / width).cast("int"), one(other, 11)).alias("content"))
    for side, rows in (("before", before), ("after", after)):
        files.write_files(rows, f"{folder}/{side}")
    return images.compared(images.read(spark, f"{folder}/before"), images.read(spark, f"{folder}/after"))

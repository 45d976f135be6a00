"""Resolution and agreement of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities, rules
from .registry import query, read


@query("""SELECT p_name || ' ' || p_type || ' ' || p_size AS name, CAST(max(p_partkey) AS BIGINT) AS p_partkey FROM part GROUP BY 1 HAVING count(*) = 1""")
def j11_unambiguous_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.unambiguous(read(spark, sf_dir, "part").selectExpr("concat_ws(' ', p_name, p_type, p_size) as name", "p_partkey"), "name", "p_partkey")


@query("""WITH t AS (SELECT substr(p_name, 1, 5 + length(p_name) % 4) AS title, max(p_partkey) AS k FROM part GROUP BY 1), n AS (SELECT DISTINCT p_name AS name FROM part),
m AS (SELECT name, k, row_number() OVER (PARTITION BY name ORDER BY length(title) DESC) AS r FROM n JOIN t ON starts_with(name, title) AND length(title) >= 5) SELECT n.name, m.k AS record FROM n LEFT JOIN m ON m.name = n.name AND r = 1""")
def j10_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    titles = parts.selectExpr("substr(p_name, 1, 5 + length(p_name) % 4) as title", "p_partkey").groupBy("title").agg(F.max("p_partkey").alias("record"))
    return entities.by_longest_prefix(parts.selectExpr("p_name as name").distinct(), "name", titles, "title", "record")


@query("""WITH n AS (SELECT DISTINCT lower(split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)) AS name FROM benchmark), d AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split(lower(text), ' '), lambda x: true), ' ') || ' ' AS t FROM documents)
SELECT name, doc_id FROM n, d WHERE contains(t, ' ' || name || ' ')""")
def j13_cross_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "benchmark").selectExpr("lower(concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3))) as name").distinct()
    texts = read(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("words"))
    return entities.mentions(names, "name", texts, "doc_id", "words")


@query("""SELECT p_name AS name, count(DISTINCT p_brand) AS variants FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2""")
def a21_inconsistent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.inconsistent(read(spark, sf_dir, "part").selectExpr("p_name as name", "p_brand"), "name", "p_brand")


@query("""WITH o AS (SELECT l_orderkey AS cell, l_linenumber AS i, strpos('AANRRO', l_returnflag) + CAST(l_quantity AS INTEGER) % 5 - 2 AS off FROM lineitem), g AS (SELECT DISTINCT * FROM o)
SELECT cell, i, off, CASE WHEN min(off) OVER (PARTITION BY cell) >= 0 THEN CAST(row_number() OVER (PARTITION BY cell ORDER BY off, i) AS INTEGER) END AS expected FROM g""")
def a23_expected_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as cell", "l_linenumber as i", "instr('AANRRO', l_returnflag) + cast(l_quantity as int) % 5 - 2 as off").distinct()
    return entities.first_positions(found, "cell", "off", "i").select("cell", "i", "off", "expected")


@query("""SELECT l_orderkey AS cell, list_sort(list(l_linenumber)) = list_transform(range(1, count(*) + 1), lambda x: CAST(x AS INTEGER)) AS complete FROM lineitem GROUP BY 1""")
def a24_positions_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.positions_complete(read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as cell", "l_linenumber as position"), "cell", "position")


CLAIMS = """c AS (SELECT p_partkey AS ordinal, p_brand AS label, lower(p_type) AS type, lower(split_part(p_name, ' ', 1)) AS element, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE lower(split_part(p_name, ' ', 2)) END AS grp FROM part)"""


@query(f"""WITH {CLAIMS} SELECT type, element, grp, arg_max(label, ordinal) AS label FROM c WHERE grp <> '' GROUP BY 1, 2, 3 UNION ALL
SELECT type, element, '', coalesce(arg_max(label, ordinal) FILTER (grp = ''), arg_min(label, ordinal)) FROM c GROUP BY 1, 2""")
def j12_package_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey as ordinal", "p_brand as label", "p_type as type", "split_part(p_name, ' ', 1) as element", "if(p_partkey % 3 = 0, '', split_part(p_name, ' ', 2)) as grp")
    return entities.claims(rows).toDF("type", "element", "grp", "label")


@query("""SELECT s_suppkey, CASE WHEN x = 0 THEN 'listed' WHEN x = 1 THEN 'quarantined' WHEN x = 2 AND s_suppkey % 2 = 0 THEN 'curated' WHEN x = 2 THEN 'listed' END AS tier, x = 2 AND s_suppkey % 2 = 1 AS demoted FROM (SELECT s_suppkey, s_suppkey % 3 AS x FROM supplier)""")
def a58_tier_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").selectExpr("s_suppkey", "element_at(array(cast(null as string), 'quarantined', 'curated'), cast(s_suppkey % 3 + 1 as int)) as tier", "'aa' as reviewed_hash", "if(s_suppkey % 2 = 0, 'aa', 'bb') as content_hash")
    tier, demoted = rules.resolved_tier(F.col("tier"), F.col("reviewed_hash"), F.col("content_hash"))
    return rows.select("s_suppkey", tier.alias("tier"), demoted.alias("demoted"))


@query(r"""WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Bad Name' ELSE source END AS ns, CASE doc_id % 7 WHEN 0 THEN '../x' ELSE lang || '/skill' END AS path, doc_id % 40 - 5 AS minutes, doc_id % 3 = 0 AS auto, CASE WHEN doc_id % 2 = 0 THEN 'label' END AS label FROM documents)
SELECT doc_id, code FROM (SELECT doc_id, unnest(list_filter([CASE WHEN NOT regexp_matches(ns, '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 'bad-namespace' END, CASE WHEN contains(path, '..') THEN 'unsafe-path' END, CASE WHEN minutes NOT BETWEEN 1 AND 120 THEN 'bad-minutes' END, CASE WHEN auto AND label IS NULL THEN 'label-required' END], lambda x: x IS NOT NULL)) AS code FROM r)""")
def r03_r06_record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").selectExpr("doc_id", "if(doc_id % 5 = 0, 'Bad Name', source) as namespace", "if(doc_id % 7 = 0, '../x', concat(lang, '/skill')) as path", "doc_id % 40 - 5 as run_minutes", "doc_id % 3 = 0 as auto_install", "if(doc_id % 2 = 0, 'label', null) as label")
    return rules.violations(rows, rules.record_rules(), "doc_id").select("doc_id", "code")


@query("""WITH r AS (SELECT * FROM (VALUES ('allow', '/en'), ('disallow', '/'), ('disallow', '/en/9'), ('allow', '/fr/'), ('disallow', '/fr/8')) t(kind, rule)), p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, coalesce(max(length(rule)) FILTER (kind = 'allow' AND starts_with(path, rule)), -1) >= coalesce(max(length(rule)) FILTER (kind = 'disallow' AND starts_with(path, rule)), -1) AS allowed FROM p, r GROUP BY page_id""")
def r01_robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sitemap import allowed, robots_rules

    body = "# all\nUser-agent: other\nDisallow: /\n\nUser-agent: scanbot\nUser-agent: second # two share\nAllow: /en\nDisallow: /\nDisallow: /en/9\nAllow: /fr/\nDisallow: /fr/8\nDisallow:\n\nUser-agent: *\nDisallow: /private"
    files = spark.createDataFrame([(1, body)], "site int, body string")
    paths = read(spark, sf_dir, "pages").select("page_id", F.lit(1).alias("site"), F.try_parse_url("url", F.lit("PATH")).alias("path"))
    judged = allowed(paths.select("site", "path").distinct(), robots_rules(files), "ScanBot/1.0")
    return paths.join(judged, ["site", "path"]).select("page_id", "allowed")


@query("""WITH p AS (SELECT a.c_custkey, a.c_name AS n1, b.c_name AS n2, CAST(15550000000 + a.c_custkey AS VARCHAR) AS t1, '+' || CAST(5550000000 + a.c_custkey + CASE WHEN a.c_custkey % 4 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS t2 FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey - a.c_custkey % 2)
SELECT c_custkey, n1 = n2 AS same_name, right(t1, 10) = right(replace(t2, '+', ''), 10) AS same_phone FROM p""")
def j33_name_and_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import same_phone

    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    other = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("other"))
    joined = c.withColumn("k", F.expr("c_custkey - c_custkey % 2")).join(other, "k")
    a, b = F.expr("cast(15550000000 + c_custkey as string)"), F.expr("concat('+', cast(5550000000 + c_custkey + if(c_custkey % 4 = 0, 1, 0) as string))")
    return joined.select("c_custkey", (F.col("c_name") == F.col("other")).alias("same_name"), same_phone(a, b).alias("same_phone"))

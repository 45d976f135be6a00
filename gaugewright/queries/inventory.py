"""Inventory queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inventory
from .registry import query, read


@query("""WITH d AS (SELECT * FROM (VALUES (1, 'view'), (2, 'click'), (3, 'signup'), (4, 'refund')) t(ordinal, kind)), m AS (SELECT DISTINCT user_id, event_type FROM events), g AS (SELECT u.user_id, d.*, m.event_type IS NOT NULL AS has FROM (SELECT DISTINCT user_id FROM m) u CROSS JOIN d LEFT JOIN m ON m.user_id = u.user_id AND m.event_type = d.kind)
SELECT user_id, coalesce(string_agg(kind, ', ' ORDER BY ordinal) FILTER (has), '') AS measured, coalesce(string_agg(kind, ', ' ORDER BY ordinal) FILTER (NOT has), '') AS not_measured FROM g GROUP BY 1""")
def a26_coverage_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = read(spark, sf_dir, "events").selectExpr("user_id", "event_type as kind")
    return inventory.coverage_line(["view", "click", "signup", "refund"], measured, "user_id", "kind")


@query("""WITH t AS (SELECT p_brand AS k, count(*) FILTER (p_partkey % 3 = 0) AS own, count(*) FILTER (p_partkey % 3 = 1) AS mixed, count(*) FILTER (p_partkey % 3 = 2) AS empty, CAST(sum(p_size) AS BIGINT) AS wants FROM part GROUP BY 1)
SELECT t.k, own, mixed, empty, wants, CAST(coalesce(h.have, 0) AS BIGINT) AS have, CAST(greatest(0, wants - coalesce(h.have, 0)) AS BIGINT) AS shortage FROM t LEFT JOIN (SELECT 'Brand#' || s_nationkey AS k, count(*) * 500 AS have FROM supplier GROUP BY 1) h ON h.k = t.k""")
def a47_slot_shortages(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = read(spark, sf_dir, "part").selectExpr("p_brand as k", "element_at(array('own', 'mixed', 'empty'), cast(p_partkey % 3 + 1 as int)) as fill", "p_size as wants")
    stock = read(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("Brand#"), "s_nationkey").alias("k")).agg((F.count("*") * 500).alias("have"))
    return inventory.shortages(slots, stock, "k")


@query("""SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def j29_dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = read(spark, sf_dir, "lineitem").selectExpr("l_partkey as k")
    return inventory.dangling(cited, read(spark, sf_dir, "part").where("p_size > 10").selectExpr("p_partkey as k"), ["k"])


@query("""WITH w AS (SELECT c_custkey, c_nationkey AS k, '5.' || c_custkey % 4 AS version FROM customer), s AS (SELECT DISTINCT s_nationkey AS k, '5.' || s_suppkey % 3 AS version FROM supplier WHERE s_acctbal > 2000), v AS (SELECT k, string_agg(version, ',' ORDER BY version) AS versions FROM s GROUP BY 1)
SELECT c_custkey, w.k, w.version, versions, CASE WHEN s.k IS NOT NULL THEN 'found' WHEN v.k IS NOT NULL THEN 'version gap' ELSE 'coverage gap' END AS state FROM w LEFT JOIN s ON s.k = w.k AND s.version = w.version LEFT JOIN v ON v.k = w.k""")
def j38_stored_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey as k", "concat('5.', c_custkey % 4) as version")
    stored = read(spark, sf_dir, "supplier").where("s_acctbal > 2000").selectExpr("s_nationkey as k", "concat('5.', s_suppkey % 3) as version")
    return inventory.stored_reference(wanted, stored, "k")


@query("""WITH p AS (SELECT p_partkey, (6 + p_partkey % 3) || '.' || p_partkey % 5 AS has, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '7.2.5' WHEN 2 THEN '8.1' ELSE '8.3' END AS needed, p_size < 5 AS unread, 6 + p_partkey % 3 AS a, p_partkey % 5 AS b FROM part)
SELECT p_partkey, CASE WHEN needed = '' THEN 'none' WHEN unread THEN 'read first' WHEN needed = '7.2.5' THEN CASE WHEN a > 7 OR (a = 7 AND b > 2) THEN 'none' ELSE 'change' END WHEN a > 8 OR (a = 8 AND b >= CAST(split_part(needed, '.', 2) AS INTEGER)) THEN 'none' ELSE 'change' END AS step FROM p""")
def f50_next_requirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").selectExpr("p_partkey", "concat(6 + p_partkey % 3, '.', p_partkey % 5) as has", "element_at(array('', '7.2.5', '8.1', '8.3'), cast(p_partkey % 4 + 1 as int)) as needed", "p_size < 5 as unread")
    return p.select("p_partkey", inventory.next_requirement(F.col("has"), F.col("needed"), F.col("unread")).alias("step"))


@query("""WITH p AS (SELECT substr(lower(text), 1, 4) AS question, text, conv_id * 1000 + turn AS pos, row_number() OVER (PARTITION BY substr(lower(text), 1, 4) ORDER BY length(text) DESC, conv_id * 1000 + turn) AS k, count(*) OVER (PARTITION BY substr(lower(text), 1, 4)) - 1 AS dropped FROM conversations) SELECT question, text, dropped FROM p WHERE k = 1""")
def a20_best_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "conversations").selectExpr("substr(lower(text), 1, 4) as question", "text", "conv_id * 1000 + turn as pos")
    return inventory.best_answers(pairs, "question", "text", "pos")


@query(r"""WITH i AS (SELECT doc_id, doc_id % 40 AS page, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'one two three photo.jpg' WHEN 2 THEN 'a shared text here' ELSE text END AS alt FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY page, alt) AS n FROM i)
SELECT doc_id, n = 1 AND coalesce(trim(alt), '') <> '' AND length(trim(alt)) <= 125 AND len(regexp_split_to_array(trim(alt, ' '), '\s+')) >= 4 AND NOT regexp_matches(trim(alt), '(?i)\.(jpe?g|png|gif|webp|svg)$') AS passes FROM c""")
def r09_alt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = read(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id % 40 as page", "case doc_id % 5 when 0 then null when 1 then 'one two three photo.jpg' when 2 then 'a shared text here' else text end as alt")
    return inventory.alt_passes(images, "page", "alt").select("doc_id", F.coalesce("passes", F.lit(False)).alias("passes"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'Read ' || user_id || ' pages' WHEN 'error' THEN user_id || ' pages failed' ELSE 'Found ' || user_id || ' products' END AS note FROM events WHERE event_type IN ('view', 'error', 'purchase')""")
def w08_event_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.notes(read(spark, sf_dir, "events"), "event_type", "user_id").select("event_id", "note")

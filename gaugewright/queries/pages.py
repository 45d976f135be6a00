"""Queries over raw web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..operators import findings, graph
from ..plans import site_scan
from .registry import query, read

#: DuckDB twin of the visible body text.
BODY = r"""trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<head\b.*?</head>', ' ', 'g'), '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g'), '&amp;', '&'),
 '(?i)&[a-z]+;', ' ', 'g'), '[\s\x{00a0}\x{feff}]+', ' ', 'g'))"""
TITLE = r"""trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\s\x{00a0}\x{feff}]+', ' ', 'g'))"""
HOST = r"""regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\.', '')"""
PATH = r"""regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"""


@query(f"""WITH f AS (SELECT page_id, {TITLE} AS title, {BODY} AS t FROM pages)
SELECT page_id, title, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS BIGINT) AS word_count, sha1(t) AS content_hash, substr(t, 1, 2000) AS sample FROM f""")
def f06_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = html.page_facts(read(spark, sf_dir, "pages"))
    return facts.select("page_id", "title", F.col("word_count").cast("long").alias("word_count"), "content_hash", F.substring("text", 1, 2000).alias("sample"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '[^a-z0-9.-]+|-{2,}', '-', 'g'), '-') AS slug FROM pages""")
def f07_site_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", urls.slug(F.col("url")).alias("slug"))


@query(f"""WITH p AS (SELECT page_id, {HOST} AS host FROM pages), q AS (SELECT page_id, host, lag(host) OVER (ORDER BY page_id) AS before FROM p)
SELECT page_id, host, coalesce(host = before, false) AS same_site FROM q""")
def f08_same_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    before = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("before"))
    return pages.join(before, "page_id", "left").select("page_id", urls.host(F.col("url")).alias("host"), urls.same_site(F.col("url"), F.col("before")).alias("same_site"))


@query(f"""WITH p AS (SELECT page_id, url, list_filter(string_split({PATH}, '/'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, split_part(url, '#', 1) AS bare, CAST(len(parts) AS BIGINT) AS depth, coalesce(parts[1], '/') AS section FROM p""")
def f14_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", urls.without_fragment(u).alias("bare"), urls.depth(u).cast("long").alias("depth"), urls.section(u).alias("section"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS link FROM pages),
k AS (SELECT DISTINCT page_id, split_part(trim(link), '#', 1) AS link FROM l WHERE NOT regexp_matches(trim(link), '^$|^#|^(?i:mailto|tel):'))
SELECT page_id, link FROM k""")
def f04_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.explode(urls.links(F.col("html"))).alias("link"))


@query(r"""WITH l AS (SELECT DISTINCT page_id, url, split_part(trim(x), '#', 1) AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS x FROM pages)
 WHERE NOT regexp_matches(trim(x), '^$|^#|^(?i:mailto|tel):'))
SELECT page_id, CASE WHEN regexp_matches(link, '^(?i:https?)://') THEN link WHEN starts_with(link, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || link
 WHEN starts_with(link, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || link
 ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') END || link END AS target FROM l""")
def f04_resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read(spark, sf_dir, "pages").select("page_id", "url", F.explode(urls.links(F.col("html"))).alias("link"))
    return links.select("page_id", urls.resolve(F.col("link"), F.col("url")).alias("target"))


@query(f"SELECT page_id, 'received' AS arrival FROM pages WHERE length({BODY}) >= 200 UNION ALL SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<h[1-3]\\b') OR len(regexp_extract_all(html, '(?i)<a\\s')) > 2 THEN 'received' WHEN regexp_matches(html, '(?i)captcha|access denied|verify you are human') THEN 'bot-wall' WHEN length(html) > 2000 THEN 'js-shell' ELSE 'empty' END FROM pages WHERE length({BODY}) < 200")
def f33_page_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", html.arrival(F.col("html")).alias("arrival"))


@query(r"""SELECT page_id, level, CAST(len(regexp_extract_all(html, '(?is)<h' || level || '\b[^>]*>')) AS BIGINT) AS n FROM pages, (SELECT unnest(range(1, 7)) AS level) WHERE len(regexp_extract_all(html, '(?is)<h' || level || '\b[^>]*>')) > 0""")
def f31_heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = read(spark, sf_dir, "pages").select("page_id", F.explode(html.heading_levels(F.col("html")).cast("array<long>")).alias("level"))
    return levels.groupBy("page_id", "level").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?is)<h1\b')) <> 1 AS fails FROM pages""")
def r10_heading_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = html.heading_levels(F.col("html"))
    fails = (F.size(F.filter(levels, lambda x: x == 1)) != 1) | html.skips_level(levels)
    return read(spark, sf_dir, "pages").select("page_id", fails.alias("fails"))


@query(f"""SELECT page_id, contains(regexp_replace(lower({TITLE}), '[^a-z0-9]', '', 'g'), substr(regexp_replace(split_part({HOST}, '.', 1), '[^a-z0-9]', '', 'g'), 1, 5)) AS named FROM pages""")
def r11_title_names_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.substring(text.squash(F.split(urls.host(F.col("url")), "\\.")[0]), 1, 5)
    return read(spark, sf_dir, "pages").select("page_id", F.contains(text.squash(html.title(F.col("html"))), label).alias("named"))


@query(f"""WITH f AS (SELECT page_id, {TITLE} AS title FROM pages), d AS (SELECT title FROM f WHERE title <> '' GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, title FROM f WHERE title IN (SELECT title FROM d)""")
def a01_duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.duplicates(html.page_facts(read(spark, sf_dir, "pages")), "title").where("duplicate").select("page_id", "title")


@query(f"""WITH f AS (SELECT page_id, url, {TITLE} AS title, {BODY} AS t FROM pages), g AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS w FROM f),
d AS (SELECT title FROM f WHERE title <> '' GROUP BY 1 HAVING count(*) > 1),
h AS (SELECT 'missing-title' AS check_id, 1 AS priority, page_id, url FROM g WHERE title = ''
 UNION ALL SELECT 'missing-meta-description', 1, page_id, url FROM g UNION ALL SELECT 'duplicate-title', 2, page_id, url FROM g WHERE title IN (SELECT title FROM d)
 UNION ALL SELECT 'thin-content', 2, page_id, url FROM g WHERE w < 150 UNION ALL SELECT 'missing-canonical', 3, page_id, url FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY page_id, url) AS n FROM h)
SELECT check_id, CAST(priority AS INTEGER) AS priority, count(*) AS count, string_agg(CASE WHEN n <= 20 THEN url END, ' ' ORDER BY page_id, url) AS urls FROM r GROUP BY 1, 2""")
def a03_seo_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_scan.seo_findings(read(spark, sf_dir, "pages"))
    return found.select("check_id", "priority", "count", F.array_join("subjects", " ").alias("urls"))


@query(f"""WITH p AS (SELECT coalesce(list_filter(string_split({PATH}, '/'), lambda x: x <> '')[1], '/') AS section FROM pages)
SELECT section, count(*) AS n FROM p GROUP BY 1""")
def a09_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").groupBy(urls.section(F.col("url")).alias("section")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section")


@query(f"""WITH p AS (SELECT page_id, url, len(list_filter(string_split({PATH}, '/'), lambda x: x <> '')) AS depth FROM pages) SELECT page_id, url FROM p ORDER BY depth, page_id LIMIT 100""")
def t01_crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import crawl_order

    entries = read(spark, sf_dir, "pages").select("page_id", "url", F.lit(None).cast("string").alias("lastmod"), F.col("page_id").alias("pos"), urls.depth(F.col("url")).alias("depth"))
    return crawl_order(entries, 100)[0].select("page_id", "url")


@query("SELECT page_id, url FROM pages ORDER BY length(url), url, page_id LIMIT 30")
def t02_shortest_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url").orderBy(F.length("url"), "url", "page_id").limit(30)


EDGES = r"""e AS (SELECT DISTINCT url AS source, page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || split_part(x, '#', 1) AS target
 FROM (SELECT url, page_id, trim(unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1))) AS x FROM pages) WHERE starts_with(x, '/') AND NOT starts_with(x, '//'))"""


@query(f"""WITH {EDGES} SELECT target, arg_min(source, page_id) AS source FROM e WHERE target NOT IN (SELECT url FROM pages) GROUP BY 1""")
def j03_links_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    edges = site_scan.edges(pages).where(F.startswith("link", F.lit("/")))
    return graph.outside_targets(edges, pages, "page_id")


@query(f"""WITH {EDGES} SELECT page_id, url FROM pages WHERE url NOT IN (SELECT target FROM e)""")
def j05_orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return graph.orphans(pages, site_scan.edges(pages)).select("page_id", "url")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k FROM part), e AS (SELECT k // 3 AS s, k AS t FROM p WHERE k > 0 UNION SELECT k, (k * 7 + 1) % (SELECT count(*) FROM p) FROM p WHERE k % 5 = 0),
d(k, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.t, d.depth + 1 FROM d JOIN e ON e.s = d.k WHERE d.depth < 20)
SELECT CAST(k AS VARCHAR) AS url, CAST(min(depth) AS INTEGER) AS depth FROM d GROUP BY 1""")
def a07_click_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    n = keys.count()
    edges = keys.where("k > 0").selectExpr("cast(k div 3 as string) as source", "cast(k as string) as target").union(
        keys.where("k % 5 = 0").selectExpr("cast(k as string) as source", f"cast((k * 7 + 1) % {n} as string) as target")
    )
    pages = keys.selectExpr("cast(k as string) as url")
    return graph.depths(pages, edges, pages.where("url = '0'"))


@query("""SELECT l_suppkey AS target, max(l_discount) AS worst, count(*) AS links FROM lineitem GROUP BY 1 HAVING max(l_discount) >= 0.1""")
def j04_broken_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    edges = items.select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target"))
    statuses = items.groupBy(F.col("l_suppkey").alias("target")).agg(F.max("l_discount").alias("worst")).withColumn("status", F.when(F.col("worst") >= 0.1, 404).otherwise(200))
    return graph.broken(edges, statuses).groupBy("target").agg(F.first("worst").alias("worst"), F.count("*").alias("links"))


@query(r"""SELECT page_id, url AS loc, CAST(page_id % 28 + 1 AS VARCHAR) AS lastmod FROM pages""")
def s06_sitemap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sitemap import entries

    maps = read(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc><lastmod>"), (F.col("page_id") % 28 + 1).cast("string"), F.lit("</lastmod></url><url><loc> </loc></url></urlset>")).alias("xml")
    )
    return entries(maps, "xml").select("page_id", "loc", "lastmod")

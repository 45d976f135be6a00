"""Queries over a made shop whose pages are written out as HTML with structured data, and read back as facts.

The pages are built from ``part``: what a page says of its product depends on the product's own columns, so the oracles
state the expected facts from the table and never see the HTML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts, urls
from ..operators import discoverability
from ..sources.stored import stored
from .registry import query, read, spread

SITE = "https://acme-shop.example"
#: What the page of a part holds, as SQL over ``part`` that both engines understand. ``s`` is p_size, ``t`` p_type.
HOLDS = {
    "broken": "s = 50",
    "is_product": "s % 9 <> 0",
    "aggregate": "s % 2 = 0",
    "price": "s > 5",
    "currency": "s > 10",
    "availability": "s > 15",
    "gtin": "s % 3 = 0",
    "bad_gtin": "s % 3 = 1",
    "brand": "t <> 'PROMO'",
    "mpn": "s > 40",
    "rating": "s > 25",
    "shipping": "s > 30",
    "faq": "s % 7 = 0",
    "trail": "s % 5 = 0",
    "video": "s % 11 = 0",
    "thumbnail": "s % 2 = 1",
    "organization": "t = 'SMALL' or s % 13 = 0",
    "same_as": "s % 4 = 0",
    "blog": "p_partkey % 4 = 3",
    "named": "s % 8 <> 0",
    "one_heading": "s % 6 <> 0",
    "stub": "s % 25 = 1",
}
P = "p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand_name, p_retailprice AS price_value, s, t, " + ", ".join(f"({v}) AS {n}" for n, v in HOLDS.items()) + " FROM (SELECT *, p_size AS s, p_type AS t FROM part))"
URL = f"CASE WHEN k = 0 THEN '{SITE}/' WHEN blog THEN '{SITE}/blogs/' || k ELSE '{SITE}/products/' || k END"
#: SQL of the facts that a readable page has.
READABLE = "NOT broken AND NOT stub"


def shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, url, html, order): one page a part."""
    p = spread(read(spark, sf_dir, "part"), "p_partkey").selectExpr("p_partkey as k", "p_name as name", "p_brand as brand_name", "p_retailprice as price_value", "p_size as s", "p_type as t", *(f"({v.replace('p_partkey', 'p_partkey')}) as {n}" for n, v in ((n, v.replace("s ", "p_size ").replace("t ", "p_type ") if n != "blog" else v) for n, v in HOLDS.items())))
    on = lambda name, text: F.when(F.col(name), text if not isinstance(text, str) else F.lit(text)).otherwise("")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    offer = F.concat(
        F.lit('{"@type":"'), F.when(F.col("aggregate"), "AggregateOffer").otherwise("Offer"), F.lit('"'), on("price", F.concat(F.lit(',"price":'), F.when(F.col("s") % 2 == 0, F.col("price_value").cast("string")).otherwise(q(F.col("price_value").cast("string"))))),
        on("currency", ',"priceCurrency":"EUR"'), on("availability", ',"availability":"InStock"'), on("shipping", ',"shippingDetails":{"@type":"OfferShippingDetails"}'), F.lit("}"),
    )
    number = F.concat(F.lit(',"gtin13":"'), F.lpad(F.col("k").cast("string"), 13, "0"), F.lit('"'))
    product = F.concat(
        F.lit('{"@type":["Product","Thing"],"name":'), q(F.col("name")), on("gtin", number), on("bad_gtin", ',"gtin":"12345"'),
        on("brand", F.concat(F.lit(',"brand":'), F.when(F.col("s") % 2 == 1, q(F.col("brand_name"))).otherwise(F.concat(F.lit('{"@type":"Brand","name":'), q(F.col("brand_name")), F.lit("}"))))), on("mpn", ',"mpn":"M1"'),
        F.lit(',"sku":"'), F.col("k").cast("string"), F.lit('"'), on("rating", ',"aggregateRating":{"@type":"AggregateRating","ratingValue":4}'), F.lit(',"offers":['), offer, F.lit("]}"),
    )
    faq = '{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":" Is it <b>new</b>? ","acceptedAnswer":{"text":"<p>Yes &amp; no .</p>"}},{"@type":"Question","name":"","acceptedAnswer":{"text":"x"}},{"name":"Why?","acceptedAnswer":{"text":"Because."}}]}'
    trail = F.concat(
        F.lit('{"@type":"BreadcrumbList","itemListElement":[{"position":1,"name":"Home","item":"/"},{"position":'), F.when(F.col("s") % 10 == 0, "1").otherwise('"2"'),
        F.lit(',"name":"'), F.when(F.col("s") == 15, "").otherwise("Rings"), F.lit('","item":{"@id":"/collections/rings"}}'), F.when(F.col("s") == 25, F.lit(',{"position":3,"name":"It","item":"/products/x"}')).otherwise(""), F.lit("]}"),
    )
    video = F.concat(F.lit('{"@type":"VideoObject","name":"Film","embedUrl":"https://v.example/1"'), on("thumbnail", ',"thumbnailUrl":["","https://v.example/t.png"]'), F.lit("}"))
    org = F.concat(F.lit('{"@type":"Organization","name":"Acme","logo":{"url":"/logo.png"},"sameAs":'), F.when(F.col("same_as"), '["https://x.com/acme"]').otherwise('"https://x.com/acme"'), F.lit("}"))
    graph = F.concat(F.lit('<script type="application/ld+json">{"@context":"https://schema.org","@graph":['), F.array_join(F.filter(F.array(on("is_product", product), on("faq", faq), on("trail", trail), on("video", video), on("organization", org)), lambda x: x != ""), ","), F.when(F.col("broken"), "]").otherwise("]}"), F.lit("</script>"))
    url = F.expr(URL)
    words = F.concat_ws(" ", F.expr("transform(sequence(1, 1 + s), i -> concat('word', i))"))
    title = F.concat(F.lit("<title>"), F.col("name"), on("named", " | ACME-Shop"), F.lit("</title>"))
    tall = F.concat(
        F.lit("<html><head>"), title, F.when(F.col("k") == 0, '<meta name="robots" content="NOINDEX, follow">').otherwise(""), graph, F.lit("</head><body><h1>"), F.col("name"), F.lit("</h1>"), on("one_heading", "<h2>Details</h2>"), F.when(~F.col("one_heading"), "<h3>Details</h3>").otherwise(""),
        F.lit("<script>var hidden = 1;</script><p>"), words, F.lit("</p><img src='https://cdn.shopify.com/s/files/Ring_100x.PNG?v=2' alt=\""), F.when(F.col("s") % 3 == 1, "ring").otherwise("a small ring of gold"), F.lit("\"><img class='x' src=\"/img/"), F.col("k").cast("string"), F.lit('.jpg"'), F.when(F.col("s") % 4 == 0, '').otherwise(F.concat(F.lit(' alt="ring number '), F.col("k").cast("string"), F.lit(' in silver"'))), F.lit('><a href="/collections/rings">Rings</a><a href="https://www.instagram.com/Acme/">Us</a><a href="https://x.com/">x</a><a href="/pages/About-us">About</a><a href="/contact">Mail</a></body></html>'),
    )
    hop = F.concat(F.lit('<html><head><link rel="canonical" href="https://elsewhere.example/'), F.col("k").cast("string"), F.lit('"></head><body>Moved</body></html>'))
    return p.select("k", url.alias("url"), F.when(F.col("stub"), hop).otherwise(tall).alias("html"), F.col("k").alias("order"), F.lit(SITE).alias("site"))


@query(f"WITH {P} SELECT k, CAST(i AS BIGINT) AS at, CASE i WHEN 0 THEN 'https://cdn.shopify.com/s/files/Ring_100x.PNG?v=2' ELSE '/img/' || k || '.jpg' END AS src, CASE WHEN i = 0 AND s % 3 = 1 THEN 'ring' WHEN i = 0 THEN 'a small ring of gold' WHEN s % 4 <> 0 THEN 'ring number ' || k || ' in silver' END AS alt, CASE i WHEN 0 THEN 'ring.png' ELSE k || '.jpg' END AS base FROM p, (SELECT unnest([0, 1]) AS i) WHERE NOT stub")
def f03_f32_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shop(spark, sf_dir).select("k", F.posexplode(facts.images(F.col("html"))).alias("at", "i"))
    return found.select("k", F.col("at").cast("long").alias("at"), "i.src", "i.alt", facts.image_base(F.col("i.src")).alias("base"))


@query(f"WITH {P} SELECT k, CASE WHEN s % 3 = 0 THEN k || '.jpg' WHEN s % 3 = 1 THEN 'ring.png' ELSE 'ring.png' END AS bases FROM p WHERE NOT stub UNION ALL SELECT k, '' FROM p WHERE stub")
def f32_product_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of the product itself: those it names, else those of the store's servers."""
    pages = shop(spark, sf_dir).select("k", facts.images(F.col("html")).alias("found")).join(read(spark, sf_dir, "part").selectExpr("p_partkey as k", "p_size % 3 = 0 as own"), "k")
    named = F.when(F.col("own"), F.array(F.concat(F.lit("https://other.example/a/"), F.col("k").cast("string"), F.lit("_50x60.jpg")))).otherwise(F.array(F.lit("nowhere.png")))
    kept = pages.select("k", facts.product_images(F.col("found"), named).alias("kept"))
    return kept.select("k", F.array_join(F.transform("kept", lambda i: facts.image_base(i["src"])), ",").alias("bases"))


@query(f"WITH {P} SELECT k, stub FROM p")
def f09_redirect_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.page_table(shop(spark, sf_dir)).select("k", "stub")


@query(f"""WITH {P} SELECT k, true AS offers, price, currency, availability, gtin, brand, mpn, true AS sku FROM p WHERE {READABLE} AND is_product""")
def f10_product_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = facts.with_nodes(shop(spark, sf_dir)).where("item is not null")
    return pages.select("k", facts.product(F.col("item"), F.col("offer")).alias("p")).select("k", "p.*")


@query(f"""WITH {P} SELECT k, true AS name, true AS logo, same_as FROM p WHERE {READABLE} AND organization""")
def f11_organization_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = facts.with_nodes(shop(spark, sf_dir)).where("maker is not null")
    return pages.select("k", facts.organization(F.col("maker")).alias("o")).select("k", "o.*")


@query(f"""WITH {P} SELECT k, true AS name, thumbnail, true AS url FROM p WHERE {READABLE} AND video""")
def f12_video_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = facts.with_nodes(shop(spark, sf_dir)).where("film is not null")
    return pages.select("k", facts.video(F.col("film")).alias("v")).select("k", "v.*")


@query(f"""WITH {P}, n AS (SELECT k, unnest(list_filter([CASE WHEN is_product THEN 'Product' END, CASE WHEN is_product THEN 'Thing' END, CASE WHEN is_product AND brand AND s % 2 = 0 THEN 'Brand' END, CASE WHEN is_product AND rating THEN 'AggregateRating' END,
 CASE WHEN is_product THEN CASE WHEN aggregate THEN 'AggregateOffer' ELSE 'Offer' END END, CASE WHEN is_product AND shipping THEN 'OfferShippingDetails' END, CASE WHEN faq THEN 'FAQPage' END, CASE WHEN faq THEN 'Question' END, CASE WHEN trail THEN 'BreadcrumbList' END, CASE WHEN video THEN 'VideoObject' END,
 CASE WHEN organization THEN 'Organization' END], lambda x: x IS NOT NULL)) AS type FROM p WHERE {READABLE}) SELECT k, type FROM n""")
def f05_f28_schema_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types anywhere in a page's structured data, nested nodes included."""
    return stored(facts.page_table(shop(spark, sf_dir)), "pages").select("k", F.explode("types").alias("type"))


@query("""SELECT event_id, event_type NOT IN ('view', 'refund') AS document FROM events""")
def f13_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("case event_type when 'view' then 'text/calendar; charset=utf-8' when 'click' then 'Text/HTML' when 'refund' then 'application/Atom+xml' when 'signup' then null else '' end")
    return read(spark, sf_dir, "events").select("event_id", facts.is_document(kind).alias("document"))


@query(f"""WITH {P} SELECT k, NOT stub AND is_product AS in_data, false AS in_script, NOT stub AS in_body FROM p""")
def f24_raw_haystack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of structured data are found, words of scripts are not."""
    text = facts.haystack(F.col("html"))
    return shop(spark, sf_dir).select("k", text.alias("t")).select("k", F.contains("t", F.concat(F.lit('"sku":"'), F.col("k").cast("string"), F.lit('"'))).alias("in_data"), F.contains("t", F.lit("hidden")).alias("in_script"), F.contains("t", F.lit("word1")).alias("in_body"))


@query(f"""WITH {P} SELECT k, CASE WHEN stub THEN '' ELSE 'instagram.com/acme' END AS profiles, CASE WHEN stub THEN '' ELSE '/pages/about-us' END AS about, CASE WHEN stub THEN '' ELSE '/contact' END AS contact FROM p""")
def f34_profiles_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, url = F.col("html"), F.col("url")
    joined = lambda x: F.array_join(x, ",")
    return shop(spark, sf_dir).select("k", joined(facts.social_profiles(page)).alias("profiles"), joined(facts.links_about(page, url, "about")).alias("about"), joined(facts.links_about(page, url, "contact", "about")).alias("contact"))


@query(f"""WITH {P} SELECT k, 'Is it <b>new</b>?|Yes & no.;Why?|Because.' AS pairs, s % 2 = 0 AS redundant FROM p WHERE {READABLE} AND faq""")
def f35_faq(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = facts.with_nodes(shop(spark, sf_dir)).where("answers is not null").select("k", facts.faq(F.col("answers")).alias("f"))
    pages = stored(held, "faq").join(read(spark, sf_dir, "part").selectExpr("p_partkey as k", "p_size as s"), "k")
    page = F.expr("if(s % 2 = 0, 'so: why? and is it <b>new</b>?', 'why?')")
    return pages.select("k", F.array_join(F.transform("f", lambda x: F.concat_ws("|", x["question"], x["answer"])), ";").alias("pairs"), facts.faq_redundant(F.col("f"), page).alias("redundant"))


@query(f"""WITH {P} SELECT k, CASE WHEN s % 10 = 0 THEN 0 WHEN s = 15 THEN 50 ELSE 100 END AS score FROM p WHERE {READABLE} AND trail AND s <> 5 UNION ALL SELECT k, 100 FROM p WHERE {READABLE} AND s = 5 UNION ALL SELECT k, 0 FROM p WHERE NOT ({READABLE}) OR NOT trail""")
def c14_breadcrumb_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = facts.with_nodes(shop(spark, sf_dir)).select("k", facts.trail_items(F.col("trail")).alias("items"))
    return stored(items, "trails").select("k", facts.breadcrumb_score(F.col("items")).alias("score"))


_FAILS = [
    ("crawlable-text", 2, "s < 21"), ("image-alt-text", 3, "s % 4 = 0 OR s % 3 = 1"), ("heading-hierarchy", 3, "NOT one_heading"), ("brand-in-title", 1, "product_page AND NOT named"),
    ("product-schema", 1, "product_page AND NOT (NOT broken AND is_product AND price AND currency AND availability)"), ("product-schema-rich", 2, "product_page AND NOT (NOT broken AND is_product AND (gtin OR (brand AND mpn)))"),
    ("review-schema", 2, "product_page AND NOT (NOT broken AND is_product AND rating)"), ("shipping-schema", 2, "product_page AND NOT (NOT broken AND is_product AND shipping)"), ("faq-schema", 2, "product_page AND NOT (NOT broken AND faq)"),
    ("breadcrumb-schema", 3, "product_page AND NOT (NOT broken AND trail)"), ("video-schema", 3, "product_page AND NOT broken AND video AND NOT thumbnail"),
]


@query(f"""WITH {P}, g AS (SELECT *, {URL} AS url, NOT blog AND k <> 0 AS product_page FROM p WHERE NOT stub), h AS ({" UNION ALL ".join(f"SELECT '{i}' AS check_id, {n} AS priority, url, k FROM g WHERE {w}" for i, n, w in _FAILS)}), r AS (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY k) AS rank FROM h),
o AS (SELECT count(*) FILTER (organization AND NOT broken) AS n, bool_or(organization AND NOT broken AND same_as) AS full_one FROM g)
SELECT check_id, CAST(priority AS INTEGER) AS priority, count(*) AS count, string_agg(CASE WHEN rank <= 20 THEN url END, ' ' ORDER BY k) AS subjects FROM r GROUP BY 1, 2
UNION ALL SELECT 'ai-bots-allowed', 1, 2 + (SELECT count(*) FROM g WHERE k = 0), 'chatgpt-user blocked on {SITE} googlebot blocked on {SITE}' || CASE WHEN (SELECT count(*) FROM g WHERE k = 0) > 0 THEN ' noindex blocked on {SITE}' ELSE '' END
UNION ALL SELECT 'organization-schema', 1, 1, CASE WHEN n = 0 THEN 'no Organization markup on {SITE}' ELSE 'Organization missing: sameAs' END FROM o WHERE NOT coalesce(full_one, false)""")
def a04_discoverability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks from the pages' own HTML and the site's robots file."""
    held = stored(facts.page_table(shop(spark, sf_dir)), "pages")  # so that pages are parsed once
    pages = held.withColumn("document", facts.is_document(F.lit("text/html"))).withColumn("internal_links", F.transform("links", lambda x: urls.resolve(x, F.col("url"))))
    robots = spark.createDataFrame([(SITE, "User-agent: Googlebot\nUser-agent: ChatGPT-User\nDisallow: /\n\nUser-agent: *\nDisallow: /admin\n")], "site string, body string")
    found = discoverability.discoverability(pages, robots)
    return found.select("check_id", "priority", "count", F.array_join("subjects", " ").alias("subjects"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 5 = 0 AS up, s_suppkey % 3 = 0 AS fb, s_acctbal > 0 AS signed, s_nationkey % 2 = 0 AS f1, s_nationkey % 3 = 0 AS f2 FROM supplier),
x AS (SELECT k, 'ucp-profile-unreachable' AS check_id, 1 AS priority, 'https://b' || k || CASE k % 5 WHEN 1 THEN ': 404' WHEN 2 THEN ': no version' WHEN 3 THEN ': not JSON' ELSE ': redirects to https://r' END || CASE WHEN fb THEN '|https://p' || k || ' answers instead' ELSE '' END AS evidence FROM s WHERE NOT up
UNION ALL SELECT k, 'ucp-origin-split', 2, 'https://b' || k || ' points to https://p' || k FROM s WHERE NOT up AND fb
UNION ALL SELECT k, 'ucp-agent-files-missing', 2, concat_ws('|', CASE WHEN NOT f1 THEN '/llms.txt: unreachable' END, CASE WHEN NOT f2 THEN '/agents.md: redirects to https://x' END) FROM s WHERE NOT (f1 AND f2)
UNION ALL SELECT k, 'ucp-signing-keys-absent', 3, 'no signing keys' FROM s WHERE (up OR fb) AND NOT signed)
SELECT k, check_id, CAST(priority AS INTEGER) AS priority, check_id = 'ucp-signing-keys-absent' AS platform_limit, evidence FROM x""")
def a05_r07_agent_door(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    probe = lambda letter, status, json, version, redirected: F.expr(f"named_struct('origin', concat('https://{letter}', s_suppkey), 'status', {status}, 'json', {json}, 'version', {version}, 'signed', s_acctbal > 0, 'redirected', {redirected})")
    brand = probe("b", "case s_suppkey % 5 when 1 then 404 else 200 end", "s_suppkey % 5 <> 3", "if(s_suppkey % 5 = 0, '1', cast(null as string))", "if(s_suppkey % 5 = 4, 'https://r', cast(null as string))")
    platform = probe("p", "200", "true", "if(s_suppkey % 3 = 0, '1', cast(null as string))", "cast(null as string)")
    files = F.expr("array(named_struct('path', '/llms.txt', 'status', if(s_nationkey % 2 = 0, 200, 0), 'redirected', cast(null as string)), named_struct('path', '/agents.md', 'status', 200, 'redirected', if(s_nationkey % 3 = 0, cast(null as string), 'https://x')))")
    found = discoverability.door_findings(s.select(F.col("s_suppkey").alias("site"), brand.alias("brand"), platform.alias("platform"), files.alias("files")))
    return found.select(F.col("site").alias("k"), "check_id", "priority", "platform_limit", F.array_join("evidence", "|").alias("evidence"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'supplier' WHEN 1 THEN 'brandname' WHEN 2 THEN '' ELSE 'aepfel' END AS key FROM supplier""")
def f67_brand_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("element_at(array('The Supplier Shop Online', 'Shop Brandname & partners', 'Official Store', 'Äpfel-äpfel'), cast(s_suppkey % 4 + 1 as int))")
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 3, "aepfel").otherwise(facts.brand_key(name)).alias("key"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_nationkey % 3 <> 0 THEN CASE c_nationkey % 3 WHEN 1 THEN 'meta' END END, CASE WHEN c_custkey % 2 = 0 THEN 'page' END) AS title FROM customer""")
def f69_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr("element_at(array(cast(null as string), 'meta', ''), cast(c_nationkey % 3 + 1 as int))")
    return read(spark, sf_dir, "customer").select("c_custkey", facts.first_filled(given, F.expr("if(c_custkey % 2 = 0, 'page', null)")).alias("title"))

"""Can machines find, read and identify what a site sells? Checks over the facts of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import skips_level
from ..functions.text import squash
from ..functions.urls import host
from ..sources.sitemap import allowed, robots_rules
from .findings import Check, findings

#: Crawlers of search and answer engines.
CRAWLERS = ["googlebot", "oai-searchbot", "chatgpt-user"]
FILE_NAME = r"(?i)^(img[_-]|dsc[_-]?\d)|\.(jpe?g|png|gif|webp|svg|bmp|avif)$"


def is_product_page() -> Column:
    return ~F.col("stub") & F.contains("url", F.lit("/products/"))


def alts_fail(images: Column) -> Column:
    """Does an image lack a telling alternative text: 4 words or more, 125 characters at most, no file name, once on its page?"""
    texts = F.transform(images, lambda i: F.trim(F.coalesce(i["alt"], F.lit(""))))
    lower = F.transform(texts, lambda x: F.lower(x))
    good = lambda x: (x != "") & ~F.regexp_like(x, F.lit(FILE_NAME)) & (F.size(F.split(x, "\\s+")) >= 4) & (F.length(x) <= 125)
    once = F.size(F.array_distinct(lower)) == F.size(lower)
    repeated = lambda x: F.size(F.filter(lower, lambda y: y == F.lower(x))) > 1
    return (F.size(texts) > 0) & F.exists(texts, lambda x: ~good(x) | (~once & repeated(x)))


def page_checks() -> list[Check]:
    """Checks that one page fails or passes; those on products look at product pages only."""
    c, shop = F.col, is_product_page()
    brand = F.substring(squash(F.split(host(c("site")), "\\.")[0]), 1, 5)
    p = lambda name: F.coalesce(c("product")[name], F.lit(False))
    lacks = lambda *kinds: ~F.arrays_overlap("types", F.array(*map(F.lit, kinds)))
    v = c("video")
    return [
        Check("crawlable-text", "Pages with hardly any text", 2, c("word_count") < 30),
        Check("image-alt-text", "Pages with images that no text describes", 3, alts_fail(c("images"))),
        Check("heading-hierarchy", "Pages with broken heading levels", 3, (c("first_headings") != 1) | skips_level(c("levels"))),
        Check("brand-in-title", "Product pages whose title lacks the brand", 1, ~F.contains(squash(F.coalesce("title", F.lit(""))), brand), shop & (brand != "")),
        Check("internal-linking", "Product pages without a path to a category", 3, lacks("BreadcrumbList") & ~F.exists("internal_links", lambda x: F.contains(x, F.lit("/collections/"))), shop),
        Check("product-schema", "Product pages without a readable offer", 1, ~(p("price") & p("currency") & p("availability")), shop),
        Check("product-schema-rich", "Products that cannot be identified", 2, ~(p("gtin") | (p("brand") & p("mpn"))), shop),
        Check("review-schema", "Product pages without readable ratings", 2, lacks("AggregateRating", "Review"), shop),
        Check("shipping-schema", "Product pages without readable shipping", 2, lacks("OfferShippingDetails"), shop),
        Check("faq-schema", "Product pages without readable answers", 2, lacks("FAQPage"), shop),
        Check("breadcrumb-schema", "Product pages without a readable trail", 3, lacks("BreadcrumbList"), shop),
        Check("video-schema", "Product videos that cannot be read", 3, v.isNotNull() & ~(v["name"] & v["thumbnail"] & v["url"]), shop),
    ]


def site_evidence(pages: DataFrame, robots: DataFrame) -> DataFrame:
    """(check_id, priority, subject): what is said of the site as a whole. robots(site, body); pages have ``site``.

    Crawlers that the robots file or the home page turns away; and the organization's identity, complete on some page or
    not. Of a site without pages nothing is said.
    """
    rules = robots_rules(robots)
    home = robots.select("site", F.lit("/").alias("path"))
    shut = None
    for agent in CRAWLERS:
        one = allowed(home, rules, agent).where(~F.col("allowed")).select("site", F.lit(agent).alias("who"))
        shut = one if shut is None else shut.union(one)
    hidden = pages.where((F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")) == "/") & F.contains(F.lower("robots"), F.lit("noindex"))).select("site", F.lit("noindex").alias("who")).distinct()
    turned = shut.union(hidden).select(F.lit("ai-bots-allowed").alias("check_id"), F.lit(1).alias("priority"), F.concat("who", F.lit(" blocked on "), "site").alias("subject"))

    o = F.col("organization")
    full = o["name"] & o["logo"] & o["same_as"]
    missing = F.concat_ws(", ", F.when(~o["name"], "name"), F.when(~o["logo"], "logo"), F.when(~o["same_as"], "sameAs"))
    per = pages.groupBy("site").agg(F.count(o).alias("n"), F.coalesce(F.bool_or(full), F.lit(False)).alias("full"), F.min_by(missing, F.when(o.isNotNull(), F.col("order"))).alias("missing"))
    said = F.when(F.col("n") == 0, F.concat(F.lit("no Organization markup on "), "site")).when(~F.col("full"), F.concat(F.lit("Organization missing: "), "missing"))
    return turned.union(per.select(F.lit("organization-schema"), F.lit(1), said.alias("subject")).where("subject is not null"))


def discoverability(pages: DataFrame, robots: DataFrame, samples: int = 20) -> DataFrame:
    """pages with the facts of ``facts.page_table``, (site, order, document, internal_links) -> (check_id, priority, count, subjects).

    Stubs and what is not a page are left out. Facts are read once for all page checks.
    """
    kept = pages.where(~F.col("stub") & F.col("document"))
    by_page = findings(kept, page_checks(), "url", "order", samples).select("check_id", "priority", "count", "subjects")
    said = site_evidence(kept, robots)
    counts = said.groupBy("check_id", "priority").agg(F.count("*").alias("count"))
    first = said.withColumn("_rank", F.row_number().over(Window.partitionBy("check_id").orderBy("subject"))).where(F.col("_rank") <= samples)  # cut before anything is gathered, whatever the number of sites
    evidence = counts.join(first.groupBy("check_id").agg(F.array_sort(F.collect_list("subject")).alias("subjects")), "check_id").select("check_id", "priority", "count", "subjects")
    return by_page.union(evidence).orderBy("priority", F.desc("count"), "check_id")


def usable(probe: Column) -> Column:
    """A profile that answers as one: status 200, JSON, with a version."""
    return F.coalesce((probe["status"] == 200) & probe["json"] & probe["version"].isNotNull(), F.lit(False))


def door_findings(sites: DataFrame) -> DataFrame:
    """sites(site, brand, platform, files) -> (site, check_id, priority, platform_limit, evidence): is there an entrance for agents?

    ``brand`` and ``platform`` are probes (origin, status, json, version, signed, redirected), ``files`` an array of
    (path, status, redirected). A check without evidence is silent.
    """
    b, p = F.col("brand"), F.col("platform")
    state = F.when(b["redirected"].isNotNull(), F.concat(F.lit("redirects to "), b["redirected"])).when(b["status"] != 200, F.when(b["status"] == 0, "unreachable").otherwise(b["status"].cast("string"))).when(b["json"], "no version").otherwise("not JSON")
    fallback = usable(p)
    shut = ~usable(b)
    lines = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    lacking = F.transform(
        F.filter("files", lambda f: (f["status"] != 200) | f["redirected"].isNotNull()),
        lambda f: F.concat(f["path"], F.lit(": "), F.when(f["redirected"].isNotNull(), F.concat(F.lit("redirects to "), f["redirected"])).when(f["status"] == 0, "unreachable").otherwise(f["status"].cast("string"))),
    )
    signed = F.when(usable(b), b["signed"]).when(fallback, p["signed"])
    checks = [
        ("ucp-profile-unreachable", 1, False, F.when(shut, lines(F.concat(b["origin"], F.lit(": "), state), F.when(fallback, F.concat(p["origin"], F.lit(" answers instead")))))),
        ("ucp-origin-split", 2, False, F.when(shut & fallback, lines(F.concat(b["origin"], F.lit(" points to "), p["origin"])))),
        ("ucp-agent-files-missing", 2, False, lacking),
        ("ucp-signing-keys-absent", 3, True, F.when(~signed, lines(F.lit("no signing keys")))),
    ]
    kind = "array<string>"
    told = F.array(*(F.struct(F.lit(c).alias("check_id"), F.lit(n).alias("priority"), F.lit(limit).alias("platform_limit"), F.coalesce(e, F.array().cast(kind)).alias("evidence")) for c, n, limit, e in checks))
    return sites.select("site", F.explode(F.filter(told, lambda x: F.size(x["evidence"]) > 0)).alias("c")).select("site", "c.*")

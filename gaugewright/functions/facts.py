"""Facts that checks and criteria read from pages: images, structured data, links out and text for matching.

Structured data arrives as the node array of ``html.json_ld``; a node's fields are read as VARIANT values, so that text,
numbers, lists and objects are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import html as H
from . import urls
from .text import fold, html_text
from .urls import host, resolve, same_site

#: Kinds of content that are served at page-like addresses but are not read as pages.
NOT_PAGES = ["calendar", "rss", "atom", "json", "csv", "pdf", "zip", "octet-stream"]
#: Properties that hold a trade item number.
ITEM_NUMBERS = ["gtin", "gtin8", "gtin12", "gtin13", "gtin14"]
#: Hosts of social profiles.
SOCIAL = r"^((m\.)?youtube\.com|youtu\.be|tiktok\.com|instagram\.com|facebook\.com|fb\.watch|twitter\.com|x\.com|pinterest\.[a-z.]+|linkedin\.com|vimeo\.com)$"


def attribute(tag: Column, name: str) -> Column:
    """Value of a quoted attribute of a tag, null where the tag lacks it."""
    pattern = f"(?is)\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)')"
    return F.when(F.regexp_like(tag, F.lit(pattern)), F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2)))


def images(page: Column) -> Column:
    """Array of (src, alt) of a page's images with a source; alt is null where the attribute is absent."""
    tags = F.regexp_extract_all(page, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    return F.filter(F.transform(tags, lambda t: F.struct(attribute(t, "src").alias("src"), attribute(t, "alt").alias("alt"))), lambda i: i["src"].isNotNull())


def image_base(src: Column) -> Column:
    """File name of an image without query and size suffix, lower case."""
    name = F.substring_index(F.split(src, "\\?")[0], "/", -1)
    return F.lower(F.regexp_replace(name, r"(?i)_\d+x(\d+)?(?=\.[a-z0-9]+$)", ""))


def product_images(found: Column, named: Column, store: str = r"(?i)cdn\.shopify\.com/s/files/|/cdn/shop/") -> Column:
    """The images whose base names are among ``named``; else those of the store's own servers; else all."""
    bases = F.transform(named, image_base)
    own = F.filter(found, lambda i: F.array_contains(bases, image_base(i["src"])))
    served = F.filter(found, lambda i: F.regexp_like(i["src"], F.lit(store)))
    return F.when(F.size(own) > 0, own).when(F.size(served) > 0, served).otherwise(found)


def is_document(content_type: Column) -> Column:
    """A page to be read: only a stated kind from the list above excludes it."""
    return F.coalesce(~F.regexp_like(F.lower(content_type), F.lit("|".join(NOT_PAGES))), F.lit(True))


def redirect_stub(url: Column, canonical: Column, first_headings: Column, words: Column, most: int = 50) -> Column:
    """A page that only leads elsewhere: canonical on another site, no first heading, few words."""
    return F.coalesce((first_headings == 0) & (words < most) & ~same_site(resolve(canonical, url), url), F.lit(False)) & canonical.isNotNull()


def first_node(nodes: Column, *kinds: str) -> Column:
    """The first node, in document order, of one of the types, as a VARIANT."""
    wanted = F.array(*map(F.lit, kinds))
    return F.try_parse_json(F.get(F.filter(nodes, lambda n: F.arrays_overlap(n["types"], wanted)), F.lit(0))["node"])


def has_type(nodes: Column, *kinds: str) -> Column:
    wanted = F.array(*map(F.lit, kinds))
    return F.exists(nodes, lambda n: F.arrays_overlap(n["types"], wanted))


def kind_of(node: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(node, path, "variant")), F.lit("VOID"))


def says(node: Column, path: str) -> Column:
    """Is a field text that is not blank?"""
    return (kind_of(node, path) == "STRING") & F.coalesce(F.trim(F.try_variant_get(node, path, "string")) != "", F.lit(False))


def is_number(node: Column, path: str) -> Column:
    return F.regexp_like(kind_of(node, path), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))


def lists_text(node: Column, path: str) -> Column:
    """Is a field a list with a text that is not blank?"""
    held = F.try_variant_get(node, path, "array<variant>")
    return F.coalesce(F.exists(held, lambda x: (F.schema_of_variant(x) == "STRING") & (F.trim(F.try_variant_get(x, "$", "string")) != "")), F.lit(False))


#: The nodes that facts are read from: the first of these types on a page.
NODES = {"item": ["Product"], "offer": ["Offer", "AggregateOffer"], "maker": ["Organization"], "film": ["VideoObject"], "trail": ["BreadcrumbList"], "answers": ["FAQPage"]}


def with_nodes(pages, html: str = "html", every: bool = False):
    """pages with ``nodes`` and a column for each of NODES, so that a page is parsed once however many facts are read; ``every`` keeps the JSON of nodes of all types."""
    held = pages.withColumn("nodes", H.json_ld(F.col(html), None if every else [k for kinds in NODES.values() for k in kinds]))
    return held.select("*", *(first_node(F.col("nodes"), *kinds).alias(name) for name, kinds in NODES.items()))


def product(item: Column, offer: Column) -> Column:
    """What a page's product says of itself and of its offer; null without a product."""
    number = F.lit(False)
    for key in ITEM_NUMBERS:
        number = number | (says(item, f"$.{key}") & F.regexp_like(F.trim(F.coalesce(F.try_variant_get(item, f"$.{key}", "string"), F.lit(""))), F.lit(r"^(\d{8}|\d{12,14})$")))
    return F.when(
        item.isNotNull(),
        F.struct(
            offer.isNotNull().alias("offers"),
            (is_number(offer, "$.price") | says(offer, "$.price")).alias("price"),
            says(offer, "$.priceCurrency").alias("currency"),
            says(offer, "$.availability").alias("availability"),
            number.alias("gtin"),
            (says(item, "$.brand") | says(item, "$.brand.name")).alias("brand"),
            says(item, "$.mpn").alias("mpn"),
            says(item, "$.sku").alias("sku"),
        ),
    )


def organization(node: Column) -> Column:
    """Name, logo and profiles of an organization; null without one."""
    return F.when(node.isNotNull(), F.struct(says(node, "$.name").alias("name"), (says(node, "$.logo") | says(node, "$.logo.url")).alias("logo"), lists_text(node, "$.sameAs").alias("same_as")))


def video(node: Column) -> Column:
    """Name, thumbnail and address of a video; null without one."""
    shown = says(node, "$.thumbnailUrl") | lists_text(node, "$.thumbnailUrl")
    return F.when(node.isNotNull(), F.struct(says(node, "$.name").alias("name"), shown.alias("thumbnail"), (says(node, "$.contentUrl") | says(node, "$.embedUrl")).alias("url")))


def trail_items(trail: Column) -> Column:
    """Array of (at, named, url) of a breadcrumb list's items."""
    held = F.coalesce(F.try_variant_get(trail, "$.itemListElement", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(
        F.filter(held, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))),
        lambda x: F.struct(
            F.try_variant_get(x, "$.position", "double").alias("at"),
            says(x, "$.name").alias("named"),
            F.coalesce(F.when(says(x, "$.item"), F.try_variant_get(x, "$.item", "string")), F.when(says(x, "$.item['@id']"), F.try_variant_get(x, "$.item['@id']", "string"))).alias("url"),
        ),
    )


def breadcrumb_score(items: Column) -> Column:
    """0 without two items or with positions missing or repeated, 50 with an item unnamed or unlinked or no category, else 100."""
    n, at = F.size(items), F.transform(items, lambda i: i["at"])
    placed = F.forall(at, lambda x: x.isNotNull()) & (F.size(F.array_distinct(at)) == n)
    whole = F.forall(items, lambda i: i["named"] & i["url"].isNotNull())
    ends = F.regexp_like(F.coalesce(F.get(items, F.lit(0))["url"], F.lit("")), F.lit("(?i)/collections/")) | F.regexp_like(F.coalesce(F.get(items, n - 1)["url"], F.lit("")), F.lit("(?i)/collections/"))
    return F.when((n < 2) | ~placed, 0).when(~whole | ~((n > 2) | ends), 50).otherwise(100)


def faq(node: Column, cap: int = 4000) -> Column:
    """Array of (question, answer) of an FAQ node; pairs with an empty side are left out."""
    many = F.try_variant_get(node, "$.mainEntity", "array<variant>")
    one = F.array(F.try_variant_get(node, "$.mainEntity", "variant"))
    asked = F.when(F.startswith(kind_of(node, "$.mainEntity"), F.lit("ARRAY")), many).when(F.startswith(kind_of(node, "$.mainEntity"), F.lit("OBJECT")), one)
    text = lambda q, path: F.when(kind_of(q, path) == "STRING", F.try_variant_get(q, path, "string")).otherwise("")
    pairs = F.transform(asked, lambda q: F.struct(F.trim(text(q, "$.name")).alias("question"), html_text(text(q, "$.acceptedAnswer.text"), cap).alias("answer")))
    return F.coalesce(F.filter(pairs, lambda p: (p["question"] != "") & (p["answer"] != "")), F.array().cast("array<struct<question string, answer string>>"))


def haystack(page: Column) -> Column:
    """Text that a reader without scripts finds: body text and structured data, lower case, single blanks."""
    kept = F.regexp_replace(page, r"(?is)<script\b[^>]*type\s*=\s*[\"']?application/ld\+json[^>]*>(.*?)</script>", " $1 ")
    return F.lower(F.trim(F.regexp_replace(html_text(F.regexp_replace(kept, r"(?is)<script\b[^>]*>.*?</script>", " "), 1 << 30), "\\s+", " ")))


def faq_redundant(pairs: Column, page: Column, share: float = 0.8) -> Column:
    """Does the page itself hold that share of the questions?"""
    asked = F.transform(pairs, lambda p: F.lower(F.trim(F.regexp_replace(p["question"], "\\s+", " "))))
    held = F.size(F.filter(asked, lambda q: F.contains(page, q)))
    return (F.size(asked) > 0) & (page != "") & (held >= share * F.size(asked))


def social_profiles(page: Column) -> Column:
    """Distinct profiles (host and path, lower case) that a page links; bare hosts are none."""
    links = F.regexp_extract_all(page, F.lit("(?i)href=[\"']([^\"']+)[\"']"), F.lit(1))
    shown = F.transform(links, lambda u: F.struct(host(u).alias("host"), F.regexp_replace(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/+$", "").alias("path")))
    kept = F.filter(shown, lambda u: F.coalesce(F.regexp_like(u["host"], F.lit(SOCIAL)), F.lit(False)) & (u["path"] != ""))
    return F.array_distinct(F.transform(kept, lambda u: F.lower(F.concat(u["host"], u["path"]))))


def links_about(page: Column, url: Column, word: str, but: str | None = None) -> Column:
    """Distinct paths, lower case, of the links whose path holds ``word`` and not ``but``."""
    links = F.regexp_extract_all(page, F.lit("(?i)href=[\"']([^\"']+)[\"']"), F.lit(1))
    paths = F.transform(links, lambda u: F.lower(F.coalesce(F.try_parse_url(resolve(u, url), F.lit("PATH")), F.lit(""))))
    return F.array_distinct(F.filter(paths, lambda p: F.contains(p, F.lit(word)) & (~F.contains(p, F.lit(but)) if but else F.lit(True))))


#: Words of shop names that tell nothing.
GENERIC_NAMES = ["store", "shop", "shops", "official", "online", "market", "the", "com"]


def brand_key(name: Column) -> Column:
    """The longest telling word of a shop's name, the first of equals; empty without one."""
    words = F.filter(F.split(fold(name), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*GENERIC_NAMES))
    return F.coalesce(F.reduce(words, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best)), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def page_table(pages):
    """pages(url, html, ...) with every fact that site checks read, and without the HTML and the nodes."""
    c = F.col
    read = with_nodes(H.page_facts(pages)).withColumn("levels", H.heading_levels(c("html")))
    firsts = F.size(F.filter("levels", lambda x: x == 1))
    kept = [x for x in pages.columns if x != "html"]
    return read.select(
        *kept,
        "title",
        "word_count",
        "canonical",
        "levels",
        images(c("html")).alias("images"),
        product(c("item"), c("offer")).alias("product"),
        organization(c("maker")).alias("organization"),
        video(c("film")).alias("video"),
        F.array_distinct(F.flatten(F.transform("nodes", lambda n: n["types"]))).alias("types"),
        H.meta(c("html"), "robots").alias("robots"),
        urls.links(c("html")).alias("links"),
        firsts.alias("first_headings"),
        redirect_stub(c("url"), c("canonical"), firsts, c("word_count")).alias("stub"),
    )

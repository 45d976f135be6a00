"""Page criteria as columns: facts of an audited page -> (key, status, score) rows for the weighted score.

Facts that were not measured are null and give ``na``; what was measured and is absent scores 0.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts, html, text
from ..sources.sitemap import robots_rules
from .judgements import blocked_from_shop


def _three(none: Column, full: Column) -> Column:
    """0 where there is nothing, 100 where it is whole, else 50."""
    return F.when(none, 0).when(F.coalesce(full, F.lit(False)), 100).otherwise(50)


def scores() -> dict[str, Column]:
    """Score of each criterion by an audit's facts; null where it cannot be measured."""
    c = F.col
    return {
        "ai-bots-allowed": F.when(c("search_blocked") | c("noindex"), 25).when(c("assistant_blocked"), 75).otherwise(100),
        "google-merchant-feed": F.when(c("in_feed"), 100).when(~c("in_feed"), 0),
        "internal-linking": F.when(~c("reachable"), 0).when(~c("related_links"), 50).otherwise(100),
        "crawlable-text": F.when(c("token_coverage") >= 0.9, 100).when(c("token_coverage") >= 0.5, 50).when(c("token_coverage").isNotNull(), 0),
        "image-alt-text": F.when(c("images") > 0, F.round(100 * c("images_with_alt") / c("images"))),
        "heading-hierarchy": F.when(c("h1_count") != 1, 0).when((c("name_match") >= 0.8) & ~c("skips_level"), 100).otherwise(50),
        "brand-in-title": F.when(c("brand_in_title"), 100).when(~c("brand_in_title"), 0),
        "product-schema": F.when(~c("has_product"), 0).when(~c("has_offer"), 50).otherwise(_three(F.lit(False), c("has_price") & c("has_currency") & c("has_availability"))),
        "product-schema-rich": F.when(c("valid_gtin") | (c("has_brand") & c("has_mpn")), 100).when(c("has_brand") | c("has_mpn") | c("has_sku"), 50).otherwise(0),
        "review-schema": F.when(~c("has_review") & c("rating").isNull(), 0).otherwise(_three(F.lit(False), c("rating").between(F.coalesce("worst", F.lit(0)), F.coalesce("best", F.lit(5))) & c("rating_count").isNotNull())),
        "shipping-schema": _three(~c("has_shipping"), c("has_rate") & c("has_destination") & c("has_time")),
        "faq-schema": _three(~c("has_faq"), c("valid_questions") > 0),
        "organization-schema": _three(~c("has_organization"), c("has_org_name") & c("has_logo") & c("has_same_as")),
        "video-schema": F.when(~c("has_video") & c("video_embed"), 0).when(c("has_video"), _three(F.lit(False), c("video_fields") >= 5)),
        "original-media": F.when(c("own_images") >= 4, 50).otherwise(0) + F.when(c("own_video"), 25).otherwise(0),
        "freshness": F.when(c("shown_date").isNull() & ~c("date_text"), 0).when(F.datediff(c("as_of"), c("shown_date")) <= 180, 100).otherwise(50),
        "entity-databases": F.when(c("panel") | c("encyclopedia"), 100).when(c("data_entry"), 50).when(F.coalesce("panel", "encyclopedia", "data_entry").isNotNull(), 0),
        "shipping-competitive": F.when(c("shipping_band") == "na", 0).otherwise(c("shipping_band").try_cast("int")),
    }


#: All criteria that ``scores`` decides, and those that no page does.
KEYS = (
    "ai-bots-allowed", "google-merchant-feed", "internal-linking", "crawlable-text", "image-alt-text", "heading-hierarchy", "brand-in-title", "product-schema", "product-schema-rich", "review-schema", "shipping-schema", "faq-schema",
    "organization-schema", "video-schema", "original-media", "freshness", "entity-databases", "shipping-competitive",
)
OFF_PAGE = ("entity-databases", "google-merchant-feed", "shipping-competitive")
#: Phrases over related products, words before a date of change, and what shows an embedded film.
RELATED = ("related products", "you may also like", "recommend", "complete the look", "pair well with", "pairs well with")
CHANGED = ("updated", "c\u1eadp nh\u1eadt", "last modified", "as of")
FILMS = ("youtube.com/embed", "youtu.be/", "player.vimeo.com")
#: Begins and ends of alternative texts that are file names.
FILE_NAME = r"(?i)^(img[_-]|dsc[_-]?\d)|\.(jpe?g|png|gif|webp|svg|bmp|avif)$"


def good_alts(found: Column, least_words: int = 4, most: int = 125) -> Column:
    """How many images have an alternative text of their own: some words, no file name, not too long, not that of another image."""
    texts = F.transform(found, lambda i: F.trim(F.coalesce(i["alt"], F.lit(""))))
    both = F.transform(texts, lambda x: F.struct(x.alias("text"), text.normalize(x).alias("plain")))
    plain = F.transform(both, lambda x: x["plain"])
    good = lambda x: (x != "") & ~F.regexp_like(x, F.lit(FILE_NAME)) & (F.size(F.split(x, "\\s+")) >= least_words) & (F.char_length(x) <= most)
    return F.size(F.filter(both, lambda x: good(x["text"]) & (F.size(F.array_remove(plain, x["plain"])) >= F.size(plain) - 1)))


def name_share(heading: Column, name: Column) -> Column:
    """Share of a name's words that a heading has; 1 where it holds the name as it stands, 0 without words on either side."""
    h, n = text.normalize(heading), text.tokens(name)
    words = F.split(h, " ")
    share = F.size(F.filter(n, lambda w: F.array_contains(words, w))) / F.size(n)
    return F.when((F.size(n) == 0) | (h == ""), 0.0).when(F.contains(h, F.array_join(n, " ")), 1.0).otherwise(share)


def page_facts(pages: DataFrame) -> DataFrame:
    """pages(html, source_html, name, vendor, shop, search_blocked, assistant_blocked, ...) with the facts that ``scores`` takes from a page.

    ``html`` is the page as shown, null if it never arrived; ``source_html`` what came before scripts ran, null if nothing else
    was captured. ``name``, ``vendor`` and ``shop`` are the product's, its maker's and the shop's names. Every fact is read from the
    page's own text, tags and structured data, which are parsed once; given columns stay.
    """
    c, page = F.col, F.col("html")
    parsed = facts.with_nodes(pages, every=True)
    first = lambda *kinds: facts.first_node(c("nodes"), *kinds)
    node = lambda x, path: F.try_variant_get(x, path, "variant")
    present = lambda x, path: ~facts.kind_of(x, path).isin("VOID")
    held = lambda x, path: F.when(facts.kind_of(x, path).startswith("OBJECT"), node(x, path)).when(facts.kind_of(x, f"{path}[0]").startswith("OBJECT"), node(x, f"{path}[0]"))
    parsed = parsed.withColumns({"rated": F.coalesce(held(c("item"), "$.aggregateRating"), first("AggregateRating")), "sent": F.coalesce(held(c("offer"), "$.shippingDetails"), first("OfferShippingDetails"))})
    number = lambda x, path: text.to_number(F.when(facts.is_number(x, path) | facts.says(x, path), F.try_variant_get(x, path, "string")))
    found, levels = facts.images(page), html.heading_levels(page)
    named = F.coalesce(F.try_variant_get(c("item"), "$.image", "array<string>"), F.array(F.try_variant_get(c("item"), "$.image", "string")))
    named = F.filter(named, lambda x: x.isNotNull())
    own = facts.product_images(found, named)
    parsed = parsed.withColumns({f"_{n}": F.array_distinct(text.tokens(text.strip_tags(x))) for n, x in (("shown", page), ("source", c("source_html")))}).withColumn("_own", own)
    shown, source, own = c("_shown"), c("_source"), c("_own")
    brand = F.coalesce(*(F.when(facts.says(c("item"), p), F.try_variant_get(c("item"), p, "string")) for p in ("$.brand", "$.brand.name")), F.when(text.squash(c("vendor")) != text.squash(c("shop")), F.nullif(F.trim("vendor"), F.lit(""))))
    embedded = F.regexp_like(page, F.lit(r"(?i)<video\b|<iframe\b[^>]*(youtube|vimeo)|" + "|".join(x.replace(".", r"\.") for x in FILMS)))
    numbers = [F.coalesce(text.gtin_valid(F.try_variant_get(c("item"), f"$.{k}", "string")), F.lit(False)) for k in facts.ITEM_NUMBERS]
    said = F.filter("nodes", lambda n: F.contains(n["node"], F.lit('"dateModified"')))
    dated = F.get(F.filter(F.transform(said, lambda n: F.try_variant_get(F.try_parse_json(n["node"]), "$.dateModified", "string")), lambda x: x.isNotNull()), F.lit(0))
    stated = lambda x: F.nullif(F.regexp_extract(x, f"(?iu)(?:{'|'.join(CHANGED)})[^0-9]{{0,12}}(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{1,2}}/\\d{{4}}|\\d{{4}})", 1), F.lit(""))
    date = F.coalesce(dated, stated(page), stated(c("source_html")))
    questions = F.coalesce(F.try_variant_get(c("answers"), "$.mainEntity", "array<variant>"), F.array(node(c("answers"), "$.mainEntity")))
    kind = lambda q: F.coalesce(F.try_variant_get(q, "$['@type']", "array<string>"), F.array(F.try_variant_get(q, "$['@type']", "string")))
    valid = F.filter(questions, lambda q: F.array_contains(kind(q), "Question") & facts.says(q, "$.name") & facts.says(q, "$.acceptedAnswer.text"))
    served = F.array_distinct(F.transform(F.regexp_extract_all(page, F.lit("(?i)https?://[^\"'\\s]*cdn\\.shopify\\.com/[^\"'\\s]*/products/[^\"'\\s]+"), F.lit(0)), lambda u: F.split(u, "\\?")[0]))
    film = [facts.says(c("film"), "$.name"), facts.says(c("film"), "$.description"), present(c("film"), "$.thumbnailUrl"), facts.says(c("film"), "$.uploadDate"), present(c("film"), "$.contentUrl") | present(c("film"), "$.embedUrl")]
    out = {
        "received": page.isNotNull(),
        "noindex": F.coalesce(F.contains(F.lower(html.meta(page, "robots")), F.lit("noindex")), F.lit(False)),
        "reachable": F.regexp_like(page, F.lit("(?i)<nav\\b|href=[\"'][^\"']*/collections/")) | facts.has_type(c("nodes"), "BreadcrumbList"),
        "related_links": F.regexp_like(page, F.lit("(?i)href=[\"'][^\"']*/products/|" + "|".join(RELATED))),
        "token_coverage": F.when(F.size(shown) > 0, F.size(F.array_intersect(shown, source)) / F.size(shown)),
        "images": F.size(own),
        "images_with_alt": good_alts(own),
        "h1_count": F.size(F.filter(levels, lambda x: x == 1)),
        "name_match": name_share(text.strip_tags(F.regexp_extract(page, "(?is)<h1\\b[^>]*>(.*?)</h1>", 1)), c("name")),
        "skips_level": html.skips_level(levels),
        "brand_in_title": F.when(brand.isNotNull(), F.contains(text.normalize(c("name")), text.normalize(brand)) & (text.normalize(brand) != "")).when(F.coalesce(F.trim("vendor"), F.lit("")) == "", False),
        "has_product": c("item").isNotNull(),
        "has_offer": c("offer").isNotNull(),
        "has_price": number(c("offer"), "$.price").isNotNull(),
        "has_currency": facts.says(c("offer"), "$.priceCurrency"),
        "has_availability": facts.says(c("offer"), "$.availability"),
        "valid_gtin": reduce(lambda a, b: a | b, numbers),
        "has_brand": facts.says(c("item"), "$.brand") | facts.says(c("item"), "$.brand.name"),
        "has_mpn": facts.says(c("item"), "$.mpn"),
        "has_sku": facts.says(c("item"), "$.sku"),
        "has_review": present(c("item"), "$.review") | facts.has_type(c("nodes"), "Review") | c("rated").isNotNull(),
        "rating": number(c("rated"), "$.ratingValue"),
        "worst": number(c("rated"), "$.worstRating"),
        "best": number(c("rated"), "$.bestRating"),
        "rating_count": F.coalesce(number(c("rated"), "$.reviewCount"), number(c("rated"), "$.ratingCount")),
        "has_shipping": c("sent").isNotNull(),
        "has_rate": present(c("sent"), "$.shippingRate"),
        "has_destination": present(c("sent"), "$.shippingDestination"),
        "has_time": present(c("sent"), "$.deliveryTime"),
        "has_faq": c("answers").isNotNull(),
        "valid_questions": F.size(valid),
        "has_organization": c("maker").isNotNull(),
        "has_org_name": facts.says(c("maker"), "$.name"),
        "has_logo": present(c("maker"), "$.logo") | present(c("maker"), "$.image"),
        "has_same_as": facts.says(c("maker"), "$.sameAs") | facts.lists_text(c("maker"), "$.sameAs"),
        "has_video": c("film").isNotNull(),
        "video_embed": embedded,
        "video_fields": reduce(lambda a, b: a + b, (x.cast("int") for x in film)),
        "own_images": F.when(F.size(named) > 0, F.size(named)).otherwise(F.size(served)),
        "own_video": c("film").isNotNull() | F.regexp_like(page, F.lit("(?i)<iframe[^>]+(youtube|vimeo|youtu\\.be)")),
        "shown_date": text.loose_date(date),
        "date_text": date.isNotNull(),
    }
    return parsed.select(*pages.columns, *(x.alias(n) for n, x in out.items()))


#: Agents of the search engine, and of the assistant, whose being shut out counts.
SEARCH_AGENTS, ASSISTANT_AGENTS = ("googlebot",), ("oai-searchbot", "chatgpt-user")


def blocked_agents(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """sites(site, ...) with search_blocked and assistant_blocked by robots(site, body), their robots files.

    A site without a file, or with a null or empty one, blocks nobody; an assistant is blocked if any of its agents is.
    """
    rules = robots_rules(robots.where("body is not null"))
    shut = None
    for agent in (*SEARCH_AGENTS, *ASSISTANT_AGENTS):
        one = blocked_from_shop(rules, agent).where("blocked").select("site", F.lit(agent).alias("agent"))
        shut = one if shut is None else shut.unionByName(one)
    name = F.when(F.col("agent").isin(*SEARCH_AGENTS), "search_blocked").otherwise("assistant_blocked")
    flags = shut.groupBy("site").agg(*(F.bool_or(name == x).alias(x) for x in ("search_blocked", "assistant_blocked")))
    return sites.join(flags, "site", "left").fillna(False, ["search_blocked", "assistant_blocked"])


def off_page_facts(audits: DataFrame, collected: str, analysis: str) -> DataFrame:
    """audits with the facts of OFF_PAGE: from what was collected off the page and from the analysis, both JSON texts or null.

    What was not collected stays null, so it is not measured; a collected answer that does not say yes says no. A stated band that is
    no band measures nothing, while the answer na scores 0.
    """
    held = lambda group: F.get_json_object(collected, f"$.{group}").isNotNull()
    says = lambda group, name: F.when(held(group), F.coalesce(F.get_json_object(collected, f"$.{group}.{name}") == "true", F.lit(False)))
    known = "entityDatabases"
    stated = F.get_json_object(analysis, "$['shipping-competitive'].band")
    return audits.withColumns({
        "in_feed": says("googleMerchantFeed", "onGoogleShopping"), "panel": says(known, "hasKnowledgePanel"), "encyclopedia": says(known, "hasWikipedia"), "data_entry": says(known, "hasWikidata") | says(known, "hasCrunchbase"),
        "shipping_band": F.when(stated.isin("0", "50", "100", "na"), stated),
    })


def measured(facts: DataFrame, audit: str = "audit", leave: Collection[str] = ()) -> DataFrame:
    """facts (one row per audit, and ``received``) -> (audit, key, status, score). A page that never arrived measures nothing on it; criteria in ``leave`` are left out."""
    cells = []
    for key, score in scores().items():
        if key in leave:
            continue
        value = (score if key in OFF_PAGE else F.when(F.col("received"), score)).cast("double")
        cells.append(F.struct(F.lit(key).alias("key"), F.when(value.isNull(), "na").otherwise("scored").alias("status"), value.alias("score")))
    return facts.select(audit, F.explode(F.array(*cells)).alias("c")).select(audit, "c.*")

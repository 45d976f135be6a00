"""Answer grids, log breakers and page criteria."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers, criteria
from .registry import query, read


@query("""SELECT event_type AS cell, url, event_id FROM (SELECT *, 'u' || user_id AS url, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS r FROM events) WHERE r = 1""")
def f45_distinct_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").selectExpr("event_type as cell", "concat('u', user_id) as url", "event_id")
    return answers.distinct_citations(rows, "cell", "url", "event_id")


@query(r"""WITH p AS (SELECT page_id, url, page_id % 10 AS cell, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS domain FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY cell, domain ORDER BY page_id) AS k FROM p)
SELECT cell, domain, arg_min('title ' || page_id, page_id) AS title, string_agg(url, ' ' ORDER BY page_id) FILTER (k <= 3) AS urls, min(page_id) AS first FROM r GROUP BY 1, 2""")
def a22_citations_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").selectExpr("page_id % 10 as cell", "url", "concat('title ', page_id) as title", "page_id")
    return answers.citations_by_domain(rows, "cell", "url", "title", "page_id")


FOUND = """f AS (SELECT l_orderkey AS cell, 'shop ' || l_suppkey AS name, CASE WHEN l_linenumber % 4 <> 3 THEN l_linenumber END AS position, l_suppkey % 10 = 0 AS is_target FROM lineitem)"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as cell", "concat('shop ', l_suppkey) as name", "if(l_linenumber % 4 <> 3, l_linenumber, null) as position", "l_suppkey % 10 = 0 as is_target")


@query(f"""WITH {FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY position NULLS LAST, name) AS k FROM f)
SELECT cell, count(*) AS named, bool_or(is_target) AS has_target, min(CASE WHEN is_target THEN position END) AS target_position, string_agg(CASE WHEN k <= 3 THEN name END, ', ' ORDER BY k) AS first_three FROM r GROUP BY 1""")
def a25_cell_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.cell_verdict(found(spark, sf_dir), "cell")


@query(f"""WITH {FOUND}, g AS (SELECT cell, count(*) FILTER (is_target) AS targets, coalesce(count(*) = count(DISTINCT position) AND min(position) = 1 AND max(position) = count(*), false) AS even FROM f GROUP BY 1)
SELECT cell, 'MULTIPLE_TARGETS' AS code FROM g WHERE targets > 1 UNION ALL SELECT cell, 'BAD_POSITIONS' FROM g WHERE NOT even""")
def a27_gate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.gate_codes(found(spark, sf_dir), "cell")


#: DuckDB twin of folding to letters and digits, for names of letters that strip_accents knows.
FUZZ = r"regexp_replace(replace(strip_accents(lower({})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]', '', 'g')"


@query(f"""WITH d AS (SELECT a.doc_id, {FUZZ.format("a.text")} AS said, {FUZZ.format("split_part(b.text, ' ', 2) || ' ' || split_part(b.text, ' ', 3)")} AS name FROM documents a JOIN documents b ON b.doc_id = a.doc_id // 2)
SELECT doc_id, length(name) >= 3 AND contains(said, name) AS supported FROM d""")
def r13_supported_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a text bear out a name that another document gives?"""
    docs = read(spark, sf_dir, "documents")
    name = F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(2)), F.split_part("text", F.lit(" "), F.lit(3)))
    met = docs.withColumn("half", F.expr("doc_id div 2")).join(docs.select(F.col("doc_id").alias("half"), name.alias("name")), "half")
    none = F.lit(None).cast("string")
    return met.select("doc_id", answers.supported(F.col("name"), none, none, F.col("text"), F.array().cast("array<string>")).alias("supported"))


@query("""WITH s AS (SELECT *, event_type <> 'view' AS failed, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events), r AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id) AS k FROM s)
SELECT user_id, min(event_id) AS opened_at FROM r WHERE k = 10 GROUP BY 1""")
def w05_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_type <> 'view' as failed")
    return answers.breaker(log, "user_id", "event_id", "failed")


FACTS = {
    "search_blocked": "x % 9 = 0", "noindex": "x % 8 = 0", "assistant_blocked": "x % 7 = 0", "in_feed": "case when x % 3 = 0 then x % 2 = 0 end", "reachable": "x % 11 <> 0", "related_links": "x % 2 = 0", "token_coverage": "case when x % 6 <> 0 then (x % 21) / 20.0 end",
    "images": "x % 6", "images_with_alt": "least(x % 6, x % 4)", "h1_count": "1 + x % 2", "name_match": "(x % 11) / 10.0", "skips_level": "x % 5 = 0", "brand_in_title": "x % 4 = 0", "has_product": "x % 5 <> 0", "has_offer": "x % 3 <> 0",
    "has_price": "true", "has_currency": "x % 2 = 0", "has_availability": "x % 7 <> 0", "valid_gtin": "x % 5 = 1", "has_brand": "x % 3 = 1", "has_mpn": "x % 4 = 1", "has_sku": "x % 2 = 1", "has_review": "x % 4 = 2", "rating": "case when x % 4 > 1 then x % 7 end",
    "worst": "case when x % 2 = 0 then 1 end", "best": "case when x % 3 = 0 then 10 end", "rating_count": "case when x % 3 > 0 then x % 3 - 1 end", "has_shipping": "x % 3 = 0", "has_rate": "true", "has_destination": "x % 2 = 0", "has_time": "x % 4 <> 0", "has_faq": "x % 5 > 1", "valid_questions": "x % 3",
    "has_organization": "x % 6 <> 0", "has_org_name": "true", "has_logo": "x % 2 = 1", "has_same_as": "x % 3 = 1", "has_video": "x % 10 = 0", "video_embed": "x % 4 = 0", "video_fields": "x % 7", "own_images": "x % 6", "own_video": "x % 4 = 0", "date_text": "x % 13 = 0", "panel": "x % 17 = 0", "encyclopedia": "x % 19 = 0", "data_entry": "x % 5 = 0",
    "shipping_band": "case x % 5 when 0 then 'na' when 1 then '0' when 2 then '50' when 3 then '100' end", "received": "x % 23 <> 0",
}
#: The same rules, written for the oracle.
RULES = """case when search_blocked or noindex then 25 when assistant_blocked then 75 else 100 end|ai-bots-allowed
case when in_feed then 100 when not in_feed then 0 end|google-merchant-feed
case when not reachable then 0 when not related_links then 50 else 100 end|internal-linking
case when token_coverage is null then null when token_coverage >= 0.9 then 100 when token_coverage >= 0.5 then 50 else 0 end|crawlable-text
case when images > 0 then round(100.0 * images_with_alt / images) end|image-alt-text
case when h1_count <> 1 then 0 when name_match >= 0.8 and not skips_level then 100 else 50 end|heading-hierarchy
case when brand_in_title then 100 else 0 end|brand-in-title
case when not has_product then 0 when has_offer and has_price and has_currency and has_availability then 100 else 50 end|product-schema
case when valid_gtin or (has_brand and has_mpn) then 100 when has_brand or has_mpn or has_sku then 50 else 0 end|product-schema-rich
case when not has_review and rating is null then 0 when rating between coalesce(worst, 0) and coalesce(best, 5) and rating_count is not null then 100 else 50 end|review-schema
case when not has_shipping then 0 when has_rate and has_destination and has_time then 100 else 50 end|shipping-schema
case when not has_faq then 0 when valid_questions > 0 then 100 else 50 end|faq-schema
case when not has_organization then 0 when has_org_name and has_logo and has_same_as then 100 else 50 end|organization-schema
case when has_video then case when video_fields >= 5 then 100 else 50 end when video_embed then 0 end|video-schema
case when own_images >= 4 then 50 else 0 end + case when own_video then 25 else 0 end|original-media
case when shown_date is null and not date_text then 0 when shown_date is not null and date_diff('day', shown_date, date '2000-01-01') <= 180 then 100 else 50 end|freshness
case when panel or encyclopedia then 100 when data_entry then 50 else 0 end|entity-databases
case when shipping_band = 'na' then 0 else try_cast(shipping_band as integer) end|shipping-competitive"""
SHOWN = "case when x % 3 <> 0 then cast(o_orderdate as date) end"


def _union() -> str:
    cells = []
    for line in RULES.split("\n"):
        rule, key = line.split("|")
        value = rule if key in ("entity-databases", "google-merchant-feed", "shipping-competitive") else f"case when received then {rule} end"
        cells.append(f"SELECT audit, '{key}' AS key, CAST({value} AS DOUBLE) AS score FROM facts")
    return " UNION ALL ".join(cells)


@query(f"""WITH o AS (SELECT o_orderkey AS x, o_orderdate FROM orders), facts AS (SELECT x AS audit, {SHOWN} AS shown_date, {', '.join(f'{e} AS {n}' for n, e in FACTS.items())} FROM o), u AS ({_union()})
SELECT audit, key, CASE WHEN score IS NULL THEN 'na' ELSE 'scored' END AS status, score FROM u""")
def c01_c40_page_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey as x", "o_orderdate")
    facts = rows.selectExpr("x as audit", f"{SHOWN} as shown_date", "date '2000-01-01' as as_of", *(f"{e} as {n}" for n, e in FACTS.items()))
    return criteria.measured(facts)

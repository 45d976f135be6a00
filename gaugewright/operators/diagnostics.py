"""Site diagnostics: templates, log lines, images, frequencies and the readiness verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Body classes that stand for a template, by template; the first template with a class of the page decides.
TEMPLATE_CLASSES = {
    "checkout": ["woocommerce-checkout"], "cart": ["woocommerce-cart"], "account": ["woocommerce-account"], "product": ["single-product"], "product-list": ["post-type-archive-product", "tax-product_cat", "woocommerce-shop"],
    "search": ["search", "search-results", "search-no-results"], "404": ["error404"], "blog-list": ["home"], "archive": ["archive"], "post": ["single-post", "single"], "front-page": ["front-page"],
}


def template(body_class: Column, path: Column) -> Column:
    """Template of a page by the set of its body's classes; the root is the front page."""
    classes = F.split(F.trim(F.lower(body_class)), "\\s+")
    out = F.when(path == "/", F.lit("front-page"))
    for name, marks in TEMPLATE_CLASSES.items():
        out = out.when(F.arrays_overlap(classes, F.array(*map(F.lit, marks))), name)
    own = F.exists(classes, lambda c: F.startswith(c, F.lit("page-template-")) & (c != "page-template-default"))
    return out.when(own, "custom-template").when(F.array_contains(classes, "page"), "page").otherwise("unknown")


def doctype_mode(html: Column) -> Column:
    """strict, quirks or almost-strict rendering, by the document type."""
    kind = F.lower(F.regexp_extract(html, "(?is)\\A\\s*(<!doctype[^>]*>)", 1))
    return F.when(kind == "", "quirks").when(kind == "<!doctype html>", "strict").when(F.contains(kind, F.lit("transitional")), "almost-strict").otherwise("strict")


def error_lines(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """(ident, line, file, at) of PHP errors shown in a page, each line once."""
    text = F.regexp_replace(F.regexp_replace(html, "(?i)<br\\s*/?>", "\n"), "<[^>]*>", "")
    lines = pages.select(ident, F.explode(F.split(text, "\n")).alias("line")).select(ident, F.trim("line").alias("line"))
    shown = lines.where(F.col("line").rlike("(?i)\\b(fatal error|parse error|warning|notice|deprecated)\\b.*\\.php")).distinct()
    at = lambda k: F.nullif(F.coalesce(F.nullif(F.regexp_extract("line", " in (\\S+\\.php) on line (\\d+)", k), F.lit("")), F.regexp_extract("line", "(\\S+\\.php):(\\d+)", k)), F.lit(""))
    return shown.select(ident, "line", at(1).alias("file"), at(2).try_cast("int").alias("at"))


def log_error(line: Column, kinds: tuple[str, ...] = ("EMERGENCY", "ALERT", "CRITICAL", "ERROR")) -> Column:
    """A log line counts as an error by its priority column, and where it has none."""
    priority = F.get(F.split(line, "\t"), F.lit(1))
    return priority.isNull() | F.upper(priority).isin(*kinds)


def misfit(width: Column, height: Column, least_width: Column, ratio: Column) -> Column:
    """Why an image does not fit its slot: too narrow, or a ratio more than a quarter off; null if it fits."""
    narrow = F.when(width < least_width, "narrow")
    shape = F.when(F.abs(width / height - ratio) / ratio > 0.25, "ratio")
    return F.nullif(F.concat_ws("+", narrow, shape), F.lit(""))


def frequencies(rows: DataFrame, words: Column, most: int = 30) -> DataFrame:
    """The most frequent tokens, in order of number and then name."""
    return rows.select(F.explode(words).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(most)


def columns_of(boxes: DataFrame, page: str, container: str, top: str, row: float = 24.0) -> DataFrame:
    """Most boxes that stand in one row, over the containers of a page."""
    rows = boxes.groupBy(page, container, F.round(F.col(top) / row).alias("_row")).agg(F.count("*").alias("_n"))
    return rows.groupBy(page).agg(F.max("_n").alias("columns"))


def carried_share(reference: DataFrame, own: DataFrame, site: str, reach: int = 3 * 40 * 40) -> DataFrame:
    """reference(site, r, g, b, share), own(site, r, g, b): weighted share of reference colours near some own colour."""
    theirs = own.select(site, F.struct("r", "g", "b").alias("c")).groupBy(site).agg(F.collect_set("c").alias("_own"))  # a palette has few colours
    near = F.exists("_own", lambda c: (c["r"] - F.col("r")) * (c["r"] - F.col("r")) + (c["g"] - F.col("g")) * (c["g"] - F.col("g")) + (c["b"] - F.col("b")) * (c["b"] - F.col("b")) <= reach)
    joined = reference.join(theirs, site, "left")
    return joined.groupBy(site).agg((F.sum(F.when(F.coalesce(near, F.lit(False)), F.col("share")).otherwise(0)) / F.sum("share")).alias("carried"))


def readiness(products: DataFrame, site: str) -> DataFrame:
    """products(site, status, hops, major): level of a site, from what blocks it, how many upgrades are ahead, and whether anything was read.

    A site already on the target is ready unless something it runs is discontinued. Many upgrades or nothing read can only
    lower a ready site to work needed.
    """
    c = F.col
    per = products.groupBy(site).agg(
        F.count("status").alias("read"), F.count_if(c("status") == "discontinued").alias("gone"), F.count_if(c("status").isin("none", "unknown")).alias("blocking"), F.max("hops").alias("hops"), F.max("major").alias("major")
    )
    staged = F.coalesce(c("hops") > 1, c("major") < 5, F.lit(False))
    level = (
        F.when((c("major") >= 6) & (c("gone") == 0), "already_there")
        .when(c("gone") > 0, "must_replace")
        .when((c("blocking") > 0) | staged | (c("read") == 0), "work_needed")
        .otherwise("ready")
    )
    return per.select(site, level.alias("level"), "read", "gone", "blocking")


def compare_versions(wanted: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """wanted and own (keys, version, enabled): what is missing, disabled or older than wanted."""
    from ..functions.versions import parts

    a, b = wanted.select(*keys, F.col("version").alias("wanted")), own.select(*keys, "version", "enabled", F.lit(True).alias("_has"))
    state = F.when(F.col("_has").isNull(), "missing").when(~F.col("enabled"), "disabled").when(parts(F.col("version")) < parts(F.col("wanted")), "older")
    return a.join(b, keys, "left").withColumn("state", state).where("state is not null").select(*keys, "wanted", "version", "state")

"""Sitemaps and robots files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored


def entries(documents: DataFrame, xml: str) -> DataFrame:
    """documents with (loc, lastmod) of every urlset entry; empty locations are dropped, malformed documents give none.

    Entries are cut by pattern, so one bad document cannot fail the job as an XML parser would.
    """
    blocks = F.regexp_extract_all(xml, F.lit("(?is)<url\\b[^>]*>(.*?)</url>"), F.lit(1))
    rows = documents.withColumn("_block", F.explode(blocks))
    loc = F.replace(F.trim(F.regexp_extract("_block", "(?is)<loc\\b[^>]*>(.*?)</loc>", 1)), F.lit("&amp;"), F.lit("&"))
    lastmod = F.nullif(F.trim(F.regexp_extract("_block", "(?is)<lastmod\\b[^>]*>(.*?)</lastmod>", 1)), F.lit(""))
    return rows.withColumn("loc", loc).withColumn("lastmod", lastmod).where("loc <> ''").drop("_block", xml)


def first_sitemap(candidates: DataFrame) -> DataFrame:
    """candidates(site, priority, pos, loc, lastmod): the entries of each site's first candidate that has any, first of equal urls."""
    best = candidates.groupBy("site").agg(F.min("priority").alias("priority"))
    kept = candidates.join(best, ["site", "priority"])
    return kept.groupBy("site", "loc").agg(F.min_by("lastmod", "pos").alias("lastmod"), F.min("pos").alias("pos"))


def robots_rules(files: DataFrame) -> DataFrame:
    """files(site, body) -> (site, agent, kind, path): consecutive agent lines share the rules that follow."""
    lines = files.select("site", F.posexplode(F.split("body", "\\r?\\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where(F.contains("line", F.lit(":")))
    lines = lines.select("site", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    lines = lines.where("field in ('user-agent', 'allow', 'disallow')")
    order = Window.partitionBy("site").orderBy("pos")
    starts = ((F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")).cast("int")
    grouped = lines.withColumn("starts", starts).withColumn("grp", F.sum("starts").over(order))
    agents = grouped.where("field = 'user-agent'").select("site", "grp", F.lower("value").alias("agent"))
    rules = grouped.where("field <> 'user-agent' and value <> ''").select("site", "grp", F.col("field").alias("kind"), F.col("value").alias("path"))
    return agents.join(rules, ["site", "grp"], "left").select("site", "agent", "kind", "path")


def allowed(paths: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """paths(site, path) with ``allowed`` for an agent: its own groups or else *, the longest rule decides, allow wins ties."""
    mine = rules.where(F.startswith(F.lit(agent.lower()), F.col("agent")) & (F.col("agent") != "*"))
    own = mine.select("site").distinct().withColumn("own", F.lit(True))
    used = mine.union(rules.where("agent = '*'").join(own, "site", "left_anti")).where("path is not null").select("site", "kind", F.col("path").alias("rule")).distinct()
    longest = lambda kind: F.coalesce(F.max(F.when((F.col("kind") == kind) & F.startswith("path", F.col("rule")), F.length("rule"))), F.lit(-1))
    return paths.join(used, "site", "left").groupBy("site", "path").agg((longest("allow") >= longest("disallow")).alias("allowed"))


def addresses(answers: DataFrame, starts: DataFrame, limit: int = 3000) -> DataFrame:
    """Page addresses below each site's sitemaps, indexes entered level by level -> (site, url, pos), first of equal ones.

    answers(site, loc, text) holds what each address answers, starts(site, loc, pos) where to begin. Documents are taken in
    the order in which they were named; each once, however often and wherever it is named. A site's documents are read while
    it has fewer than ``limit`` addresses, so reading may stop in the middle of a level, and a document is never cut. Addresses
    of other sites than the answering document's origin are left out; addresses without an answer are passed over.
    """
    place = Window.partitionBy("site").orderBy("order")
    ahead = starts.groupBy("site", "loc").agg(F.min("pos").alias("pos")).select("site", "loc", F.array(F.col("pos").cast("long")).alias("order"))
    seen = stored(ahead.select("site", "loc"), "seen")
    ahead, counts, found = stored(ahead, "frontier"), None, []
    while not ahead.isEmpty():
        texts = ahead.join(answers.select("site", "loc", "text"), ["site", "loc"])
        loc = F.regexp_extract_all("text", F.lit("(?i)<loc>\\s*([^<\\s]+)\\s*</loc>"), F.lit(1))
        origin = F.regexp_extract("loc", "^[a-zA-Z]+://[^/?#]+", 0)
        index = F.regexp_like("text", F.lit("(?i)<sitemapindex"))
        read = texts.select("site", "order", index.alias("index"), F.when(index, loc).otherwise(F.filter(loc, lambda x: x.startswith(origin))).alias("locs"))
        own = F.when(F.col("index"), 0).otherwise(F.size("locs"))
        before = F.sum(own).over(place) - own
        if counts is not None:
            read = read.join(counts, "site", "left")
            before = before + F.coalesce("had", F.lit(0))
        taken = stored(read.withColumn("before", before).where(F.col("before") < limit).select("site", "order", "index", "locs"), "sitemaps")
        found.append(taken.where("not index").select("site", "order", F.posexplode("locs").alias("at", "url")))
        now = taken.groupBy("site").agg(F.sum(F.when(F.col("index"), 0).otherwise(F.size("locs"))).alias("had"))
        counts = stored((now if counts is None else now.unionByName(counts)).groupBy("site").agg(F.sum("had").alias("had")), "counts")
        named = taken.where("index").select("site", "order", F.posexplode("locs").alias("at", "loc"))
        first = named.groupBy("site", "loc").agg(F.min(F.concat("order", F.array(F.col("at").cast("long")))).alias("order"))
        full = counts.where(F.col("had") >= limit).select("site")
        ahead = stored(first.join(seen, ["site", "loc"], "left_anti").join(full, "site", "left_anti"), "frontier")
        seen = stored(seen.unionByName(ahead.select("site", "loc")), "seen")
    if not found:
        return starts.select("site", F.col("loc").alias("url"), F.lit(0).cast("long").alias("pos")).where("false")
    every = found[0]
    for level in found[1:]:
        every = every.unionByName(level)
    first = every.groupBy("site", "url").agg(F.min(F.struct(F.size("order").alias("level"), "order", "at")).alias("at"))
    return first.select("site", "url", F.row_number().over(Window.partitionBy("site").orderBy("at")).cast("long").alias("pos"))

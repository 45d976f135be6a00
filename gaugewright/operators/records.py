"""Where records come from and what they lean on: source choice, fallbacks, authors, baselines, references in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.files import write_files
from ..sources.sitemap import allowed, robots_rules


def source_choice(repository: Column, own: str, path: Column) -> Column:
    """local for the own repository, by owner and name in any case, remote for others; refused where a local path leaves its folder."""
    mine = F.lower(F.concat(urls.owner(repository), F.lit("/"), urls.repository(repository))) == own.lower()
    return F.when(mine & ~urls.is_safe_path(path), "refused").when(mine, "local").otherwise("remote")


def first_known(wanted: DataFrame, homes: list[DataFrame], key: str, value: str, default: Column) -> DataFrame:
    """wanted(key) with the value of the first home that has it, and the default where none has; a missing record is no error."""
    out, names = wanted, []
    for i, home in enumerate(homes):
        names.append(f"_home{i}")
        out = out.join(home.select(key, F.col(value).alias(names[-1])).dropDuplicates([key]), key, "left")
    return out.withColumn(value, F.coalesce(*names, default)).drop(*names)


def first_author(commits: DataFrame, path: str) -> DataFrame:
    """commits(path, author, at, change): who added each path first."""
    return commits.where("change = 'A'").groupBy(path).agg(F.min_by("author", "at").alias("author"))


def observed_at(manifest: Column, platform: str) -> Column:
    """When a marketplace manifest last looked at a platform; empty where it does not name it."""
    held = F.from_json(manifest, "platforms array<struct<platform string, observedAt string>>")["platforms"]
    return F.coalesce(F.get(F.filter(held, lambda p: p["platform"] == platform), F.lit(0))["observedAt"], F.lit(""))


def separated(lines: Column, separator: str = "\u001f") -> Column:
    """Fields of a line; empty ones stay empty."""
    return F.split(lines, separator, -1)


def promoted(baseline: DataFrame, shots: DataFrame, page: str) -> tuple[DataFrame, DataFrame]:
    """The new baseline, which is what was seen, and the pages that leave it."""
    return shots, baseline.join(shots.select(page), page, "left_anti")


def flags_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(--[a-z][a-z0-9-]+)\\b"), F.lit(1)))


def unhonoured_flags(texts: DataFrame, code: DataFrame, skill: str, known: list[str]) -> DataFrame:
    """texts(skill, body), code(skill, source): flags that a skill's text mentions and none of its sources holds; common ones are left out."""
    said = texts.select(skill, F.explode(flags_in(F.col("body"))).alias("flag")).where(~F.col("flag").isin(*known)).distinct()
    held = code.select(skill, F.explode(flags_in(F.col("source"))).alias("flag")).distinct()
    return said.join(held, [skill, "flag"], "left_anti")


def unread_variables(code: DataFrame, skill: str) -> DataFrame:
    """code(skill, source): environment variables that are read in some source and assigned in none of the skill's."""
    read = code.select(skill, F.explode(F.regexp_extract_all("source", F.lit("\\$\\{?([A-Z][A-Z0-9_]+)\\}?"), F.lit(1))).alias("variable")).distinct()
    put = code.select(skill, F.explode(F.regexp_extract_all("source", F.lit("(?m)^\\s*(?:export\\s+)?([A-Z][A-Z0-9_]+)="), F.lit(1))).alias("variable")).distinct()
    return read.join(put, [skill, "variable"], "left_anti")


def lacking_peers(claims: DataFrame, accepted: DataFrame, skill: str) -> DataFrame:
    """claims(skill, flag) that a text makes of all scripts, accepted(skill, script, flags): the scripts that lack the flag."""
    return claims.join(accepted, skill).where(~F.array_contains("flags", F.col("flag"))).select(skill, "flag", "script")


def claimed_flags(texts: DataFrame, skill: str) -> DataFrame:
    """texts(skill, body): flags that a sentence claims of all, every, each or both commands."""
    claim = "(?i)\\b(?:all|every|each|both)\\b[\\w\\s]{0,24}?\\b(?:takes?|accepts?|supports?|sends?|requires?)\\b[^.\\n]{0,80}?(--[a-z][a-z0-9-]*)"
    return texts.select(skill, F.explode(F.regexp_extract_all("body", F.lit(claim), F.lit(1))).alias("flag")).distinct()


def scan_tree(pages: DataFrame, folder: str, key: Column) -> None:
    """Write a scan's pages as JSON files below a new folder, a folder a page key and a file a page, from all tasks.

    Folders are named as Spark names those of partitions, so that readers find ``page_key`` again; it is null where it is null or empty.
    """
    named = F.coalesce(F.replace(F.url_encode(F.nullif(key, F.lit(""))), F.lit("+"), F.lit("%20")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    numbered = pages.withColumn("page_key", named).withColumn("_n", F.monotonically_increasing_id())
    dealt = numbered.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_n")
    name = F.concat(F.lit("page_key="), "page_key", F.lit("/"), F.col("_n").cast("string"), F.lit(".json"))
    write_files(dealt.select(name.alias("name"), F.to_json(F.struct(*pages.columns)).cast("binary").alias("content")), f"{folder}/pages")


def probed(sites: DataFrame) -> DataFrame:
    """sites(site, robots, sitemap), texts or null -> what a first look says: answered, found, how many addresses, all shut."""
    rules = robots_rules(sites.select("site", F.coalesce("robots", F.lit("")).alias("body")))
    shut = allowed(sites.select("site", F.lit("/").alias("path")), rules, "anybot").select("site", (~F.col("allowed")).alias("blocks_all"))
    listed = F.when(F.regexp_like("sitemap", F.lit("(?i)<sitemapindex")), F.regexp_count("sitemap", F.lit("(?i)<sitemap\\b"))).otherwise(F.regexp_count("sitemap", F.lit("(?i)<url\\b")))
    return sites.join(shut, "site").select("site", F.col("robots").isNotNull().alias("answered"), F.col("sitemap").isNotNull().alias("found"), F.coalesce(listed, F.lit(0)).alias("addresses"), "blocks_all")


def new_lines(logs: DataFrame, log: str, body: str, offset: Column) -> DataFrame:
    """(log, line): what stands in a log from a byte on, blank lines and comments left out, each line once."""
    rest = F.decode(F.substring(F.col(body).cast("binary"), (offset + 1).cast("int"), F.lit(2147483647)), "UTF-8")
    lines = logs.select(log, F.explode(F.split(rest, "\\r?\\n")).alias("line")).where((F.trim("line") != "") & ~F.startswith("line", F.lit("#")))
    return lines.select(log, F.trim(F.regexp_replace("line", "\\s+", " ")).alias("line")).distinct()


#: Letters that only Vietnamese has, and words of it whose letters other languages share.
VIETNAMESE_LETTERS = "ĂăĐđƠơƯưẠ-ỹ"
VIETNAMESE_WORDS = ["còn", "xem", "và", "cho", "các", "này"]


def not_english(line: Column) -> Column:
    return F.regexp_like(line, F.lit(f"[{VIETNAMESE_LETTERS}]")) | F.regexp_like(line, F.lit(r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(VIETNAMESE_WORDS) + r")(?![\p{L}\p{N}])"))


def block_type(parameters: Column, module: Column, key: str) -> Column:
    """Type of a slot's block, which the parameters keep under ``key`` as JSON within JSON; without one the module's name, or unknown."""
    kind = F.get_json_object(F.get_json_object(parameters, f"$['{key}']"), "$[':type']")
    return F.when(F.contains(kind, F.lit(":")), F.regexp_replace(kind, "^[^:]*:", "")).otherwise(F.coalesce(F.nullif(module, F.lit("")), F.lit("unknown")))


def _head(text: Column) -> Column:
    return F.regexp_extract(text, "(?s)\\A---\\s*?\\n(.*?)\\n---[ \\t]*(?:\\n|\\z)", 1)


def skill_head(text: Column) -> Column:
    """(name, description) of a leading block; a description may stand as indented lines below its key."""
    head = _head(text)
    plain = lambda key: F.trim(F.regexp_extract(head, f"(?m)^{key}:(.*)$", 1))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, "^\"+|\"+$", ""), "^'+|'+$", "")
    below = F.regexp_extract(head, "(?m)^description:[ \\t]*[>|]-?[ \\t]*\\n((?:(?:  |\\t).*(?:\\n|\\z))+)", 1)
    joined = F.array_join(F.filter(F.transform(F.split(below, "\\n"), lambda x: F.trim(F.regexp_replace(x, "^\\t+", ""))), lambda x: x != ""), " ")
    return F.struct(bare(plain("name")).alias("name"), F.when(plain("description").isin(">", "|", ">-", "|-"), joined).otherwise(bare(plain("description"))).alias("description"))


def skill_problem(text: Column) -> Column:
    """The first rule that a skill's head breaks, null if none: block, keys, name and description."""
    head, own = _head(text), skill_head(text)
    keys = F.regexp_extract_all(head, F.lit("(?m)^([A-Za-z][\\w-]*):"), F.lit(1))
    known = F.array(*map(F.lit, ["name", "description", "license", "allowed-tools", "metadata", "compatibility"]))
    name, told = own["name"], own["description"]
    return (
        F.when(head == "", "no front matter")
        .when(F.size(F.array_except(keys, known)) > 0, F.concat(F.lit("unexpected: "), F.array_join(F.array_sort(F.array_except(keys, known)), ", ")))
        .when(~F.array_contains(keys, "name"), "no name")
        .when(~F.array_contains(keys, "description"), "no description")
        .when((name != "") & ~F.regexp_like(name, F.lit("^[a-z0-9]+(-[a-z0-9]+)*$")), "bad name")
        .when(F.length(name) > 64, "long name")
        .when(F.regexp_like(told, F.lit("[<>]")), "angle brackets")
        .when(F.length(told) > 1024, "long description")
    )


def markdown_pairs(texts: DataFrame, key: str, body: str, least: int = 8) -> DataFrame:
    """texts(key, body) -> (key, place, heading, body): each heading of a Markdown text with the paragraph that follows it before anything else does.

    Lines are numbered by the heading they stand under; fenced code holds no headings. A paragraph ends at a blank line, a
    fence or a heading, its lines are joined by blanks. Headings under ``least`` characters are left out; ``place`` counts those of the text.
    """
    lines = texts.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.posexplode(F.split(body, "\\r?\\n")).alias("at", "line"))
    order = Window.partitionBy("k").orderBy("at")
    fence = F.regexp_like("line", F.lit("^\\s{0,3}(```|~~~)"))
    lines = lines.withColumn("fence", fence).withColumn("inside", F.sum(fence.cast("int")).over(order) % 2 == 1)
    head = ~F.col("inside") & F.regexp_like("line", F.lit("^\\s{0,3}#{1,6}\\s+\\S"))
    plain = ~F.col("inside") & ~F.col("fence") & ~F.col("head") & (F.trim("line") != "")
    lines = lines.withColumn("head", head).withColumn("under", F.sum(F.col("head").cast("int")).over(order)).where("under > 0").withColumn("plain", plain)
    below = Window.partitionBy("k", "under").orderBy("at")
    # blank lines right below a heading do not count; what ends a paragraph does, once it has begun, and a fence always
    begun = F.max(F.col("plain").cast("int")).over(below)
    stop = ~F.col("head") & ~F.col("plain") & ((begun == 1) | F.col("fence"))
    lines = lines.withColumn("stopped", F.max(stop.cast("int")).over(below))
    words = F.array_sort(F.collect_list(F.when(F.col("plain") & (F.col("stopped") == 0), F.struct("at", F.trim("line").alias("line")))))
    title = F.max(F.when(F.col("head"), F.trim(F.regexp_replace(F.regexp_replace("line", "^\\s{0,3}#{1,6}\\s+", ""), "\\s+#+\\s*$", ""))))
    pairs = lines.groupBy("k", "under").agg(title.alias("heading"), F.array_join(F.transform(words, lambda x: x["line"]), " ").alias("text"))
    return pairs.where(F.char_length("heading") >= least).select(F.col("k").alias(key), F.col("under").alias("place"), "heading", F.col("text").alias("body"))


def rendered(template: Column, values: dict[str, Column]) -> tuple[Column, Column]:
    """(text, unknown): placeholders filled; lines whose placeholder has no value are left out; placeholders that nobody fills are named."""
    lines = F.split(template, "\\n")
    for name, value in values.items():
        mark = F.lit("{" + name + "}")
        empty = F.coalesce(value, F.lit("")) == ""
        lines = F.filter(lines, lambda x: ~(empty & F.contains(x, mark)))  # noqa: B023 - used at once
    text = F.array_join(lines, "\n")
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    unknown = F.array_except(F.regexp_extract_all(template, F.lit("\\{([A-Za-z]+)\\}"), F.lit(1)), F.array(*map(F.lit, values)))
    return text, F.array_sort(unknown)

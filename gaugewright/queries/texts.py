"""Text functions over documents, conversations and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls, versions
from ..operators import conversations
from .registry import query, read

BLANK = r"[\s\x{00a0}\x{feff}]+"
FOLD = "replace(replace(replace(replace(strip_accents(replace(replace(lower(text), 'ß', 'ss'), 'đ', 'd')), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), 'ł', 'l')"


@query(f"SELECT doc_id, md5({FOLD}) AS folded FROM documents")
def f22_fold_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold(F.col("text")).cast("binary")).alias("folded"))


@query(rf"""WITH n AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace({FOLD}, '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM documents)
SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, CAST(len(list_distinct(t)) AS BIGINT) AS kinds FROM n""")
def f23_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))  # a column of its own, so that it is computed once
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("kinds"))


@query(rf"SELECT doc_id, regexp_replace({FOLD}, '[^\p{{L}}\p{{N}}]', '', 'g') AS fuzz FROM documents")
def f41_fuzz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.fuzz(F.col("text")).alias("fuzz"))


@query("""WITH h AS (SELECT d.doc_id, d.text AS n, e.text AS h FROM documents d JOIN documents e ON e.doc_id = d.doc_id // 2), w AS (SELECT doc_id, h, n, list_transform([0.0, 0.2, 0.4, 0.6, 0.8], lambda s: CASE WHEN contains(h, substr(n, CAST(floor(s * (length(n) - 40)) AS INTEGER) + 1, 40)) THEN 1 ELSE 0 END) AS f FROM h)
SELECT doc_id, CASE WHEN length(n) < 60 THEN contains(h, n) ELSE list_sum(f) >= 3 END AS present FROM w""")
def f25_windowed_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a whole text present in another one, that of the document with half its number?"""
    docs = read(spark, sf_dir, "documents")
    other = docs.selectExpr("doc_id as half", "text as page")
    met = docs.withColumn("half", F.expr("doc_id div 2")).join(other, "half")
    return met.select("doc_id", text.in_windows(F.col("text"), F.col("page")).alias("present"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 136) || ' […] ' || right(text, 59) END AS capped FROM documents")
def f26_cap_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.cap_ends(F.col("text"), 200).alias("capped"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(substr(text, 1, 120), '\s+\S*$', '') || '…' END AS capped FROM documents")
def f65_cap_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.cap_words(F.col("text"), 120).alias("capped"))


@query(rf"SELECT conv_id, turn, regexp_matches(text, '[?？؟]') AS question, len(string_split(trim(regexp_replace(text, '{BLANK}', ' ', 'g')), ' ')) < 20 AND NOT regexp_matches(trim(text), '[.!?…。]$') AS stub FROM conversations")
def f37_f38_stubs_and_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_question(F.col("text")).alias("question"), text.is_stub(F.col("text")).alias("stub"))


@query("""WITH c AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 + 4000000000000 AS VARCHAR), 13, '0') AS code FROM part), d AS (SELECT p_partkey, code, list_sum(list_transform(range(1, 14), lambda i: CAST(code[14 - i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) AS s FROM c)
SELECT p_partkey, code, s % 10 = 0 AS valid FROM d""")
def f29_gtin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.lpad((F.col("p_partkey") * 7919 + 4000000000000).cast("string"), 13, "0")
    return read(spark, sf_dir, "part").select("p_partkey", code.alias("code"), text.gtin_valid(code).alias("valid"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(s, '^[0-9.]+$') THEN try_cast(s AS DOUBLE) END AS number FROM (SELECT page_id, regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1) AS s FROM pages)""")
def f30_to_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.regexp_extract("url", "/([^/?#]*)(?:[?#].*)?$", 1)
    return read(spark, sf_dir, "pages").select("page_id", text.to_number(last).alias("number"))


@query(r"""SELECT doc_id, round(list_sum(list_transform(regexp_extract_all(text, '\d+(?:,\d{3})*(?:\.\d+)?'), lambda x: CAST(replace(x, ',', '') AS DOUBLE))), 2) AS total FROM documents WHERE regexp_matches(text, '\d')""")
def f63_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where(F.col("text").rlike("\\d"))
    return docs.select("doc_id", F.round(F.aggregate(text.numbers_in(F.col("text")), F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query("""WITH w AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS t FROM documents), p AS (SELECT a.doc_id, a.t AS x, b.t AS y FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 6) AS jaccard FROM p""")
def u05_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("x"))
    following = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y"))
    return w.join(following, "doc_id").select("doc_id", F.round(text.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query("""WITH v AS (SELECT p_partkey, (3 + p_partkey % 4) || '.' || (p_partkey * 7 % 12) || CASE WHEN p_partkey % 3 = 0 THEN '.' || p_partkey % 10 ELSE '' END AS version FROM part), l AS (SELECT *, split_part(version, '.', 1) AS m, split_part(version, '.', 1) || '.' || split_part(version, '.', 2) AS line FROM v),
g AS (SELECT *, CASE WHEN line IN ('3.10', '4.4', '5.4', '6.1') THEN line ELSE CASE m WHEN '3' THEN '3.10' WHEN '4' THEN '4.4' WHEN '5' THEN '5.4' WHEN '6' THEN '6.1' END END AS launch FROM l)
SELECT p_partkey, version, launch, array_to_string(list_filter(['3.10', '4.4', '5.4', '6.1'], lambda x: CAST(split_part(x, '.', 1) AS INTEGER) > CAST(m AS INTEGER) OR (x = launch AND line <> launch)), '>') AS hops FROM g""")
def f48_f49_upgrade_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "part").selectExpr("p_partkey", "concat(3 + p_partkey % 4, '.', p_partkey * 7 % 12, if(p_partkey % 3 = 0, concat('.', p_partkey % 10), '')) as version")
    return v.select("p_partkey", "version", versions.launch_line(F.col("version")).alias("launch"), F.array_join(versions.hops(F.col("version")), ">").alias("hops"))


@query("""SELECT doc_id, regexp_matches(u, '^https://github\\.com/[^/?#@:\\s]+/[^/?#@:\\s]+/?$') AS ok, regexp_extract(u, '^https?://[^/]+/([^/?#]+)', 1) AS owner FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://github.com/' || source || '/' || lang WHEN 1 THEN 'http://github.com/' || source || '/' || lang
WHEN 2 THEN 'https://github.com/' || source || '/' || lang || '/tree' ELSE 'https://github.com/' || source || '/' || lang || '?x=1' END AS u FROM documents)""")
def f15_f16_repository_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.expr("concat(if(doc_id % 4 = 1, 'http', 'https'), '://github.com/', source, '/', lang, case doc_id % 4 when 2 then '/tree' when 3 then '?x=1' else '' end)")
    return read(spark, sf_dir, "documents").select("doc_id", urls.is_repository(u).alias("ok"), urls.owner(u).alias("owner"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def f18_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT *, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l)
SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM p WHERE trim(line) = '' OR before IS NULL OR before <> trim(line) GROUP BY 1""")
def f46_consecutive_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", conversations.without_consecutive(F.col("text"), "\n").alias("text"))


@query("""SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, bool_or(role = 'system') AS has_system, nullif(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0)::BIGINT AS used, count(DISTINCT role) AS roles FROM conversations GROUP BY 1""")
def s26_merge_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.merged(read(spark, sf_dir, "conversations"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def s25_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return parsed.select("event_id", "p.k").where("k is not null")


@query("""SELECT doc_id, CASE WHEN length(m) = 10 THEN CAST(m AS DATE) WHEN contains(m, '/') THEN CAST(split_part(m, '/', 2) || '-' || lpad(split_part(m, '/', 1), 2, '0') || '-01' AS DATE) ELSE CAST(m || '-01-01' AS DATE) END AS date
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '20' || lpad(CAST(doc_id % 25 AS VARCHAR), 2, '0') || '-0' || (doc_id % 9 + 1) || '-11' WHEN 1 THEN (doc_id % 12 + 1) || '/20' || lpad(CAST(doc_id % 25 AS VARCHAR), 2, '0') ELSE '20' || lpad(CAST(doc_id % 25 AS VARCHAR), 2, '0') END AS m FROM documents)""")
def f40_loose_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = "concat('20', lpad(cast(doc_id % 25 as string), 2, '0'))"
    raw = F.expr(f"case doc_id % 3 when 0 then concat({year}, '-0', doc_id % 9 + 1, '-11') when 1 then concat(doc_id % 12 + 1, '/', {year}) else {year} end")
    return read(spark, sf_dir, "documents").select("doc_id", text.loose_date(raw).alias("date"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)\b(apache|mit|gnu)\b.{0,40}license') AS hit, CAST(len(regexp_extract_all(text, '(?i)\blicense\b')) AS BIGINT) AS n FROM documents""")
def r15_forbidden_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("text").rlike("(?i)\\b(apache|mit|gnu)\\b.{0,40}license")
    return read(spark, sf_dir, "documents").select("doc_id", hit.alias("hit"), F.regexp_count("text", F.lit("(?i)\\blicense\\b")).cast("long").alias("n"))

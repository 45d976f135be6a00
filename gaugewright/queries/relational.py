"""Joins, top rows, set comparisons and inventories over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, ranking, reconcile
from .registry import query, read


@query("""SELECT c_custkey, c_name, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_name END AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def j01_record_with_curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    curated = read(spark, sf_dir, "nation").where("n_regionkey <> 0")
    return read(spark, sf_dir, "customer").join(curated, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", F.col("n_name").alias("nation"))


@query("""SELECT n_name, c_mktsegment, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1, 2""")
def j18_inner_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").where("c_acctbal > 0")
    return read(spark, sf_dir, "nation").join(customers, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def j19_left_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return read(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("""SELECT c_custkey, c_name, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY orders DESC, c_custkey LIMIT 20""")
def j20_top_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    joined = read(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("c_custkey", "c_name", "orders").orderBy(F.desc("orders"), "c_custkey").limit(20)


@query("""SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F')""")
def j21_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return read(spark, sf_dir, "customer").join(done, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)""")
def j30_semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = read(spark, sf_dir, "lineitem").where("l_quantity >= 49")
    return read(spark, sf_dir, "part").join(big, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey", "p_brand")


@query("""WITH n AS (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS c FROM supplier GROUP BY 1),
a AS (SELECT *, row_number() OVER (ORDER BY c DESC, k) AS rank FROM n), b AS (SELECT *, row_number() OVER (ORDER BY c DESC, k) AS rank FROM s)
SELECT CAST(coalesce(a.rank, b.rank) AS BIGINT) AS rank, a.k AS customers, b.k AS suppliers FROM a FULL JOIN b ON a.rank = b.rank""")
def j22_pair_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("customers")).agg(F.count("*").alias("a"))
    s = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("suppliers")).agg(F.count("*").alias("b"))
    paired = ranking.pair_by_rank(n, [F.desc("a"), F.col("customers")], s, [F.desc("b"), F.col("suppliers")])
    return paired.select(F.col("rank").cast("long").alias("rank"), "customers", "suppliers")


COMPARE = """WITH a AS (SELECT doc_id AS k, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS h FROM documents), b AS (SELECT doc_id AS k, CASE WHEN quality = 1 THEN 'long' ELSE 'short' END AS h FROM labels)
SELECT coalesce(a.k, b.k) AS k, a.h AS old_value, b.h AS new_value, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'missing' WHEN a.h = b.h THEN 'identical' ELSE 'modified' END AS state FROM a FULL JOIN b ON a.k = b.k"""


@query(COMPARE)
def j25_tree_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "documents").selectExpr("doc_id as k", "if(n_chars > 1000, 'long', 'short') as h")
    return reconcile.compare(old, read(spark, sf_dir, "labels").selectExpr("doc_id as k", "if(quality = 1, 'long', 'short') as h"), ["k"], "h")


@query(f"SELECT state, count(*) AS n FROM ({COMPARE}) GROUP BY 1")
def j24_compare_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j25_tree_compare(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS s, l_returnflag AS f FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.08), g AS (SELECT s_suppkey AS s, f FROM supplier, (SELECT DISTINCT l_returnflag AS f FROM lineitem))
SELECT s AS supplier, f AS flag FROM g WHERE (s, f) NOT IN (SELECT s, f FROM a)""")
def j14_grid_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").selectExpr("l_suppkey as supplier", "l_returnflag as flag", "l_quantity", "l_discount")
    rows = read(spark, sf_dir, "supplier").selectExpr("s_suppkey as supplier")
    return reconcile.grid_holes(rows, items.select("flag").distinct(), items.where("l_quantity >= 50 and l_discount >= 0.08"))


@query("""SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def j14_grid_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").selectExpr("s_nationkey as nation").distinct()
    return reconcile.grid_extras(declared, read(spark, sf_dir, "customer").selectExpr("c_nationkey as nation"), "nation")


@query("""SELECT l_orderkey AS list, CAST(n AS BIGINT) AS number FROM (SELECT l_orderkey, unnest(range(1, CAST(max(l_linenumber) + 1 AS BIGINT))) AS n FROM lineitem GROUP BY 1 HAVING max(l_linenumber) >= 5) g
WHERE NOT EXISTS (SELECT 1 FROM lineitem i WHERE i.l_orderkey = g.l_orderkey AND i.l_linenumber = g.n)""")
def a56_numbering_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as list", "l_linenumber as number")
    return reconcile.missing_numbers(numbers, "list", "number", least=5)


@query("""WITH w AS (SELECT s_nationkey AS nation, count(*) * 10 AS n FROM supplier GROUP BY 1), g AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_acctbal > 3000 GROUP BY 1)
SELECT coalesce(w.nation, g.nation) AS nation, CAST(coalesce(w.n, 0) AS BIGINT) AS wants, coalesce(g.n, 0) AS gets, CAST(greatest(0, coalesce(w.n, 0) - coalesce(g.n, 0)) AS BIGINT) AS shortage FROM w FULL JOIN g ON w.nation = g.nation""")
def a49_wanted_and_got(spark: SparkSession, sf_dir: str) -> DataFrame:
    wants = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg((F.count("*") * 10).alias("n"))
    gets = read(spark, sf_dir, "customer").where("c_acctbal > 3000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return reconcile.wanted_and_got(wants, gets, "nation")


@query("""WITH n AS (SELECT s_nationkey AS nation, count(*) AS need FROM supplier GROUP BY 1), s AS (SELECT nation, need, unnest(range(1, need + 1)) AS seat FROM n)
SELECT CAST(row_number() OVER (ORDER BY seat, need DESC, nation) AS BIGINT) AS turn, nation, CAST(seat AS BIGINT) AS seat FROM s""")
def a48_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("need"))
    return ranking.round_robin(needs, "nation", "need")


@query("""SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 4""")
def t06_first_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return ranking.top(orders, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 4).select("o_custkey", "o_orderkey", "rank")


@query("""WITH w AS (SELECT c_custkey, 1 + c_nationkey % 3 AS wants FROM customer) SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, wants, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r
FROM orders JOIN w ON o_custkey = c_custkey) WHERE r <= wants""")
def t05_latest_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    wants = read(spark, sf_dir, "customer").selectExpr("c_custkey as o_custkey", "1 + c_nationkey % 3 as wants")
    orders = read(spark, sf_dir, "orders").join(wants, "o_custkey")
    return ranking.top(orders, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], F.col("wants")).select("o_custkey", "o_orderkey")


@query("""SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS hits FROM lineitem GROUP BY 1 ORDER BY hits DESC, l_partkey LIMIT 30""")
def t04_top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("hits"))
    return hits.orderBy(F.desc("hits"), "l_partkey").limit(30)


@query("""SELECT n_name, CAST(sum(s_acctbal > 0) AS BIGINT) AS ok, CAST(sum(s_acctbal <= 0) AS BIGINT) AS failed, count(*) AS total, round(sum(abs(s_acctbal)), 2) AS duration FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def a59_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    good = F.col("s_acctbal") > 0
    return joined.groupBy("n_name").agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"), F.count("*").alias("total"), F.round(F.sum(F.abs("s_acctbal")), 2).alias("duration"))


@query("""SELECT p_type AS position, CAST(sum(p_size) AS BIGINT) AS wants, arg_min(p_name, p_partkey) AS label FROM part GROUP BY 1""")
def a46_slot_appetite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("position")).agg(F.sum("p_size").alias("wants"), F.min_by("p_name", "p_partkey").alias("label")).orderBy(F.desc("wants"), "position")


@query("""SELECT o_custkey AS category, o_orderpriority AS language, count(*) AS articles, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY 1, 2""")
def a45_category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("category"), F.col("o_orderpriority").alias("language")).agg(F.count("*").alias("articles"), F.countDistinct("o_orderstatus").alias("states"))


@query("""WITH r AS (SELECT p_type, round(p_retailprice / 1000, 1) AS ratio, count(*) AS c FROM part GROUP BY 1, 2), m AS (SELECT p_type, ratio, row_number() OVER (PARTITION BY p_type ORDER BY c DESC, ratio) AS k FROM r)
SELECT p.p_type, count(*) AS n, round(avg(p_size), 4) AS mean_size, min(p_size) AS least, any_value(ratio) AS common_ratio FROM part p JOIN m ON m.p_type = p.p_type AND k = 1 GROUP BY 1""")
def a62_size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, mean and least size of each kind, and its most common ratio rounded to tenths, the smaller one of equals."""
    parts = read(spark, sf_dir, "part").withColumn("ratio", F.round(F.col("p_retailprice") / 1000, 1))
    modes = parts.groupBy("p_type", "ratio").agg(F.count("*").alias("c")).groupBy("p_type").agg(F.max_by("ratio", F.struct("c", -F.col("ratio"))).alias("common_ratio"))
    sizes = parts.groupBy("p_type").agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 4).alias("mean_size"), F.min("p_size").alias("least"))
    return sizes.join(modes, "p_type")


BOXES = """b AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS id, l_quantity * 20 AS l, l_discount * 3000 AS t, l_quantity * 20 + 300 AS r, l_discount * 3000 + l_tax * 2000 + 40 AS o FROM lineitem)"""


@query(f"""WITH {BOXES} SELECT x.page, x.id AS a_id, y.id AS b_id, round(least(x.r, y.r) - greatest(x.l, y.l), 4) AS width, round(least(x.o, y.o) - greatest(x.t, y.t), 4) AS height FROM b x JOIN b y ON x.page = y.page AND x.id < y.id
WHERE least(x.r, y.r) - greatest(x.l, y.l) > 4 AND least(x.o, y.o) - greatest(x.t, y.t) > 4
AND NOT (x.l >= y.l AND x.r <= y.r AND x.t >= y.t AND x.o <= y.o) AND NOT (y.l >= x.l AND y.r <= x.r AND y.t >= x.t AND y.o <= x.o)""")
def j36_box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as page", "l_linenumber as id", "l_quantity * 20 as left", "l_discount * 3000 as top", "l_quantity * 20 + 300 as right", "l_discount * 3000 + l_tax * 2000 + 40 as bottom"
    )
    return layout.overlaps(boxes.distinct(), "page", "id").select("page", "a_id", "b_id", F.round("width", 4).alias("width"), F.round("height", 4).alias("height"))


PIXELS = """p AS (SELECT doc_id, doc_id * 37 % 256 AS r, doc_id * 91 % 256 AS g, doc_id * 53 % 256 AS b, (doc_id * 37 + doc_id % 9) % 256 AS r2, doc_id * 91 % 256 AS g2, (doc_id * 53 + doc_id % 5) % 256 AS b2 FROM documents)"""


@query(f"""WITH {PIXELS}, d AS (SELECT doc_id, 0.29889531 * (r - r2) + 0.58662247 * (g - g2) + 0.11448223 * (b - b2) AS y, 0.59597799 * (r - r2) - 0.27417610 * (g - g2) - 0.32180189 * (b - b2) AS i, 0.21147017 * (r - r2) - 0.52261711 * (g - g2) + 0.31114694 * (b - b2) AS q FROM p)
SELECT doc_id, round(0.5053 * y * y + 0.299 * i * i + 0.1957 * q * q, 4) AS delta FROM d""")
def f51_pixel_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = read(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id * 37 % 256 as r", "doc_id * 91 % 256 as g", "doc_id * 53 % 256 as b", "(doc_id * 37 + doc_id % 9) % 256 as r2", "doc_id * 91 % 256 as g2", "(doc_id * 53 + doc_id % 5) % 256 as b2")
    c = F.col
    return px.select("doc_id", F.round(layout.yiq_delta([c("r"), c("g"), c("b")], [c("r2"), c("g2"), c("b2")]), 4).alias("delta"))


@query("""SELECT e.vec_id, CAST(sum(CASE WHEN abs(x - y) > 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS changed, count(*) AS pixels, round(100.0 * sum(CASE WHEN abs(x - y) > 0.2 THEN 1 ELSE 0 END) / count(*), 4) AS percent
FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) e JOIN (SELECT vec_id, unnest(embedding) AS y, generate_subscripts(embedding, 1) AS i FROM embeddings) f ON f.vec_id = e.vec_id + 1 AND f.i = e.i GROUP BY 1""")
def a38_image_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    changed = F.size(F.filter(F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double")) > 0.2), lambda x: x))
    return rows.join(following, "vec_id").select("vec_id", changed.cast("long").alias("changed"), F.size("embedding").cast("long").alias("pixels"), F.round(100.0 * changed / F.size("embedding"), 4).alias("percent"))


@query("""WITH q AS (SELECT CAST(round((doc_id * 37 % 256) / 32.0) * 32 AS INTEGER) AS r, CAST(round((doc_id * 91 % 256) / 32.0) * 32 AS INTEGER) AS g, n_chars FROM documents)
SELECT r, g, CAST(sum(n_chars) AS BIGINT) AS area, round(sum(n_chars) / (SELECT sum(n_chars) FROM q), 6) AS share FROM q GROUP BY 1, 2 ORDER BY area DESC, r, g LIMIT 8""")
def a39_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(layout.quantise(F.col("doc_id") * 37 % 256).alias("r"), layout.quantise(F.col("doc_id") * 91 % 256).alias("g"), "n_chars")
    painted = docs.groupBy("r", "g").agg(F.sum("n_chars").alias("area"))
    whole = docs.agg(F.sum("n_chars").alias("whole"))
    return painted.join(F.broadcast(whole)).select("r", "g", "area", F.round(F.col("area") / F.col("whole"), 6).alias("share")).orderBy(F.desc("area"), "r", "g").limit(8)


@query("""SELECT c_mktsegment, string_agg(nation, ',' ORDER BY nation) AS only_here FROM (SELECT DISTINCT c_mktsegment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer WHERE c_acctbal > 9000
EXCEPT SELECT DISTINCT c_mktsegment, CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_acctbal < -500) GROUP BY 1""")
def u03_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = read(spark, sf_dir, "customer").groupBy("c_mktsegment")
    high = F.collect_set(F.when(F.col("c_acctbal") > 9000, F.col("c_nationkey").cast("string")))
    low = F.collect_set(F.when(F.col("c_acctbal") < -500, F.col("c_nationkey").cast("string")))
    return by.agg(F.array_join(F.array_sort(F.array_except(high, low)), ",").alias("only_here")).where("only_here <> ''")

"""Spelling variants: words at distance one, by joining a vocabulary trie with itself.

A node of the trie is a prefix of a word, known by its root and its text. Its active nodes are the nodes at distance one from
it, and come from its parent's: both step down by the same code point, or the one edit that is allowed happens here, as two
different children of one node (a replacement) or as a node and its child (an insertion). Level after level the active
pairs are joined with the children of their first node and with those of their second; pairs of words among them are the
result. Every pair comes up once: an insertion among equal code points counts as made at their end.

A node has no more children than the alphabet has letters, and no more active nodes than its length times that many, so
no key of these joins is hot, however large the vocabulary or a prefix's share of it. Nothing is broadcast or gathered.

Words longer than WINDOW code points are cut into windows. Two of them at distance one agree before and after the window that
the edit falls in, so what stands before and after is the root below which only the windows' code points stand. The number
of levels is thus bounded, whatever the length of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, keep

LETTERS = "[A-Za-z\\x{C0}-\\x{FF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 24


def words(docs: DataFrame, mutate: Column | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> (word), a row per run of letters of each text, A-Z in lower case.

    ``mutate`` is a column of (doc_id, word) that stands for the word. Null and empty texts have no words; repeated rows count
    repeatedly; very long texts are taken whole. Other columns are ignored.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS})"), 1)).alias("word")).select("doc_id", F.translate("word", UPPER, LOWER).alias("word"))
    return runs.select((mutate if mutate is not None else F.col("word")).alias("word"))


def vocabulary(found: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """found(word) -> distinct (word, n long) of at least so many code points and occurrences."""
    return found.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _rooted(vocab: DataFrame) -> DataFrame:
    """(root, tail, word): short words below the root '', windows of longer ones below roots of what surrounds them.

    Words of m and m + 1 code points meet in class m. Its windows lie between the places j * m / k of the shorter word.
    """
    sized = vocab.select("word", F.char_length("word").alias("size"))
    short = sized.where(F.col("size") <= WINDOW + 1).select(F.lit("").alias("root"), F.col("word").alias("tail"), "word")
    classes = F.filter(F.array(F.col("size"), F.col("size") - 1), lambda m: m > WINDOW)
    long = sized.select("*", F.explode(classes).alias("m")).withColumn("k", F.ceil(F.col("m") / WINDOW)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j"))
    place = lambda j: F.floor(j * F.col("m") / F.col("k")).cast("int")
    cut = long.withColumn("a", place(F.col("j"))).withColumn("b", place(F.col("j") + 1) + F.col("size") - F.col("m"))
    before, after = F.expr("substring(word, 1, a)"), F.expr("substring(word, b + 1)")
    root = F.concat_ws(":", F.col("m").cast("string"), F.col("j").cast("string"), F.sha2(before.cast("binary"), 256), F.sha2(after.cast("binary"), 256))
    return short.unionByName(cut.select(root.alias("root"), F.expr("substring(word, a + 1, b - a)").alias("tail"), "word"))


def near_words(vocab: DataFrame) -> DataFrame:
    """Distinct vocab(word) -> (a, b) with a < b: all pairs that differ by exactly one inserted, deleted or replaced code point, each once.

    Null words are left out; an empty vocabulary has no pairs. Words are compared as they are, without regard to case.
    """
    n = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terminal = keep(_rooted(vocab.where("word is not null").select("word")), "words")
    depths = F.explode(F.sequence(F.lit(0), F.char_length("tail"))).alias("depth")
    prefixes = terminal.select("root", "tail", depths).select("root", "depth", F.expr("substring(tail, 1, depth)").alias("node"), (F.col("depth") == F.char_length("tail")).alias("ends"))
    nodes = prefixes.groupBy("root", "depth", "node").agg(F.max("ends").alias("ends"))
    nodes = keep(nodes.repartitionByRange(n, "depth", "root", "node"), "nodes")  # levels lie together, so that a level reads little else
    most = nodes.agg(F.max("depth")).first()[0]

    def children(depth: int) -> DataFrame:
        """(root, node, letter, ends): the children of the nodes of a level."""
        return nodes.where(F.col("depth") == depth + 1).select("root", F.expr("substring(node, 1, depth - 1)").alias("node"), F.expr("substring(node, depth, 1)").alias("letter"), "ends")

    def followed(pairs: DataFrame, depth: int) -> DataFrame:
        """Both nodes of each pair, of which the first is of this depth, step down by the same letter."""
        first = pairs.select("root", F.col("u").alias("node"), "v", "fresh").hint("merge").join(children(depth).withColumnRenamed("ends", "u_ends"), ["root", "node"])
        first = first.where(F.col("fresh").isNull() | (F.col("fresh") != F.col("letter")))
        stepped = first.select("root", F.concat("node", "letter").alias("u"), F.concat("v", "letter").alias("node"), "u_ends")
        known = nodes.where(F.col("depth").isin(depth + 1, depth + 2)).select("root", "node", F.col("ends").alias("v_ends"))
        return stepped.hint("merge").join(known, ["root", "node"]).select("root", "u", F.col("node").alias("v"), "u_ends", "v_ends", F.lit(None).cast("string").alias("fresh"))

    def replaced(depth: int) -> DataFrame:
        """Pairs of different children of a node."""
        one, other = (children(depth).withColumnsRenamed({"letter": x, "ends": f"{x}_ends"}) for x in "uv")
        both = one.hint("merge").join(other, ["root", "node"]).where("u < v")
        return both.select("root", F.concat("node", "u").alias("u"), F.concat("node", "v").alias("v"), "u_ends", "v_ends", F.lit(None).cast("string").alias("fresh"))

    def inserted(depth: int) -> DataFrame:
        """Pairs of a node and a child, with the letter that was inserted last."""
        here = nodes.where(F.col("depth") == depth).select("root", "node", F.col("ends").alias("u_ends"))
        pairs = children(depth).hint("merge").join(here, ["root", "node"])
        return pairs.select("root", F.col("node").alias("u"), F.concat("node", "letter").alias("v"), "u_ends", F.col("ends").alias("v_ends"), F.col("letter").alias("fresh"))

    if most is None:
        return terminal.select(F.col("word").alias("a"), F.col("word").alias("b"))
    active = [keep(inserted(0), "active")]
    for depth in range(1, most + 1):
        active.append(keep(inserted(depth).unionByName(replaced(depth - 1)).unionByName(followed(active[-1], depth - 1)), "active"))
    ended = active[0].where("false")
    for level in active:
        ended = ended.unionByName(level.where("u_ends and v_ends"))
    pairs = lambda rows: rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    short = pairs(ended.where("root = ''").withColumnsRenamed({"u": "a", "v": "b"}))
    below = terminal.where("root <> ''")
    long = ended.where("root <> ''").select("root", "u", "v").join(below.select("root", F.col("tail").alias("u"), F.col("word").alias("a")), ["root", "u"])
    long = pairs(long.join(below.select("root", F.col("tail").alias("v"), F.col("word").alias("b")), ["root", "v"]))
    new = long.distinct().where(F.greatest(F.char_length("a"), F.char_length("b")) > WINDOW + 1)  # two of WINDOW + 1 meet below '' too
    out = keep(short.unionByName(new), "pairs")
    for part in [*active, nodes, terminal]:
        forget(part)
    return out


def variants(vocab: DataFrame, times: int = 2) -> DataFrame:
    """Distinct vocab(word, n) -> (word, form, root, n, n_near, form_n), a row per word.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that is at least ``times`` the word's
    own, else null; ``root`` is what following forms leads to, the word itself without one. As n grows at each step, forms
    end; with ``times`` of two, after no more steps than n has bits. Null words are left out, an empty vocabulary has no rows.
    """
    vocab = keep(vocab.where("word is not null").select("word", "n"), "vocabulary")
    pairs = near_words(vocab)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weighed = both.hint("merge").join(vocab.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("b").alias("form"))).alias("best")
    tops = weighed.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best)
    chosen = F.when(-F.col("best.less") >= times * F.col("n"), F.col("best"))
    rows = vocab.hint("merge").join(tops, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), chosen.alias("best"))
    rows = keep(rows.select("word", F.col("best.form").alias("form"), "n", "n_near", (-F.col("best.less")).alias("form_n"), F.coalesce("best.form", "word").alias("root")), "forms")
    while True:  # each round doubles the steps that a root stands for
        step = rows.select(F.col("word").alias("root"), F.col("root").alias("next")).where("root <> next")
        moved = keep(rows.hint("merge").join(step, "root", "left").select("word", "form", "n", "n_near", "form_n", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        forget(rows)
        rows, again = moved.drop("moved"), not moved.where("moved").isEmpty()
        if not again:
            break
    forget(vocab)
    forget(pairs)
    return rows.select("word", "form", "root", "n", "n_near", "form_n")

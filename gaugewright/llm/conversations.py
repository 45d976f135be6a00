"""Prefix trie of conversations, built level by level.

A node of depth d stands for a distinct sequence of d turns; its smallest member and its depth name it. Per depth, the
conversations that are still live are grouped by (parent node, next turn), and each group takes its smallest conv_id. A
turn is known by the SHA-256 of its role and text, so texts are shuffled nowhere. A group whose members are all equal to
their ends, one member or very many, has one node a depth from there on: it is written down at once and its members leave
the loop. So there are as many levels as different conversations share turns, however long conversations are.

Leaves and savings come back up by joins level by level. Every step groups with map-side combine and joins by node and
turn, where a first turn that very many conversations share can be split; each level is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep

WORDS = "[^\\x20\\x09-\\x0D]+"
RUN = 4096  #: ids that are joined to one string before they are hashed


def turns(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> (conv_id, pos long from 1, key binary, words int).

    Null role and text count as empty, null turns come first, turns of equal number are ordered by their key; repeated rows
    are turns of their own. Rows without a conv_id belong to no conversation. Texts of any length are hashed where they lie.
    Other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", key.alias("key"), F.size(F.regexp_extract_all(text, F.lit(WORDS), 0)).alias("words"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key"))
    return rows.select("conv_id", pos.cast("long").alias("pos"), "key", "words")


def rebuilt(conversations: DataFrame, base: Column | None = None, heads: Column | None = None) -> DataFrame:
    """Conversations of which each starts with turns of another one -> (conv_id, depth long from 1, key, words); a turnless one is a row with a null depth.

    The first ``heads`` turns of conversation ``base`` (columns of conv_id) replace as many turns at the start: all there
    are if there are fewer, none if it is absent. Without the two, conversations stay as they are.
    """
    own = turns(conversations)
    if base is None or heads is None:
        return own.withColumnRenamed("pos", "depth")
    own = keep(own, "turns")
    sizes = own.groupBy("conv_id").agg(F.max("pos").alias("size"))
    plan = sizes.select("conv_id", "size", base.alias("base"), heads.cast("long").alias("head"))
    taken = F.least("head", F.coalesce("base_size", F.lit(0)))
    plan = keep(plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left").select("conv_id", "size", "base", "head", taken.alias("taken")), "plan")
    lent = plan.where("taken > 0").join(own.withColumnsRenamed({"conv_id": "base"}), "base").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "key", "words")
    rest = plan.join(own, "conv_id").where("pos > head").select("conv_id", (F.col("pos") - F.col("head") + F.col("taken")).alias("depth"), "key", "words")
    bare = plan.where("taken = 0 and size <= head").select("conv_id", F.lit(None).cast("long").alias("depth"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("int").alias("words"))
    return lent.unionByName(rest).unionByName(bare)


def _hashed(ends: DataFrame) -> DataFrame:
    """ends(depth, node, conv_id) -> (depth, node, ends_sha256): SHA-256 of each node's ids, ascending and comma-joined.

    Ids are sorted by ranges of (depth, node, id) and joined to strings of at most RUN ids where they lie, so that one node's
    ids are prepared by many tasks; a hash is a sequence by nature, and takes the strings of its node one after the other.
    """
    kind = ends.schema["node"].dataType.simpleString()
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depths, nodes, ids = (c.to_pylist() for c in batch.columns)
            runs: list[list] = []
            for i in range(len(ids)):
                if i and (depths[i], nodes[i]) == (depths[i - 1], nodes[i - 1]) and len(runs[-1][3]) < RUN:
                    runs[-1][3].append(str(ids[i]))
                else:
                    runs.append([depths[i], nodes[i], ids[i], [str(ids[i])]])
            columns = [[r[k] for r in runs] for k in range(3)] + [[",".join(r[3]) for r in runs]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, batch.column(1).type) for c in columns[1:3]), pa.array(columns[3], pa.string())], ["depth", "node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, kind_of = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], kind_of), pa.array([sha.hexdigest()])], ["depth", "node", "ends_sha256"])

        for batch in batches:
            kind_of = batch.column(1).type
            for depth, node, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (depth, node) == at:
                    sha.update(b"," + text.encode())
                else:
                    if at is not None:
                        yield row()
                    at, sha = (depth, node), hashlib.sha256(text.encode())
        if at is not None:
            yield row()

    strings = ends.select("depth", "node", "conv_id").repartitionByRange(n, "depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id").mapInArrow(join, f"depth long, node {kind}, first {kind}, ids string")
    return strings.repartition(n, "depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(digest, f"depth long, node {kind}, ends_sha256 string")


def trie(steps: DataFrame) -> DataFrame:
    """steps(conv_id, depth from 1, key, words), as ``turns`` or ``rebuilt`` give them -> a row per node of the prefix trie:

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. The root is
    the node of depth 0, which all conversations belong to; without conversations there is none. ``saved_tokens`` is what a
    node and those below it save if each turn is stored, or computed, once a node instead of once a conversation.

    A row with a null depth is a conversation without turns: it is a member of the root and ends there. Rows need no order;
    other columns are ignored. Ids may be of any type that orders; they are written in decimal, as text, in the hashes.
    """
    steps = keep(steps, "steps")
    none = hashlib.sha256(b"").hexdigest()
    # each key is hashed together with its depth, as the order of what is added up does not show
    total = F.struct(F.count("depth").alias("length"), *(F.bit_xor(F.xxhash64(F.lit(seed), "depth", "key")).alias(f"h{seed}") for seed in (1, 2)))
    convs = keep(steps.groupBy("conv_id").agg(total.alias("whole")).select("conv_id", "whole", F.col("whole.length").alias("length")), "convs")
    top = convs.agg(F.min("conv_id").alias("top"), F.count("*").alias("n")).first()
    if top.n == 0:
        kind = steps.schema["conv_id"].dataType.simpleString()
        return steps.sparkSession.createDataFrame([], f"conv_id {kind}, depth long, parent_conv_id {kind}, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    live = convs.withColumn("node", F.lit(top.top).cast(convs.schema["conv_id"].dataType))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "words"]
    levels, tails, ends, depth = [], [], [live.where("length = 0").select(F.lit(0).cast("long").alias("depth"), "node", "conv_id")], 0
    live, spent = live.where("length > 0"), []
    while True:
        depth += 1
        turn = steps.where(F.col("depth") == depth).drop("depth")
        moved = live.withColumnRenamed("node", "parent").hint("merge").join(turn, "conv_id")
        groups = moved.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.first("words").alias("words"), F.min("whole").alias("low"), F.max("whole").alias("high"))
        groups = keep(groups, "level")
        placed = keep(moved.drop("words").hint("merge").join(groups.select("parent", "key", "node", (F.col("low") == F.col("high")).alias("equal")), ["parent", "key"]).drop("parent", "key"), "live")
        levels.append(groups.select(F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "words"))
        same = groups.where("low = high").select("node", "n_convs", F.col("low.length").alias("length"))
        # below a group of equal conversations there is one node a depth, named by the same member
        below = same.where(F.col("length") > depth).withColumnRenamed("node", "conv_id").hint("merge").join(steps.where(F.col("depth") > depth), "conv_id")
        tails.append(below.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", "words"))
        ends.append(placed.where(F.col("equal") | (F.col("length") == depth)).select(F.col("length").cast("long").alias("depth"), "node", "conv_id"))
        live = placed.where(~F.col("equal") & (F.col("length") > depth)).drop("equal")
        spent += [placed, groups]
        if live.isEmpty():
            break

    # a tail saves and has one leaf as a whole; each of its nodes takes what stands at or below it
    tail = tails[0].select(columns)
    for more in tails[1:]:
        tail = tail.unionByName(more.select(columns))
    at = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    own = (F.col("n_convs") - 1) * F.col("words")
    tail = keep(
        tail.select(*columns, F.sum(own).over(at).alias("saved_tokens"), (F.row_number().over(at) > 1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves")), "tails"
    )
    done, lower = [], None
    for level in reversed(range(len(levels))):
        here = levels[level]
        under = tail.where(F.col("depth") == level + 2)
        if lower is not None:
            under = under.select(lower.columns).unionByName(lower)
        sums = under.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        full = here.hint("merge").join(sums, "conv_id", "left").select(
            *columns, (own + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves")
        )
        lower = keep(full, "rolled")
        done.append(lower)
    first = lower.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = first.select(
        F.lit(top.top).cast(convs.schema["conv_id"].dataType).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast(convs.schema["conv_id"].dataType).alias("parent_conv_id"), F.lit(top.n).cast("long").alias("n_convs"), "n_children",
        F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
    )
    wanted = root.columns
    nodes = root
    for part in [*done, tail]:
        nodes = nodes.unionByName(part.select(wanted))
    stops = ends[0]
    for part in ends[1:]:
        stops = stops.unionByName(part)
    hashed = keep(_hashed(stops).withColumnRenamed("node", "conv_id"), "ends")
    out = keep(nodes.join(hashed, ["conv_id", "depth"], "left").select(*wanted, F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")), "trie")
    for part in [*spent, *done, tail, hashed, convs, steps]:
        forget(part)
    return out

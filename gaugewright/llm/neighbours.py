"""Embedding near-duplicates by NN-descent.

Equal vectors become one node with a weight. Lists of the ``k`` nearest neighbours start from random-hyperplane buckets
(long buckets are split by hash) and are refined by joining neighbours of neighbours until few entries change and an
audit against all vectors finds enough of the true links. Links at the threshold give components. A list whose entries
all pass the threshold is saturated: it says neither how many links there are nor whether some lead to other components.
So the saturated nodes of different components are compared with each other, exactly: balls of linked nodes are cut within
components, balls too far apart by their radii are passed over, the rest are compared node by node. If the audit still
misses its target after the last round, all nodes take part in that. Then every component's lists are enlarged to the
whole component: its blocks are counted as a whole where they are close or far enough, else compared vector by vector, and
the link counts are exact within it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep
from .graph import connected_components

BUCKET = 128  #: most vectors compared at once while lists start
BLOCK = 1024  #: side of the squares in which a component is compared
EDGE = "u long, v long, cos double"


def _unit(batch) -> np.ndarray:
    """Unit rows in double precision of the list column ``vec``; all rows of a group have one length."""
    x = batch.column("vec").combine_chunks()
    x = np.asarray(x.flatten(), np.float64).reshape(batch.num_rows, -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], Iterator[dict]], schema: str, names: list[str]) -> DataFrame:
    """Apply ``work`` to each group of equal keys; a group arrives whole, groups are bounded by their callers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            at = _breaks(table, keys)
            found = [x for a, b in zip(at, at[1:], strict=False) for x in [work(table.slice(a, b - a))] if x is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in found])) for i in range(len(names))], names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            cut = _breaks(table, keys)[-2] if table.num_rows else 0
            rest = table.slice(cut)
            if cut:
                yield from emit(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from emit(rest)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _breaks(table: pa.Table, keys: list[str]) -> list[int]:
    if not table.num_rows:
        return [0]
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return [*np.flatnonzero(new).tolist(), table.num_rows]


def _best(table: pa.Table, most: int) -> tuple | None:
    """The ``most`` nearest others of each row within its group, as (u, v, cos)."""
    n = table.num_rows
    if n < 2:
        return None
    ids, cos = table.column("node").to_numpy(), (x := _unit(table)) @ x.T
    np.fill_diagonal(cos, -2)
    m = min(most, n - 1)
    near = np.argpartition(-cos, m - 1, axis=1)[:, :m]
    return np.repeat(ids, m), ids[near].reshape(-1), np.take_along_axis(cos, near, axis=1).reshape(-1)


def _first_lists(nodes: DataFrame, n: int, k: int, tables: int) -> DataFrame:
    bits = max(1, ceil(log2(max(2, n / 32))))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            ids, vecs, dims = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                pick = pa.array(np.flatnonzero(dims == dim))
                part, who = vecs.take(pick), ids.take(pick)
                x = np.asarray(part.flatten(), np.float64).reshape(len(pick), dim)
                for t in range(tables):
                    if (t, dim) not in planes:
                        planes[t, dim] = np.random.default_rng((t, dim)).standard_normal((dim, bits))
                    code = ((x @ planes[t, dim]) > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    same = lambda v, m=len(pick): pa.array(np.full(m, v, np.int64))
                    yield pa.RecordBatch.from_arrays([who, part, same(dim), same(t), pa.array(code)], ["node", "vec", "dim", "t", "code"])

    rows = nodes.select("node", "vec", F.size("vec").cast("long").alias("dim")).mapInArrow(hashed, f"node long, vec {nodes.schema['vec'].dataType.simpleString()}, dim long, t long, code long")
    rows = keep(rows, "hashed")
    sizes = rows.groupBy("dim", "t", "code").agg(F.ceil(F.count("*") / BUCKET).alias("parts")).where("parts > 1")
    split = rows.join(sizes, ["dim", "t", "code"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node", "t"), "parts"), F.lit(0)))
    return _groups(split, ["dim", "t", "code", "part"], lambda g: _best(g, k), EDGE, ["u", "v", "cos"])


def _top(edges: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("u").orderBy(F.desc("cos"), "v")
    return edges.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _refine(lists: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One round: compare the neighbours, in both directions, of each node with each other."""
    back = lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "cos")
    back = back.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v"), "v"))).where(F.col("rank") <= k).drop("rank")
    around = lists.select("u", "v").union(back.select("u", "v")).distinct()
    seen = around.select(F.col("u").alias("center"), F.col("v").alias("node")).join(nodes.select("node", "vec"), "node")
    found = _groups(seen, ["center"], lambda g: _best(g, max(3, k // 2)), EDGE, ["u", "v", "cos"])
    return _top(lists.union(found), k)


def _parts(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component) of every node with a link."""
    part = connected_components(links)
    return keep(part.union(part.select("component", "component").distinct()), "parts")


def _balls(table: pa.Table, threshold: float) -> tuple:
    """Cut rows of one component into balls of half the threshold's angle, as (node, ball, radius); a ball is named by its centre."""
    x, ids = _unit(table), table.column("node").to_numpy()
    near, free = np.cos(np.arccos(threshold) / 2), np.arange(len(ids))
    ball, radius = np.empty(len(ids), np.int64), np.empty(len(ids))
    while len(free):
        cos = x[free] @ x[free[0]]
        cos[0] = 1
        inside = cos >= near
        ball[free[inside]], radius[free[inside]] = ids[free[0]], np.arccos(min(1.0, cos[inside].min()))
        free = free[~inside]
    return ids, ball, radius


def _close(table: pa.Table, threshold: float) -> tuple:
    """Pairs of balls of different components that can hold a link, as (a, b, a_part, b_part, linked by their centres)."""
    x, ids, part, radius = _unit(table), table.column("ball").to_numpy(), table.column("component").to_numpy(), table.column("radius").to_numpy()
    block, cos = table.column("block").to_numpy(), x @ x.T
    reach = np.minimum(radius[:, None] + radius[None, :] + np.arccos(threshold) + 1e-6, np.pi)
    one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    once = ids[:, None] < ids[None, :] if one else block[:, None] < block[None, :]
    a, b = np.nonzero(once & (part[:, None] != part[None, :]) & ((cos >= np.cos(reach)) | (cos >= threshold)))
    return ids[a], ids[b], part[a], part[b], cos[a, b] >= threshold


def _touching(table: pa.Table, threshold: float) -> tuple | None:
    """The components of two balls, if some node of one links with some node of the other."""
    x, part = _unit(table), table.column("component").to_numpy()
    one = part == part[0]
    return (part[:1], part[~one][:1]) if (x[one] @ x[~one].T >= threshold).any() else None


def _blocks(rows: DataFrame, key: str, node: str, names: tuple[str, str] = ("block", "blocks")) -> DataFrame:
    """Deal the rows of each ``key`` into blocks of about BLOCK, and each block to every pair (i, j) of blocks that it is in."""
    block, blocks = names
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias(blocks))
    placed = rows.join(sizes, key).withColumn(block, F.pmod(F.xxhash64(node), blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    return placed.withColumn("other", other).select("*", F.least(block, "other").alias("i"), F.greatest(block, "other").alias("j"))


def _bridges(members: DataFrame, threshold: float) -> DataFrame:
    """members(component, node, vec) -> (a, b), links between components, enough to join all components that link."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    cut = _groups(placed.select("component", "block", "node", "vec"), ["component", "block"], lambda g: _balls(g, threshold), "node long, ball long, radius double", ["node", "ball", "radius"])
    cut = keep(cut.join(members, "node"), "balls")
    centres = cut.groupBy("ball").agg(F.max("radius").alias("radius")).join(members.withColumnRenamed("node", "ball"), "ball")
    dealt = _blocks(centres.withColumn("dim", F.size("vec").cast("long")), "dim", "ball")
    schema = "a long, b long, a_part long, b_part long, linked boolean"
    pairs = keep(_groups(dealt, ["dim", "i", "j"], lambda g: _close(g, threshold), schema, ["a", "b", "a_part", "b_part", "linked"]), "pairs")

    sure = pairs.where("linked").select(F.col("a_part").alias("a"), F.col("b_part").alias("b")).distinct()
    joined = _parts(sure)
    name = lambda c: joined.select(F.col("node").alias(f"{c}_part"), F.col("component").alias(f"{c}_now"))
    now = lambda c: F.coalesce(f"{c}_now", f"{c}_part")
    open_ = pairs.where("not linked").join(name("a"), "a_part", "left").join(name("b"), "b_part", "left").where(now("a") != now("b")).select("a", "b")
    both = open_.select("a", "b", F.explode(F.array("a", "b")).alias("ball")).join(cut.select("ball", "component", "vec"), "ball").drop("ball")
    found = _groups(both, ["a", "b"], lambda g: _touching(g, threshold), "a long, b long", ["a", "b"])
    return sure.union(found.distinct())


def _joined(part: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Components (node, component) after those that ``members`` link are joined."""
    more = keep(_bridges(members, threshold), "bridges")
    return part if more.isEmpty() else _parts(part.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def _audit(nodes: DataFrame, parts: DataFrame, threshold: float, sample: int) -> float | None:
    """How much of each node's true links ``parts`` connects, on the average of ``sample`` nodes with links and as many of all.

    The truth is found by comparing these nodes with every node; each counts once, so that no dense group outweighs lost
    single links. Null where none of them has a link: then nothing was measured.
    """
    order = F.xxhash64(F.lit("audit"), "node")
    linked = nodes.join(parts.select("node"), "node", "left_semi")
    asked = list({r.node: r for df in (linked, nodes) for r in df.select("node", "vec").orderBy(order).limit(sample).collect()}.values())
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r.vec) for r in asked}:
        part = [r for r in asked if len(r.vec) == dim]
        x = np.array([r.vec for r in part], np.float64)
        by_dim[dim] = np.array([r.node for r in part]), x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim, (ids, x) in by_dim.items():
                part = pa.Table.from_batches([batch]).take(np.flatnonzero(dims == dim))
                if part.num_rows:
                    cos = x @ _unit(part).T
                    i, j = np.nonzero(cos >= threshold)
                    other = part.column("node").to_numpy()[j]
                    ok = ids[i] != other
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i][ok]), pa.array(other[ok]), pa.array(cos[i, j][ok])], ["u", "v", "cos"])

    true = nodes.select("node", "vec", F.size("vec").cast("long").alias("dim")).mapInArrow(run, EDGE)
    name = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    held = F.avg(F.coalesce(F.col("u_part") == F.col("v_part"), F.lit(False)).cast("int"))
    return true.join(name("u"), "u", "left").join(name("v"), "v", "left").groupBy("u").agg(held.alias("held")).agg(F.avg("held")).first()[0]


def near_components(nodes: DataFrame, threshold: float, k: int = 10, tables: int = 8, rounds: int = 6, recall: float = 0.995, sample: int = 256) -> tuple[DataFrame, float | None]:
    """nodes(node, vec): distinct finite nonzero vectors -> ((node, component) of nodes with links, audited recall, null without a link to measure it by).

    Where the recall stays below its target, all nodes of different components are compared; the recall is then 1.
    """
    n = nodes.count()
    lists = keep(_top(_first_lists(nodes, n, k, tables), k), "lists")
    for turn in range(rounds):
        after = keep(_refine(lists, nodes, k), "lists")
        changed = after.join(lists, ["u", "v"], "left_anti").count()
        forget(lists)
        lists = after
        if changed <= 0.02 * k * n or turn == rounds - 1:
            part = _parts(lists.where(F.col("cos") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b")))
            full = lists.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n"), F.min("cos").alias("least")).where((F.col("n") >= k) & (F.col("least") >= threshold)).select("node")
            part = _joined(part, part.join(full, "node", "left_semi").join(nodes.select("node", "vec"), "node").select("component", "node", "vec"), threshold)
            audited = _audit(nodes, part, threshold, sample)
            if audited is None or audited >= recall:
                return part, audited
    everyone = nodes.select("node", "vec").join(part, "node", "left").select(F.coalesce("component", "node").alias("component"), "node", "vec")
    return _joined(part, everyone, threshold), 1.0


SURE = 1e-6  #: angles that come closer to the threshold than this are left to the vectors themselves


def _hull(table: pa.Table) -> tuple:
    """(component, block, node, radius, weight): a block's first node as its centre, the widest angle from it, and the block's weight."""
    x, ids = _unit(table), table.column("node").to_numpy()
    k = int(np.argmin(ids))
    radius = float(np.arccos(np.clip(x @ x[k], -1, 1).min()))
    key = [table.column(c).to_numpy()[:1] for c in ("component", "block")]
    return *key, ids[k : k + 1], np.array([radius]), np.array([table.column("weight").to_numpy().sum()])


def _decided(table: pa.Table, threshold: float) -> tuple:
    """(component, a, b, a_weight, b_weight, sure): pairs of blocks that hold links; sure where every pair of their vectors is linked."""
    x, block, radius = _unit(table), table.column("block").to_numpy(), table.column("radius").to_numpy()
    weight, deal = table.column("weight").to_numpy(), table.column("deal").to_numpy()
    one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    angle = np.arccos(np.clip(x @ x.T, -1, 1))
    np.fill_diagonal(angle, 0)
    once = block[:, None] <= block[None, :] if one else deal[:, None] < deal[None, :]
    limit, both = np.arccos(threshold), radius[:, None] + radius[None, :]
    a, b = np.nonzero(once & (angle - both <= limit + SURE))
    flip = block[a] > block[b]
    a, b = np.where(flip, b, a), np.where(flip, a, b)
    sure = (angle + both)[a, b] <= limit - SURE
    return np.full(len(a), table.column("component")[0].as_py()), block[a], block[b], weight[a], weight[b], sure


def _counts(members: DataFrame, threshold: float) -> DataFrame:
    """members(component, node, weight, vec) -> (node, links): exact weighted number of other nodes that each is linked with.

    A component is dealt into blocks. Blocks so close that all their vectors are linked are counted without comparing
    them, blocks too far apart are passed over, and only the rest is compared vector by vector.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = keep(members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).drop("blocks"), "placed")
    hulls = keep(_groups(placed, ["component", "block"], _hull, "component long, block long, node long, radius double, weight long", ["component", "block", "node", "radius", "weight"]), "hulls")
    dealt = _blocks(hulls.join(placed.select("node", "vec"), "node"), "component", "node", ("deal", "deals"))
    schema = "component long, a long, b long, a_weight long, b_weight long, sure boolean"
    pairs = keep(_groups(dealt, ["component", "i", "j"], lambda g: _decided(g, threshold), schema, ["component", "a", "b", "a_weight", "b_weight", "sure"]), "decided")

    near = pairs.where("sure")
    sides = near.select("component", F.col("a").alias("block"), F.col("b_weight").alias("n"), (F.col("a") == F.col("b")).alias("own")).union(near.where("a <> b").select("component", "b", "a_weight", F.lit(False)))
    known = sides.groupBy("component", "block").agg(F.sum("n").alias("n"), F.bool_or("own").alias("own"))
    counted = placed.join(known, ["component", "block"]).select("node", (F.col("n") - F.when(F.col("own"), F.col("weight")).otherwise(0)).alias("links"))
    ends = pairs.where("not sure").select("component", F.col("a").alias("i"), F.col("b").alias("j"), F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    rows = ends.join(placed, ["component", "block"])
    compared = _groups(rows, ["component", "i", "j"], lambda g: _linked(g, threshold), "node long, links long", ["node", "links"])
    return counted.union(compared).groupBy("node").agg(F.sum("links").alias("links"))


def _linked(table: pa.Table, threshold: float) -> tuple | None:
    """Weighted number of links of each row to rows of the other block, or of its own where the blocks are one."""
    x, ids = _unit(table), table.column("node").to_numpy()
    block, weight = table.column("block").to_numpy(), table.column("weight").to_numpy()
    one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    near = x @ x.T >= threshold
    near &= ~np.eye(len(ids), dtype=bool) if one else block[:, None] != block[None, :]
    return ids, near @ weight


def near_dedup(vectors: DataFrame, threshold: float = 0.9, k: int = 10) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (vec_id, n_links, component_id, kept, audited_recall), one row per input row.

    Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different lengths do
    not link, however long. Rows with equal vectors link with each other, also where they repeat a vec_id; pairs exactly at the
    threshold are linked. An empty table gives no rows. A null vec_id is kept and
    never names a component; it is ``kept`` only where no row of its component has an id. ``audited_recall`` is the same in all
    rows: the share of true links that the graph connects, or null where no audited vector has one. Other columns are ignored.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    valid = F.coalesce(finite, F.lit(False))
    nodes = keep(
        rows.where(valid).groupBy("vec").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id()), "nodes"
    )
    part, recall = near_components(nodes, threshold, k)
    if recall is not None and recall < 0.9:
        raise RuntimeError(f"the neighbour graph holds {recall:.3f} of the true links only")
    members = part.join(nodes, "node")
    names = members.groupBy("component").agg(F.min("least_id").alias("component_id"))
    counts = _counts(members.select("component", "node", "weight", "vec"), threshold)
    found = counts.join(part.join(names, "component").select("node", "component_id"), "node")
    known = nodes.join(found, "node", "left").select("vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    linked = rows.where(valid).join(known, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("audited_recall", F.lit(recall).cast("double"))

"""Near copies by word shingles: SimHash groups first, then an exact set join for what fingerprints cannot see.

A text is the set of 64-bit hashes of its shingles; texts are linked at a Jaccard similarity of four fifths or more.
SimHash (``simhash``) proposes pairs at four or fewer differing bits and verification decides. Texts at four fifths
differ in about ten of 64 bits, so no positional byte need be shared: the rest is found by prefixes. Two sets at four
fifths or more share an entry among the first ``n // 5 + 1`` of each under any order of all shingles, and their sizes
differ by a quarter at most. The order puts the most frequent shingles of a sample last, so that common lines are rarely
among the first. A pair that shares a first entry and is not yet in one component is passed over if the parities of its
entries, counted in about as many cells as entries, differ in more cells than the sets may; every other pair is verified on the whole sets,
which are made again from the texts that are asked for. The lists are paired in two steps: first each set with the one, of the
least sets of its lists, that it shares most first entries with, which joins large groups by one pair a set; then, in lists
that still hold several components, the sets of different ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep
from .graph import connected_components
from .simhash import SEED, fingerprint_links, majority, shingle_hashes

CELLS = 1024  #: fewest parity cells; a set has as many as entries, up to the next power of two
SAMPLE = 8  #: one in so many texts tells which shingles are frequent
FREQUENT = 1 << 20  #: most shingles put last; the order decides the work, not the result
ASKED_ROWS = 1 << 20  #: up to so many hashes of texts (8 MB) are broadcast, more are joined


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of UTF-8 ``text``; a shorter text is one shingle, one without words none."""
    return np.unique(shingle_hashes(text, width).view(np.int64))


def _node(entries: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(entries.tobytes(), SEED) - (1 << 63)


def _bodies(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("body"))


def _facts(docs: DataFrame, width: int, late: np.ndarray) -> DataFrame:
    """A row per document: name, size, fingerprint and parities of its set, and the set's first entries, those in the sorted ``late`` last.

    The first entries are split into rare ones and late ones, and given once for equal sets of one task.
    """
    held = docs.sparkSession.sparkContext.broadcast(late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                nodes, sizes, fps, odd, rare, common = [], [], [], [], [], []
                for text in part.column(1).to_pylist():
                    hashes = shingle_hashes(text, width)
                    x = np.unique(hashes.view(np.int64))
                    node = _node(x)
                    last = np.zeros(len(x), bool)
                    if len(held.value) and len(x):
                        last = held.value[np.minimum(np.searchsorted(held.value, x), len(held.value) - 1)] == x
                    most = 0 if node in seen or not len(x) else len(x) // 5 + 1
                    seen.add(node)
                    nodes.append(node)
                    sizes.append(len(x))
                    fps.append(majority(hashes))
                    cells = max(CELLS, 1 << len(x).bit_length())
                    odd.append(np.packbits(np.bincount(x & (cells - 1), minlength=cells) & 1 == 1).view(np.int64))
                    rare.append(x[~last][:most])
                    common.append(x[last][: max(0, most - len(rare[-1]))])
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (odd, rare, common)]
                ints = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *ints, *lists], ["doc_id", "body", "node", "n", "fp", "odd", "rare", "late"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return _bodies(docs).mapInArrow(run, f"doc_id {key}, body long, node long, n long, fp long, odd array<long>, rare array<long>, late array<long>")


def _sets(bodies: DataFrame, width: int) -> DataFrame:
    """(node, entries): the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [shingles(t, width) for t in batch.column(0).slice(at, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "entries"])

    return bodies.select("text").mapInArrow(run, "node long, entries array<long>")


def _frequent(docs: DataFrame, width: int, least: int) -> np.ndarray:
    """The shingles that more than ``least`` texts hold, as a sample of the texts has it; at most FREQUENT, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [x[: len(x) // 5 + 1] for x in (shingles(t, width) for t in set(batch.column(0).slice(at, 512).to_pylist()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["h"])

    some = _bodies(docs).where(F.pmod("body", F.lit(SAMPLE)) == 0).select("text")
    plain = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") > least // SAMPLE)
    return np.sort(np.array([r.h for r in plain.orderBy(F.desc("count"), "h").limit(FREQUENT).select("h").collect()], np.int64))


def _shared(facts: DataFrame) -> DataFrame:
    """(h, node, n, pos, low): the first entries that several sets have, with their place in the set's order and the least of those sets.

    Rare entries are shuffled once, by entry: no list of theirs is long. Late ones may be held by very many sets: their
    repeats are removed and their numbers counted before they meet.
    """
    rare = facts.select(F.posexplode("rare").alias("pos", "h"), "node", "n").repartition("h").distinct()
    late = facts.select(F.size("rare").alias("before"), F.posexplode("late").alias("at", "h"), "node", "n")
    late = keep(late.select((F.col("before") + F.col("at")).alias("pos"), "h", "node", "n").distinct(), "late")
    with_lengths = lambda rows: rows.hint("merge").join(rows.groupBy("h").agg(F.count("*").alias("count"), F.min("node").alias("low")).where("count > 1").drop("count"), "h")
    out = keep(with_lengths(rare).union(with_lengths(late)), "shared")
    forget(late)
    return out


def _differ():
    """Number of cells whose parities differ, for a_odd and b_odd of sets whose sizes allow four fifths; a lower bound of the entries that differ."""
    half = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, F.size(x)), lambda x, y: x.bitwiseXOR(y))
    fit = lambda x, y: F.when(F.size(x) > F.size(y), half(F.col(x))).otherwise(F.col(x))  # noqa: E731  one has twice the cells of the other at most
    return F.aggregate(F.zip_with(fit("a_odd", "b_odd"), fit("b_odd", "a_odd"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


SIZED = "4 * a_n <= 5 * b_n and 4 * b_n <= 5 * a_n"  #: sizes that allow four fifths


def _verified(pairs: DataFrame, one: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) whose Jaccard similarity is four fifths or more."""
    facts = lambda c: one.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("odd").alias(f"{c}_odd"))
    able = pairs.distinct().join(facts("a"), "a").join(facts("b"), "b").where(SIZED).where(9 * _differ() <= F.col("a_n") + F.col("b_n"))
    able = keep(able.select("a", "b"), "pairs")
    if able.isEmpty():
        return able
    asked = keep(able.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(one, "node").select("body").distinct(), "asked")
    few = F.broadcast(asked) if asked.count() <= ASKED_ROWS else asked
    whole = keep(_sets(_bodies(docs).join(few, "body", "left_semi"), width).groupBy("node").agg(F.any_value("entries").alias("entries")), "whole")
    side = lambda c: whole.select(F.col("node").alias(c), F.col("entries").alias(f"{c}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    found = able.join(side("a"), "a").join(side("b"), "b").where(9 * both >= 4 * (F.size("a_set") + F.size("b_set")))
    links = keep(found.select("a", "b"), "links")
    for table in (able, asked, whole):
        forget(table)
    return links


def _parts(links: DataFrame) -> DataFrame:
    found = connected_components(links)
    return keep(found.union(found.select("component", "component").distinct()), "parts")


def _apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not in one component."""
    name = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    return pairs.join(name("a"), "a", "left").join(name("b"), "b", "left").where(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b")


def near_copies(docs: DataFrame, width: int = 5, frequent: int = 48) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, component_id), one row per input row; components of links at Jaccard >= 0.8.

    Null, empty and blank texts are equal to each other. Texts of fewer words than ``width`` are one shingle. Repeated rows
    stay, each with the same result. A null doc_id never names a component (null if no member has an id). Whole texts are
    read, however long; other columns are ignored. An empty table gives no rows.
    """
    rows = keep(_facts(docs, width, _frequent(docs, width, frequent)), "facts")
    one = keep(rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("body").alias("body"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("odd").alias("odd")), "distinct")

    least = one.groupBy("fp").agg(F.min("node").alias("least"))
    near = fingerprint_links(least.select("fp"))
    ends = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node"))
    close = near.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    equal = one.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links = _verified(close.union(equal), one, docs, width)
    part = _parts(links)

    shared = _shared(rows)
    tally = shared.where("node <> low").groupBy("node", "low").agg(F.count("*").alias("n"))
    best = tally.groupBy("node").agg(F.min_by("low", F.struct(-F.col("n"), F.col("low"))).alias("low"))
    links = links.union(_verified(_apart(best.select(F.col("low").alias("a"), F.col("node").alias("b")), part), one, docs, width))
    part = _parts(links)

    named = keep(shared.select("h", "node", "n", "pos").join(part, "node", "left").select("h", "node", "n", "pos", F.coalesce("component", "node").alias("part")), "named")
    mixed = named.groupBy("h").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("h")
    rest = _pairs(keep(named.join(mixed, "h", "left_semi").join(one.select("node", "odd"), "node"), "mixed"))
    more = _verified(rest, one, docs, width)
    part = part if more.isEmpty() else _parts(links.union(more))
    forget(shared)

    named = one.select("node", "least_id").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = keep(named.join(names, "component").select("node", "component_id"), "names")
    return rows.select("doc_id", "node").join(known, "node").select("doc_id", "component_id")


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of one list that are not in one component and pass every bound that the rows hold.

    Sizes must allow four fifths; the smaller set (by size, then name) must hold the entry among its first ninth, since it
    shares eight ninths of its entries at least; parities must not differ in more cells than the sets may.
    """
    columns = ["node", "n", "pos", "part", "odd"]
    left, right = (rows.select("h", *(F.col(x).alias(c if x == "node" else f"{c}_{x}") for x in columns)) for c in "ab")
    smaller = "a_n < b_n or (a_n = b_n and a < b)"  # once a pair
    early = "a_pos <= a_n - ceil(8 * a_n / 9)"
    met = left.hint("merge").join(right, "h").where(f"a <> b and a_part <> b_part and ({smaller}) and {early} and {SIZED}")
    return met.where(9 * _differ() <= F.col("a_n") + F.col("b_n")).select("a", "b").distinct()

"""SimHash near-duplicate groups through an inverted index of positional bytes with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints at four or fewer differing bits differ in at most
four bytes, so they share at least four (position, byte) entries: that is the guaranteed minimum. Posting lists of
single bytes hold 1/256 of the corpus and do not scale. Of any seven positions a pair must share three, and of eight four, so the
index is keyed by the 35 choices of three of the first seven positions, or by the 70 of four of eight: pairs that meet by
chance grow with the square of the corpus over 2^24 or 2^32, and the longer keys take over where the shorter ones would give
a fingerprint dozens of chance partners. A pair that meets in a list is taken once, under the first positions that it
shares, its shared bytes are tallied over all eight positions, pairs below the minimum of four are dropped, and the rest is
verified bit by bit. Both keys give the same links.

Fingerprints in a posting list much longer than chance makes it (a dense group of near copies) are not paired there.
They are linked through midpoints: two words are within four bits exactly if some word lies within two bits of both,
and all words within two bits of one midpoint are within four bits of each other. Each such fingerprint emits 2081
midpoints and is linked to the least fingerprint of each, so the work is linear in the size of the group and no link is
lost. Both ways run through shuffled joins; nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep
from .graph import connected_components

MAX_BITS = 4
SEED = 42
LEAST_SHARED = 4  #: positional bytes that every wanted pair shares
LONG_KEYS = 1 << 26  #: fingerprints from which keys have four bytes instead of three


def _masks(key_bytes: int) -> list[int]:
    """Choices of so many of the first positions that every wanted pair shares one: among key_bytes + 4 positions it shares key_bytes."""
    return [sum(0xFF << 8 * p for p in chosen) for chosen in combinations(range(key_bytes + 8 - LEAST_SHARED), key_bytes)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each word shingle of UTF-8 ``text``, repeats included; a shorter text is one shingle, one without words has none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begins = [0, *(gaps[: len(words) - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(joined)]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, ends, strict=True)), np.uint64, len(begins))


def majority(hashes: np.ndarray) -> int:
    """Unsigned word whose bits are set in over half of ``hashes``; zero for none."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 ``text``: majority of the bits of its word-shingle hashes; 0 without words."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp long), a row per input row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _midpoints(fps: DataFrame) -> DataFrame:
    """(fp, mid) for each word within two bits of fp: bits i < j flipped, where bit 64 stands for none."""
    bit = lambda c: f"if({c} < 64, shiftleft(1L, {c}), 0L)"
    first = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    both = first.select("fp", "i", F.explode(F.sequence(F.least(F.col("i") + 1, F.lit(64)), F.lit(64))).alias("j"))
    return both.select("fp", F.col("fp").bitwiseXOR(F.expr(bit("i"))).bitwiseXOR(F.expr(bit("j"))).alias("mid"))


def fingerprint_links(fps: DataFrame, posting_limit: int = 48, key_bytes: int | None = None) -> DataFrame:
    """Distinct fps(fp) -> edges (a, b), written, whose connected components are those of all pairs at <= 4 differing bits.

    ``posting_limit`` is what a list may hold beyond four times its expected length; longer ones go through midpoints.
    ``key_bytes`` is three, or four from LONG_KEYS fingerprints on, unless given.
    """
    n = fps.count()
    key_bytes = key_bytes or (3 if n < LONG_KEYS else 4)
    limit = posting_limit + 4 * n / (1 << 8 * key_bytes)
    masks = F.array(*(F.lit(_signed(m)) for m in _masks(key_bytes)))
    postings = fps.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("which", "part")).select("fp", F.col("which").cast("byte").alias("which"), "part")
    lengths = postings.groupBy("which", "part").count().where("count > 1")
    shared = keep(postings.hint("merge").join(lengths, ["which", "part"]), "postings")

    short = shared.where(F.col("count") <= limit).drop("count")
    left, right = short.withColumnRenamed("fp", "a"), short.withColumnRenamed("fp", "b")
    xor = F.col("a").bitwiseXOR(F.col("b"))
    same = [F.when(xor.bitwiseAND(F.lit(_signed(0xFF << 8 * p))) == 0, 1).otherwise(0) for p in range(8)]
    tally = sum(same[1:], same[0])
    first, seen = F.lit(0).cast("long"), F.lit(0)
    for p in range(key_bytes + 8 - LEAST_SHARED):
        first = F.when((same[p] == 1) & (seen < key_bytes), first.bitwiseOR(F.lit(_signed(0xFF << 8 * p)))).otherwise(first)
        seen = seen + same[p]
    pairs = (
        left.hint("merge")
        .join(right, ["which", "part"])
        .where((F.col("a") < F.col("b")) & (tally >= LEAST_SHARED))
        .where((F.element_at(masks, F.col("which").cast("int") + 1) == first) & (F.bit_count(xor) <= MAX_BITS))
        .select("a", "b")
    )

    near = _midpoints(shared.where(F.col("count") > limit).select("fp").distinct())
    least = near.groupBy("mid").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
    stars = near.hint("merge").join(least, "mid").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    edges = keep(pairs.union(stars), "links")
    forget(shared)
    return edges


def near_dedup(docs: DataFrame, width: int = 4, posting_limit: int = 48) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fingerprint, component_id), one row per input row.

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows stay, each with the same
    result. A null doc_id is kept and never names a component (null if no member has an id). Very long texts are read
    whole, their shingle hashes are summed piece by piece. Other columns are ignored.
    """
    fps = keep(fingerprints(docs, width), "fingerprints")
    distinct = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    parts = keep(connected_components(fingerprint_links(distinct.select("fp"), posting_limit)), "components")
    members = parts.select(F.col("node").alias("fp"), "component").union(parts.select(F.col("component").alias("fp"), "component").distinct())
    named = members.join(distinct, "fp").groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked = members.join(named, "component").select("fp", "component_id")
    names = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    named_fps = keep(names, "names")  # written, so that the join can split a fingerprint of very many copies
    return fps.join(named_fps, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

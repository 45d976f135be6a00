"""Differences of text files line by line, as an edit script.

A row holds both texts of a file, so nothing is shuffled: equal heads and tails are cut off by array functions, and what is
left between them is matched along a longest common subsequence. That matching is exact: anchors of unique lines alone would
lose lines where repeated ones cross.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _row_of(a: list[int], b: list[int]) -> list[int]:
    """For each j, the length of the longest common subsequence of a and b[:j]; bit vectors over b, one addition a line of a."""
    places = defaultdict(int)
    for j, x in enumerate(b):
        places[x] |= 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    row = [0]
    for bit in reversed(f"{v:0{len(b)}b}" if b else ""):
        row.append(row[-1] + (bit == "0"))
    return row


def common_places(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence of two lists, in order; halved again and again, so memory is linear."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, n = todo.pop()
        if i == k or j == n:
            continue
        if k - i == 1:
            at = next((y for y in range(j, n) if b[y] == a[i]), None)
            found += [] if at is None else [(i, at)]
            continue
        middle = (i + k) // 2
        upper, lower = _row_of(a[i:middle], b[j:n]), _row_of(a[middle:k][::-1], b[j:n][::-1])
        cut = max(range(n - j + 1), key=lambda y: upper[y] + lower[n - j - y])
        todo += [(i, middle, j, j + cut), (middle, k, j + cut, n)]
    return sorted(found)


def unmatched(old: list[str], new: list[str]) -> tuple[list[int], list[int]]:
    """Places of old lines to remove and of new lines to add: all that a longest common subsequence leaves out. Lines that only one side has take no part in it."""
    both = set(old) & set(new)
    known = {line: n for n, line in enumerate(both)}
    a, b = ([(n, known[line]) for n, line in enumerate(lines) if line in known] for lines in (old, new))
    kept = common_places([code for _, code in a], [code for _, code in b])
    here, there = {a[i][0] for i, _ in kept}, {b[j][0] for _, j in kept}
    return [n for n in range(len(old)) if n not in here], [n for n in range(len(new)) if n not in there]


def _changes(olds: pa.Array, news: pa.Array) -> pa.Array:
    found = [unmatched(a, b) for a, b in zip(olds.to_pylist(), news.to_pylist(), strict=True)]
    return pa.array([{"i": i, "j": j} for i, j in found], pa.struct([("i", pa.list_(pa.int32())), ("j", pa.list_(pa.int32()))]))


def edit_script(files: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """files(key, old, new) -> (key, change, place, line): lines removed from the old text and added by the new one.

    ``place`` counts lines of the text that holds the line, from 1. As few lines as possible change; among equally short
    scripts any one is given, always the same. A null text has no lines, an empty one neither; a line break at the end opens
    no further line. Rows under a null key are left out. The two texts of a row must fit a task.
    """
    none = F.array().cast("array<string>")
    split = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.split(F.regexp_replace(c, "\\r?\\n\\z", ""), "\\r?\\n")).otherwise(none)
    pairs = files.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), split(old).alias("old"), split(new).alias("new")).where("old <> new")
    # unequal lists differ at some place, at the latest where the shorter one ends
    agree = lambda a, b: F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int") - 1
    ends = pairs.withColumn("head", agree("old", "new")).withColumn("tail", F.least(agree(F.reverse("old"), F.reverse("new")), F.least(F.size("old"), F.size("new")) - F.col("head")))
    inner = lambda c: F.slice(c, F.col("head") + 1, F.size(c) - F.col("head") - F.col("tail"))
    middles = ends.select("k", "head", inner("old").alias("old"), inner("new").alias("new")).withColumn("c", F.arrow_udf(_changes, "struct<i array<int>, j array<int>>")(F.col("old"), F.col("new")))
    told = lambda change, side, places: F.transform(places, lambda n: F.struct(F.lit(change).alias("change"), (F.col("head") + n + 1).alias("place"), F.get(F.col(side), n).alias("line")))
    every = F.concat(told("removed", "old", F.col("c.i")), told("added", "new", F.col("c.j")))
    return middles.select(F.col("k").alias(key), F.explode(every).alias("e")).select(key, "e.change", "e.place", "e.line")


def change_counts(files: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """files(key, old, new) -> (key, added long, removed long), every key once; as in a unified diff's count, added lines that begin with + and removed ones that begin with - are taken for headers."""
    script = edit_script(files, key, old, new)
    n = lambda change, sign: F.count(F.when((F.col("change") == change) & ~F.startswith("line", F.lit(sign)), 1))
    counts = script.groupBy(key).agg(n("added", "+").alias("added"), n("removed", "-").alias("removed"))
    return files.select(key).where(F.col(key).isNotNull()).join(counts, key, "left").fillna(0, ["added", "removed"])


def hunks(script: DataFrame, key: str) -> DataFrame:
    """An edit script's runs of lines without a kept line between -> (key, change, first, lines): as the lines of one side stand together."""
    w = Window.partitionBy(key, "change").orderBy("place")
    runs = script.withColumn("run", F.col("place") - F.row_number().over(w))
    return runs.groupBy(key, "change", "run").agg(F.min("place").alias("first"), F.count("*").alias("lines")).drop("run")

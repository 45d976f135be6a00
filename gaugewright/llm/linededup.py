"""Removal of repeated line runs through a suffix array over line ids.

Distributed prefix doubling ranks the suffixes of every document's line sequence by their first 1, 2, 4, ... lines: the
ranks of a round are the order of (rank here, rank 2^k lines on). Suffixes that no other suffix equals so far have a
longest common prefix below 2^k with all others; they leave, so later rounds hold repeated runs only. Suffixes that
agree on m lines form a longest-common-prefix interval of depth m, named by two overlapping ranks.

A run of lines is removed where it holds ``min_words`` words or more and the same lines stand earlier in the corpus. A
run is covered by its shortest parts of that many words, from each of its lines forward and backward. So it is enough to
look up the intervals of those parts, and doubling stops at ``min_words`` lines. Maximal removed runs are their unions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

DOC = ["absent", "doc", "sum"]
POS = ["absent", "doc", "sum", "seq"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Document key: ids in order, null ids last; rows that repeat id and text are one document."""
    kind = docs.schema["doc_id"].dataType
    return docs.select(F.col("doc_id").isNull().alias("absent"), F.coalesce("doc_id", F.lit(0).cast(kind)).alias("doc"), F.xxhash64("text").alias("sum"), F.col("text").alias("body"))


def _lines(docs: DataFrame) -> DataFrame:
    """A row per line with words: document key, number among such lines, number among all lines, 128-bit id, words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                row, seq, line, words, ids = [], [], [], [], []
                for i, text in enumerate(part.column(3).to_pylist()):
                    n = 0
                    for at, x in enumerate(text.split(b"\n") if text else ()):
                        if count := len(x.split()):
                            row.append(i)
                            seq.append(n)
                            line.append(at)
                            words.append(count)
                            ids.append(xxhash.xxh3_128_digest(x.strip()))
                            n += 1
                halves = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
                ints = lambda x: pa.array(x, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(row, pa.int64())) for c in range(3)), ints(seq), ints(line), ints(words), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                    [*POS, "line", "words", "r1", "r2"],
                )

    keyed = _keyed(docs).withColumn("body", F.col("body").cast("binary"))
    return keyed.mapInArrow(run, f"absent boolean, doc {kind}, sum long, seq int, line int, words int, r1 long, r2 long")


def _ranked(pairs: DataFrame) -> DataFrame:
    """Rank the repeated (r1, r2) in their order, over the whole corpus."""
    classes = pairs.groupBy("r1", "r2").agg(F.min(F.struct(*POS)).alias("low"), F.max(F.struct(*POS)).alias("high")).where("low < high").select("r1", "r2")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return classes.repartitionByRange(n, "r1", "r2").sortWithinPartitions("r1", "r2").withColumn("rank", F.monotonically_increasing_id())


def _double(ranks: DataFrame, half: int) -> DataFrame:
    """Ranks by the first 2 * half lines from ranks by the first ``half``."""
    later = ranks.select(*DOC, (F.col("seq") - half).alias("seq"), F.col("rank").alias("r2"))
    pairs = keep(ranks.withColumnRenamed("rank", "r1").join(later, POS), "pairs")
    return keep(pairs.join(keep(_ranked(pairs), "classes"), ["r1", "r2"]).select(*POS, "rank"), "ranks")


def _parts(repeated: DataFrame, min_words: int) -> DataFrame:
    """Shortest runs of consecutive repeated lines with ``min_words`` words, from each line forward and backward."""
    kind = repeated.schema["doc"].dataType.simpleString()

    def cut(seq: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int]]:
        for stretch in np.split(np.arange(len(seq)), np.flatnonzero(np.diff(seq) != 1) + 1):
            total = np.concatenate([[0], np.cumsum(words[stretch])])
            if total[-1] < min_words:
                continue
            n, at = len(stretch), int(stretch[0])
            ends = np.searchsorted(total, total[:n] + min_words)
            starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
            found = {(at + i, at + int(e)) for i, e in enumerate(ends) if e <= n} | {(at + int(s), at + e + 1) for e, s in enumerate(starts) if s >= 0}
            yield from sorted(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                row, first, count, lines = [], [], [], []
                for i, found in enumerate(part.column(3).to_pylist()):
                    found.sort(key=lambda x: x["seq"])
                    seq, words = np.array([x["seq"] for x in found]), np.array([x["words"] for x in found])
                    for a, b in cut(seq, words):
                        row.append(i)
                        first.append(int(seq[a]))
                        count.append(b - a)
                        lines.append([x["line"] for x in found[a:b]])
                ints = lambda x: pa.array(x, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(row, pa.int64())) for c in range(3)), ints(first), ints(count), pa.array(lines, pa.list_(pa.int32()))], [*POS, "m", "lines"]
                )

    grouped = repeated.groupBy(*DOC).agg(F.collect_list(F.struct("seq", "line", "words")).alias("found"))
    return grouped.mapInArrow(run, f"absent boolean, doc {kind}, sum long, seq int, m int, lines array<int>")


def removed_lines(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """docs(doc_id, text, ...) -> (absent, doc, sum, removed array<int>) of the documents that lose lines."""
    lines = keep(_lines(docs), "lines")
    repeated = keep(lines.join(keep(_ranked(lines), "classes"), ["r1", "r2"]).select(*POS, "line", "words", "rank").dropDuplicates(POS), "repeated")
    levels, ranks, half = repeated.select(*POS, "rank", F.lit(0).alias("level")), repeated.select(*POS, "rank"), 1
    while 2 * half <= min_words and not ranks.isEmpty():
        ranks = _double(ranks, half)
        half *= 2
        levels = levels.union(ranks.withColumn("level", F.lit(half.bit_length() - 1)))
    level = F.floor(F.log2(F.col("m") + F.lit(0.5))).cast("int")
    parts = keep(_parts(repeated, min_words).withColumn("level", level), "parts")
    tail = F.col("seq") + F.col("m") - F.expr("cast(shiftleft(1, level) as int)")
    first = levels.select(*POS, "level", F.col("rank").alias("r1"))
    last = levels.select(*DOC, F.col("seq").alias("tail"), "level", F.col("rank").alias("r2"))
    named = keep(parts.withColumn("tail", tail).join(first, [*POS, "level"]).join(last, [*DOC, "tail", "level"]).select(*POS, "m", "lines", "r1", "r2"), "named")
    earliest = named.groupBy("m", "r1", "r2").agg(F.min(F.struct(*POS)).alias("low"), F.max(F.struct(*POS)).alias("high")).where("low < high").drop("high")
    later = named.join(earliest, ["m", "r1", "r2"]).where(F.struct(*POS) > F.col("low"))
    gone = later.select(*DOC, F.explode("lines").alias("line")).distinct()
    return gone.groupBy(*DOC).agg(F.array_sort(F.collect_list("line")).alias("removed"))


def line_dedup(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """All rows and columns of docs, with ``text`` cleaned and two more columns: lines_total and lines_removed (numbers from 0).

    Lines end at newline and are compared without surrounding blanks; lines without words never match, break no run and
    stay. The first copy of a run, by doc_id (nulls last) and line, stays. Rows that repeat doc_id and text are one
    document, and each of them gets its result. Null and empty texts stay as they are. A document whose lines all go
    keeps an empty text; very long texts are cut into lines as a whole. Extra columns are carried along, whatever their names.
    """
    taken = set(docs.columns) & {"lines_total", "lines_removed"}
    gone = removed_lines(docs, min_words)
    kind = docs.schema["doc_id"].dataType
    key = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0).cast(kind)), F.xxhash64("text")]
    own = "gw_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    names = {c: own + c for c in (*DOC, "removed")}
    removed = F.col(own + "removed")
    side = gone.select(*(F.col(c).alias(n) for c, n in names.items()))
    matched = (key[0] == F.col(own + "absent")) & (key[1] == F.col(own + "doc")) & (key[2] == F.col(own + "sum"))
    joined = docs.drop(*taken).join(side, matched, "left")
    parts = F.split("text", "\n")
    rest = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(removed, i)), "\n")
    lone = F.size(removed) == F.size(F.filter(parts, lambda x: x.rlike(r"[^ \t\r\x0b\x0c]")))
    cleaned = F.when(removed.isNull(), F.col("text")).when(lone, F.lit("")).otherwise(rest)
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).alias("lines_total")
    columns = [cleaned.alias("text") if c == "text" else F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in taken]
    return joined.select(*columns, total, F.coalesce(removed, F.array().cast("array<int>")).alias("lines_removed"))

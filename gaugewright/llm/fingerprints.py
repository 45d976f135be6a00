"""Fingerprints of documents from prefix polynomial hashes.

A text of code points c has prefix hashes H[0] = 0, H[i + 1] = H[i] * B + c[i] + 1 modulo a prime. The hash of any span is
H[j] - H[i] * B^(j - i), so the arrays of two texts answer in constant time whether a span of one equals a span of the other,
and bisecting the length finds their longest common extension from any two places. Two bases make a hash of 62 bits.

A fingerprint is the hash and length of the whole text, and a sketch: of the spans of WIDTH code points that end at each
place (shorter ones at the start), the SKETCH smallest mixed hashes. Equal texts have equal fingerprints; the sketch
estimates which share of all distinct spans two texts have in common, and is exact where they have no more than SKETCH.
Arrays are filled BLOCK code points at a time: a text takes 12 bytes a code point, and what else is needed is bounded.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
BASES = (727_595_203, 1_911_520_717)  #: any two large residues
WIDTH = 16
SKETCH = 128
BLOCK = 1 << 16
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime 2^31 - 1, for 0 <= x < 2^62: folds of 31 bits leave the residue as it is."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return x - PRIME * (x >= PRIME)


def powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base B the arrays of B^i and B^-i for i to BLOCK, made once a process by doubling."""
    if not _powers:
        for base in BASES:
            pair = []
            for x in (base, pow(base, -1, PRIME)):
                out = np.ones(1, np.int64)
                while len(out) <= BLOCK:
                    out = np.concatenate([out, _reduced(out * pow(x, len(out), PRIME))])
                pair.append(out)
            _powers.append(tuple(pair))
    return _powers


class Prefixes:
    """Prefix hashes of a text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.size = len(codes)
        self.hashes = [np.zeros(self.size + 1, np.uint32) for _ in BASES]
        for base, (up, down), out in zip(BASES, powers(), self.hashes, strict=True):
            carry = 0
            for at in range(0, self.size, BLOCK):
                part = codes[at : at + BLOCK].astype(np.int64) + 1
                n = len(part)
                sums = np.cumsum(_reduced(part * down[1 : n + 1])) % PRIME  # of c * B^-(k + 1), carried up by B^(k + 1)
                found = _reduced(_reduced(sums + carry) * up[1 : n + 1])
                out[at + 1 : at + n + 1] = found
                carry = int(found[-1])

    def hash(self, i: int, j: int) -> tuple[int, int]:
        """Hash of the span from i to j."""
        return tuple((int(h[j]) - int(h[i]) * pow(b, j - i, PRIME)) % PRIME for b, h in zip(BASES, self.hashes, strict=True))

    def same(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        """Whether the spans of a length from i here and from j there are equal."""
        for b, h, g in zip(BASES, self.hashes, other.hashes, strict=True):
            if (int(h[i + length]) - int(g[j + length]) - (int(h[i]) - int(g[j])) * pow(b, length, PRIME)) % PRIME:
                return False
        return True

    def extension(self, i: int, other: Prefixes, j: int, most: int | None = None) -> int:
        """Length of the longest common extension from i here and from j there, up to ``most``, by bisection."""
        room = min(self.size - i, other.size - j, *([] if most is None else [most]))
        return bisect.bisect_left(range(1, room + 1), True, key=lambda n: not self.same(i, other, j, n))

    def sketch(self, begin: int, end: int) -> np.ndarray:
        """The SKETCH smallest mixed hashes of the spans of up to WIDTH code points that end after ``begin`` and no later than ``end``, ascending."""
        found = np.zeros(0, np.uint64)
        for at in range(begin, end, BLOCK):
            ends = np.arange(at + 1, min(end, at + BLOCK) + 1)
            begins = np.maximum(ends - WIDTH, 0)
            halves = []
            for (up, _), h in zip(powers(), self.hashes, strict=True):
                x = h[ends].astype(np.int64) - _reduced(h[begins].astype(np.int64) * up[ends - begins])
                halves.append((x + PRIME * (x < 0)).astype(np.uint64))
            found = smallest([found, _mixed(halves[0] << np.uint64(31) | halves[1])])
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    """Words spread over all 64 bits, one to one."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def smallest(arrays: list[np.ndarray]) -> np.ndarray:
    """The SKETCH smallest distinct values of some arrays, ascending; a bound that widens until it holds enough spares sorting them all."""
    total = sum(map(len, arrays))
    bound = 3 * SKETCH * (1 << 64) // max(total, 1)
    while bound < 1 << 64:
        found = np.unique(np.concatenate([x[x <= np.uint64(bound)] for x in arrays]))
        if len(found) >= SKETCH:
            return found[:SKETCH]
        bound *= 8
    return np.unique(np.concatenate(arrays))[:SKETCH]


def written(whole: tuple[int, int], length: int, sketch: np.ndarray) -> str:
    """A fingerprint: hash of the whole, length, and sketch by the upper halves of its words, in hexadecimal."""
    return f"{whole[0] << 31 | whole[1]:016x}:{length:x}:" + (sketch >> np.uint64(32)).astype(">u4").tobytes().hex()


def fingerprint(text: str) -> str:
    """Fingerprint of a text; an empty one has an empty sketch."""
    p = Prefixes(text)
    return written(p.hash(0, p.size), p.size, p.sketch(0, p.size))


def likeness(a: str, b: str) -> float:
    """Share of two texts' distinct spans that they have in common, by their fingerprints; 1 for equal fingerprints and only for these."""
    if a == b:
        return 1.0
    one, other = (np.frombuffer(bytes.fromhex(x.rsplit(":", 1)[1]), ">u4") for x in (a, b))
    least = np.union1d(one, other)[:SKETCH]
    if not len(least):
        return 0.0
    common = np.intersect1d(np.intersect1d(one, other, assume_unique=True), least, assume_unique=True)
    return min(len(common) / len(least), 1 - 1e-9)


def likeness_of(a: Column, b: Column) -> Column:
    """``likeness`` of two columns of fingerprints; null if either is."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if i is None or j is None else likeness(i, j) for i, j in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return run(a, b)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_chars, fingerprint), a row per row; null text counts as empty, bytes that are no UTF-8 as U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or b"").decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(fingerprint, texts), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def with_extension(pairs: DataFrame, a: str, i: str, b: str, j: str, name: str = "extension") -> DataFrame:
    """``pairs`` with the length of the longest common extension of text ``a`` from code point ``i`` and text ``b`` from ``j``; null if any of them is, or lies outside."""

    @F.arrow_udf("long")
    def run(x: pa.Array, at: pa.Array, y: pa.Array, to: pa.Array) -> pa.Array:
        found = []
        for one, begin, other, start in zip(x.to_pylist(), at.to_pylist(), y.to_pylist(), to.to_pylist(), strict=True):
            inside = None not in (one, begin, other, start) and 0 <= begin <= len(one) and 0 <= start <= len(other)
            found.append(Prefixes(one).extension(begin, Prefixes(other), start) if inside else None)
        return pa.array(found, pa.int64())

    return pairs.withColumn(name, run(F.col(a), F.col(i).cast("long"), F.col(b), F.col(j).cast("long")))


class _Document:
    """A text with its prefix hashes and the sketches of its first two thirds and of the rest."""

    def __init__(self, doc_id: object, body: bytes | None):
        self.doc_id, self.text = doc_id, (body or b"").decode(errors="replace")
        self.prefixes = p = Prefixes(self.text)
        self.kept = p.size - p.size // 3
        self.first, rest = p.sketch(0, self.kept), p.sketch(self.kept, p.size)
        self.mark = written(p.hash(0, p.size), p.size, smallest([self.first, rest]))

    def row(self, following: _Document) -> tuple:
        p, q, kept = self.prefixes, following.prefixes, self.kept
        taken = min(p.size - kept, q.size)
        edited = self.text[:kept] + following.text[:taken]
        before = min(kept, WIDTH)
        seam = Prefixes(self.text[kept - before : kept] + following.text[: min(taken, WIDTH)])  # spans over the seam
        tail = [seam.sketch(before, seam.size), q.sketch(min(taken, WIDTH), taken)]
        whole = tuple((int(h[kept]) * pow(b, taken, PRIME) + int(g[taken])) % PRIME for b, h, g in zip(BASES, p.hashes, q.hashes, strict=True))
        mark = written(whole, kept + taken, smallest([self.first, *tail]))
        common = kept + p.extension(kept, q, 0, taken), p.extension(0, q, 0)
        return self.doc_id, p.size, hashlib.sha256(edited.encode()).hexdigest(), self.mark, mark, likeness(self.mark, mark), likeness(self.mark, following.mark), *common


EDITS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]


def edits(docs: DataFrame, pieces: int | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> fingerprints of every text and of its edited text, a row per row.

    The edited text has the last third of the code points replaced by the first as many (or all) of the next document, by
    descending doc_id; after the last comes the first. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, common_edited and common_next (code points that both texts begin with).

    Null text counts as empty; bytes that are no UTF-8 as U+FFFD. Null ids come last; rows that share an id follow each other by
    text and are documents of their own, in one task; a single row is its own next. An empty table gives none. Other columns
    are ignored. A text must fit a task.

    Documents are dealt by ranges of ids, which the ids alone decide: one bound a range goes to the driver. Texts are shuffled
    once; the documents with a range's first id go to the range before it too, where its last document needs the first of them.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id").repartitionByRange(pieces or 4 * n, F.desc_nulls_last("doc_id")).select("doc_id", F.spark_partition_id().alias("piece"))
    found = ids.groupBy("piece").agg(F.max("doc_id").alias("top")).orderBy("piece").collect()
    tops = [r.top for r in found if r.top is not None][::-1] or [None]  # ascending; null ids belong to the last range
    last = len(tops) - 1

    @F.arrow_udf("array<int>")
    def dealt(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            k = 0 if x is None else bisect.bisect_left(tops, x)  # from the smallest ids
            wanted = [last - k]
            if (x is None and tops == [None]) or (x is not None and tops[k] == x):
                wanted.append(-1 - (last - k - 1 if k < last else last))  # as one of the first of its range
            out.append(wanted)
        return pa.array(out, pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, piece, rows = None, None, []
        for batch in batches:
            for at, lead, doc_id, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != piece:
                    held, piece = None, at
                elif held is None:
                    continue  # a range's last document has met its next one
                new = _Document(doc_id, body)
                if held is not None:
                    rows.append(held.row(new))
                held = None if lead else new
                if len(rows) >= 512:
                    yield table(rows, batch)
                    rows = []
            if rows:
                yield table(rows, batch)
                rows = []

    def table(rows: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [batch.column(2).type, *_KINDS]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", *(c.split()[0] for c in EDITS.split(", "))])

    each = docs.select("doc_id", F.col("text").cast("binary").alias("body")).withColumn("at", F.explode(dealt(F.col("doc_id"))))
    placed = each.select(F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("piece"), (F.col("at") < 0).alias("lead"), "doc_id", "body")
    ordered = placed.repartition(n, "piece").sortWithinPartitions("piece", "lead", F.desc_nulls_last("doc_id"), "body")
    return ordered.mapInArrow(run, f"doc_id {kind}, {EDITS}")

"""Benchmark decontamination by greedy string tiling.

Windows of ``seed`` words shared by a document and a benchmark text are found by Karp-Rabin hashes that roll over word
ids. Where they could cover enough of the test text, the longest common stretches whose words are still unmarked become
tiles, and so on with shorter ones until none has ``seed`` words. The share of the test text under tiles decides, so passages
that are reordered or interrupted are caught like whole ones. Places are kept for the test text only, never pairs of places, so
texts that repeat one word or line without end cost no more than others.

The benchmark is a stated query set. It is split into blocks of bounded size by a hash; each block's index is sent to
the executors and meets all documents. Blocks are added as the benchmark grows, documents are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK_BYTES = 8 << 20
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_CLASSES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of non-ASCII characters."""
    return text.translate(_CLASSES).split() if text else []


def _hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash, modulo 2^64, of each window of ``width`` ids."""
    out = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        out = out * _RADIX + ids[k : k + len(out)]
    return out


def _windows(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``width`` ids without a zero, and their hashes."""
    if len(ids) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    zeros = np.concatenate([[0], np.cumsum(ids == 0)])
    at = np.flatnonzero(zeros[width:] == zeros[:-width])
    return at, _rolled(ids, width)[at]


def _rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """As ``_hashes``, in a number of passes that grows with the logarithm of ``width``."""
    part, size, done, out = ids, 1, 0, None
    while True:
        if width & size:
            n = len(ids) - width + 1
            out = part[done : done + n] if out is None else out * _power(size) + part[done : done + n]
            done += size
        if size * 2 > width:
            return out
        part = part[: len(part) - size] * _power(size) + part[size:]
        size *= 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_RADIX), n, 1 << 64))


def tiles(doc: np.ndarray, test: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of word ids (zeros match nothing) by common windows of ``least`` words or more -> (length, doc, test).

    Running Karp-Rabin: the longest length at which an unmarked window of the one has the hash of one of the other is
    bisected; windows of that length are compared and marked in order of the document, the first free place of the test text
    first; then the next length. Only the test text's places are held, never pairs of places.
    """
    doc, test = doc.copy(), test.copy()
    found, most = [], min(len(doc), len(test))
    while most >= least:
        low, high = least - 1, most  # a common window of ``low`` is known, unless it is too short
        while low < high:
            middle = (low + high + 1) // 2
            if np.intersect1d(_windows(doc, middle)[1], _windows(test, middle)[1]).size:
                low = middle
            else:
                high = middle - 1
        most = low
        if most < least:
            break
        places: dict[int, list[int]] = defaultdict(list)
        for t, h in reversed(list(zip(*(x.tolist() for x in _windows(test, most)), strict=True))):
            places[h].append(t)
        at, hashes = _windows(doc, most)
        hit = np.isin(hashes, np.fromiter(places, np.uint64, len(places)))
        free, laid = 0, 0
        for d, h in zip(at[hit].tolist(), hashes[hit].tolist(), strict=True):
            if d < free or h not in places:
                continue
            here = places[h]
            while here and not test[here[-1] : here[-1] + most].all():
                here.pop()
            if not here:
                del places[h]
                if not places:
                    break
                continue
            t = here[-1]
            if np.array_equal(doc[d : d + most], test[t : t + most]):
                found.append((most, d, t))
                test[t : t + most] = 0
                free, laid = d + most, laid + 1
        for _, d, _ in found[len(found) - laid :]:
            doc[d : d + most] = 0
        if not laid:  # equal hashes of unequal words
            most -= 1
    return found


class Index:
    """Seeds of one block of test texts."""

    def __init__(self, items: list[tuple], seed: int) -> None:
        self.items, self.ids = items, {}
        texts = [words_of(text) for _, text in items]
        self.sizes = [len(w) for w in texts]
        for words in texts:
            for w in words:
                self.ids.setdefault(w, len(self.ids) + 1)
        self.coded = [np.array([self.ids[w] for w in words], np.uint64) for words in texts]
        self.seeds: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, int]]]]] = {}
        self.own: dict[int, dict[int, np.ndarray]] = {}  # which of the hashes each item has
        for width in sorted({min(seed, n) for n in self.sizes if n}):
            places: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for k, (n, ids) in enumerate(zip(self.sizes, self.coded, strict=True)):
                if n and min(seed, n) == width:
                    for at, h in enumerate(_hashes(ids, width).tolist()):
                        places[h].append((k, at))
            hashes = np.array(sorted(places), np.uint64)
            own: dict[int, set[int]] = defaultdict(set)
            for i, h in enumerate(hashes.tolist()):
                for k, _ in places[h]:
                    own[k].add(i)
            self.seeds[width] = hashes, dict(places)
            self.own[width] = {k: np.array(sorted(x)) for k, x in own.items()}

    def matches(self, text: bytes | None, least: float) -> list[tuple]:
        """(item, tiles, matched words, words, coverage) of each test text covered to ``least`` or more."""
        words = words_of(text)
        if not words:
            return []
        ids = np.fromiter((self.ids.get(w, 0) for w in words), np.uint64, len(words))
        out = []
        for width, (hashes, places) in self.seeds.items():
            at, rolled = _windows(ids, width)
            if not len(at):
                continue
            near = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            ok = hashes[near] == rolled
            at, shared = at[ok], np.unique(near[ok])
            starts: dict[int, list[int]] = defaultdict(list)
            for h in hashes[shared].tolist():
                for k, t in places[h]:
                    starts[k].append(t)
            if not starts:
                continue
            near = near[ok]
            for k, found in starts.items():
                under = np.zeros(self.sizes[k] + 1, np.int64)
                np.add.at(under, found, 1)
                np.add.at(under, np.array(found) + width, -1)
                if (np.cumsum(under) > 0).sum() < least * self.sizes[k]:  # what tiles can cover at most
                    continue
                laid = tiles(self._stretches(ids, at[np.isin(near, self.own[width][k])], width), self.coded[k], width)
                matched = sum(x[0] for x in laid)
                if matched >= least * self.sizes[k]:
                    out.append((self.items[k][0], len(laid), matched, self.sizes[k], matched / self.sizes[k]))
        return out

    @staticmethod
    def _stretches(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """The words under windows ``at``, with one zero between stretches."""
        under = np.zeros(len(ids) + 1, np.int64)
        np.add.at(under, at, 1)
        np.add.at(under, at + width, -1)
        inside = np.cumsum(under)[:-1] > 0
        edge = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        return np.insert(ids[inside], np.cumsum(inside)[edge] - 1, 0) if len(edge) else ids[inside]


def indexes(benchmark: DataFrame, seed: int) -> Iterator[Index]:
    """The benchmark's blocks, one after the other; each distinct (item_id, text) once."""
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("body")).where("body is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = ceil(size / BLOCK_BYTES)
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("body", "item_id"), F.lit(blocks)) == b).orderBy("item_id", "body").collect()
        yield Index([(r.item_id, bytes(r.body)) for r in part], seed)


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = 5, least: float = 0.8) -> DataFrame:
    """docs(doc_id, text, ...) x benchmark(item_id, text, ...) -> (doc_id, item_id, tiles, matched, words, coverage).

    A row per document row and test text whose coverage is ``least`` or more. Texts shorter than ``seed`` words must be
    found whole; texts without words, null or empty, match nothing. Repeated document rows give repeated results,
    repeated benchmark rows count once. Null ids are kept. Other columns are ignored; whole texts are read, very long or
    repetitive ones in memory that grows with their words. An empty table on either side gives no rows.
    """
    keys = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {keys[0]}, item_id {keys[1]}, tiles long, matched long, words long, coverage double"
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("body"))
    out = docs.sparkSession.createDataFrame([], schema)
    kinds = [to_arrow_type(benchmark.schema["item_id"].dataType), *[pa.int64()] * 3, pa.float64()]
    for index in indexes(benchmark, seed):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    got = index.matches(text, least)
                    doc += [i] * len(got)
                    found += got
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc, pa.int64())), *(pa.array([f[j] for f in found], t) for j, t in enumerate(kinds))],
                    ["doc_id", "item_id", "tiles", "matched", "words", "coverage"],
                )

        out = out.union(rows.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, seed: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that no test text covers; documents pass once per block and are never shuffled.

    Null and empty texts stay; repeated rows share their fate; an empty benchmark drops nothing.
    """
    for index in indexes(benchmark, seed):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([not index.matches(t, least) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

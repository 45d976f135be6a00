"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, over a block-max inverted index.

Examples are a bounded, hash-picked sample of each label. Every word of theirs is a term; document frequencies are counted
over the whole corpus, and a term's weight is multiplied by how unevenly the labels hold it (smoothed log odds, never
zero), so that words which tell nothing about the label do not decide which examples are near. The index holds the posting
list of every term; those of frequent terms lie in blocks of examples with each block's largest weight. What a query's
other terms give an example, and what its frequent terms can add to a block at most, bound every cosine of the block, so
blocks are opened in order of their bound until none can hold a nearer example. Nothing is approximated. Votes of the nearest examples are weighted by squared cosine against a fixed weight for "no evidence", and a
logistic map fitted on a bounded sample with the labels' own proportions makes the vote a calibrated probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, keep, one_text

BLOCK = 64  #: examples in a block
_CLASSES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_CLASSES).split() if text else []


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of several ranges, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class BlockMax:
    """Inverted index of unit example vectors, in blocks of similar ones.

    Terms that more than an eighth of the examples hold are frequent: their postings are kept block by block as dense rows,
    with each block's largest weight. All other terms have plain posting lists.
    """

    def __init__(self, ids: list, labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> None:
        """``rows``: (terms, weights) of each example."""
        strongest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in rows]
        order = sorted(range(len(rows)), key=lambda i: (strongest[i], i))
        self.ids, self.labels = [ids[i] for i in order], np.asarray(labels, float)[order]
        self.places: dict = {}
        for i, x in enumerate(self.ids):
            self.places.setdefault(x, []).append(i)
        sizes = np.array([len(rows[i][0]) for i in order], np.int64)
        terms = np.concatenate([np.zeros(0, np.int64), *(rows[i][0] for i in order)]).astype(np.int64)
        weights = np.concatenate([np.zeros(0, np.float32), *(rows[i][1] for i in order)]).astype(np.float32)
        by_term = np.argsort(terms, kind="stable")
        self.row, self.weight = np.repeat(np.arange(len(order), dtype=np.int32), sizes)[by_term], weights[by_term]
        self.start = np.searchsorted(terms[by_term], np.arange(n_terms + 1))  # of each term, its postings
        self.blocks = ceil(len(order) / BLOCK)
        frequent = np.flatnonzero(np.diff(self.start) * 8 > len(order))
        self.slot = np.full(n_terms, -1, np.int32)
        self.slot[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((self.blocks, len(frequent), BLOCK), np.float32)
        for k, t in enumerate(frequent.tolist()):
            post = slice(self.start[t], self.start[t + 1])
            self.dense[self.row[post] // BLOCK, k, self.row[post] % BLOCK] = self.weight[post]
        self.peak = np.ascontiguousarray(self.dense.max(axis=2, initial=0).T)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip=None) -> list[tuple[float, int]]:
        """The k examples of largest positive cosine, ties by position; ``skip`` leaves out examples with that id.

        The posting lists of the query's other terms are added up for all examples. What its frequent terms can add to a block
        is at most their dot product with the block's largest weights; blocks are opened in order of that bound until none
        can hold a nearer example.
        """
        if not self.blocks:
            return []
        slot = self.slot[terms]
        plain = slot < 0
        own, q, slot = terms[plain], weights[~plain], slot[~plain]
        size = self.start[own + 1] - self.start[own]
        at = _ranges(self.start[own], size)
        part = np.bincount(self.row[at], self.weight[at] * np.repeat(weights[plain], size), minlength=self.blocks * BLOCK)
        if skip is not None:
            part[self.places.get(skip, [])] = -2.0
        part = part.reshape(self.blocks, BLOCK)
        bound = part.max(axis=1) + q @ self.peak[slot]
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        best: list[tuple[float, int]] = []
        begin, step = 0, 4
        while begin < self.blocks and bound[begin] > 0 and (len(best) < k or bound[begin] >= -best[-1][0] - 1e-6):
            here = order[begin : begin + step]
            cos = part[here] + np.matmul(q, self.dense[here[:, None], slot[None, :]])
            least = -best[-1][0] if len(best) == k else 0
            b, j = np.nonzero((cos > 0) & (cos >= least))
            found = cos[b, j]
            if len(found) > 4 * k:  # ties of the last one wanted stay
                near = found >= np.partition(found, -k)[-k]
                b, j, found = b[near], j[near], found[near]
            best = sorted([*best, *zip((-found).tolist(), (here[b] * BLOCK + j).tolist(), strict=True)])[:k]
            begin, step = begin + step, step * 2
        return [(-c, i) for c, i in best]


class Model:
    """Vectors over the examples' terms, their index, and the map from votes to scores."""

    def __init__(self, vocabulary: list[bytes], factor: np.ndarray, neighbours: int, doubt: float) -> None:
        self.at, self.factor, self.k, self.doubt = {w: i for i, w in enumerate(vocabulary)}, factor, neighbours, doubt
        self.slope, self.shift = 1.0, 0.0

    def learn(self, examples: list[tuple]) -> None:
        """examples: (id, label, terms, counts)."""
        self.index = BlockMax([e[0] for e in examples], np.array([e[1] for e in examples]), [self.weighed(e[2], e[3]) for e in examples], len(self.at))

    def weighed(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.factor[terms]
        norm = float(np.sqrt(w @ w))
        return terms, (w / norm if norm else w).astype(np.float32)

    def vector(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector as (terms, weights)."""
        found = np.fromiter((i for w in words if (i := self.at.get(w)) is not None), np.int64)
        return self.weighed(*np.unique(found, return_counts=True))

    def vote(self, words: list[bytes], skip=None) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.nearest(*self.vector(words), self.k, skip)
        weight = [c * c for c, _ in near]
        return sum(w * self.index.labels[i] for w, (_, i) in zip(weight, near, strict=True)) / (sum(weight) + self.doubt), near

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * vote + self.shift))))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Logistic fit by Newton steps, with a small ridge that keeps separable samples finite."""
        x = np.column_stack([votes, np.ones(len(votes))])
        beta = np.zeros(2)
        for _ in range(40):
            p = 1 / (1 + np.exp(-x @ beta))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(2)
            step = np.linalg.solve(h, x.T @ (labels - p) - 0.02 * beta)
            beta += step
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = max(float(beta[0]), 1e-6), float(beta[1])


def _sample(corpus: DataFrame, labelled: DataFrame, per_label: int, calibration: int) -> DataFrame:
    """(doc_id, toxic, example, calibrate, body), written: bounded samples of each label and of all labelled rows, one text an id."""
    known = keep(labelled.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "known")
    each = bounded_sample(known, "toxic", per_label, "toxicity").select("doc_id", F.lit(True).alias("example"))
    some = bounded_sample(known, None, calibration, "calibration").select("doc_id", F.lit(True).alias("calibrate"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    ids = known.join(each.join(some, "doc_id", "full"), "doc_id").select("doc_id", "toxic", flag("example"), flag("calibrate"))
    found = corpus.select("doc_id", F.col("text").cast("binary").alias("body")).join(F.broadcast(ids), "doc_id")  # ids of the bounded samples
    return keep(one_text(found, "body", "doc_id", "toxic", "example", "calibrate"), "sample")


def fit(corpus: DataFrame, labelled: DataFrame, per_label: int = 2048, calibration: int = 4096, neighbours: int = 10, doubt: float = 0.05, smooth: float = 5.0) -> Model | float:
    """corpus(doc_id, text), labelled(doc_id, toxic) -> model; the plain share of label 1 (0 without labels) where it is one-sided.

    Fitted on at most ``per_label`` examples of each label and ``calibration`` rows, both hash-picked; all their words are
    terms, and document frequencies are of all rows. Documents with a null id or label are not learned from; of a
    document's several labels the largest counts.
    """
    sample = _sample(corpus, labelled, per_label, calibration)
    size = {r.toxic: r.n for r in sample.where("example").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return float(bool(n1))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = Counter(), Counter()
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (own if toxic else other).update(set(words_of(text)))
            terms = list(own.keys() | other.keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array([own[t] for t in terms], pa.int64()), pa.array([other[t] for t in terms], pa.int64())], ["term", "a", "b"])

    held = sample.where("example").select("toxic", "body").mapInArrow(distinct, "term binary, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("term").toArrow()
    vocabulary = held.column("term").to_pylist()
    a, b = (held.column(c).to_numpy() for c in "ab")
    number = {w: i for i, w in enumerate(vocabulary)}
    sent = corpus.sparkSession.sparkContext.broadcast(number)  # the words of the bounded sample

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, get = np.zeros(len(sent.value), np.int64), 0, sent.value.get
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).to_pylist():
                found = [i for w in set(words_of(text)) if (i := get(w)) is not None]
                df[found] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(df[seen], n), pa.int64())], ["term", "df"])

    counted = corpus.select(F.col("text").cast("binary").alias("body")).mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    at, n = counted.column("term").to_numpy(), counted.column("df").to_numpy()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    df[at] = n  # the number of rows comes last, as -1
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 0.01
    odds = np.log((a + smooth) / (n1 + 2 * smooth)) - np.log((b + smooth) / (n0 + 2 * smooth))
    model = Model(vocabulary, idf * (0.01 + odds * odds), neighbours, doubt)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in batches:
            found = [np.unique(np.array([i for w in words_of(t) if (i := get(w)) is not None], np.int32), return_counts=True) for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in range(2))], ["doc_id", "toxic", "example", "calibrate", "terms", "counts"])

    key = sample.schema["doc_id"].dataType.simpleString()
    examples = sample.where("example").mapInArrow(coded, f"doc_id {key}, toxic int, example boolean, calibrate boolean, terms array<int>, counts array<int>").orderBy("doc_id", "terms", "counts").toArrow()
    ids, labels, terms, counts = (examples.column(c) for c in ("doc_id", "toxic", "terms", "counts"))
    model.learn([(ids[i].as_py(), labels[i].as_py(), np.asarray(terms[i].values, np.int64), np.asarray(counts[i].values, np.int64)) for i in range(examples.num_rows)])
    judged = corpus.sparkSession.sparkContext.broadcast(model)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judged.value.vote(words_of(t), i)[0] for i, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1)], ["vote", "toxic"])

    own = sample.where("calibrate").select("doc_id", "toxic", "body").mapInArrow(votes, "vote double, toxic int").orderBy("vote", "toxic").toArrow()
    model.calibrate(own.column("vote").to_numpy(), own.column("toxic").to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, score, predicted, evidence), one row per input row.

    ``evidence`` lists id:label:cosine of the three nearest examples. Null and empty texts and those without a word of the
    examples have no evidence and get the score of an empty vote. Ties go to the first example in the index's order. Whole
    texts are read, however long; repeated rows and null ids are kept; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            scores, evidence = [], []
            for text in batch.column(1).to_pylist():
                if isinstance(model, float):
                    scores.append(model)
                    evidence.append("")
                    continue
                vote, near = model.vote(words_of(text))
                scores.append(model.score(vote))
                evidence.append(",".join(f"{model.index.ids[i]}:{int(model.index.labels[i])}:{c:.3f}" for c, i in near[:3]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, pa.string())], ["doc_id", "score", "predicted", "evidence"]
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(run, f"doc_id {key}, score double, predicted int, evidence string")


def fold(column: str = "doc_id"):
    """Remainder by 5 of the CRC-32 of the id as text; 0 is held out."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows that are not held out, score all -> (doc_id, held_out, score, predicted, evidence).

    A row per row of docs; null, empty, long and repeated texts are treated as ``score`` says, null and repeated labels as
    ``fit`` says; a null id is not held out. Without labels of both kinds every score is the share of label 1.
    """
    rows = docs.select("doc_id", "text")
    model = fit(rows, labels.select("doc_id", "toxic").where(fold() != 0))
    return score(rows, model).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")

"""Mixing to target weights with soft membership.

A classifier learned from a labelled table gives each document a posterior over domains, so a document adds its tokens
to every domain in part. Nonnegative document rates are then fitted so that expected domain totals meet the targets:
minimise 1/2 |sum_d w_d r_d p_d - t|^2 + ridge/2 sum_d w_d (r_d - 1)^2 over r >= 0, where w_d is a document's share of
all tokens and p_d its posterior, and the norm may weigh the domains. Accelerated projected-gradient steps run over the documents where they lie: a step needs
only the vector of domain totals, and a document's rate after any number of steps is a fold over those few vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MANY, bounded_sample, keep, one_text

_CLASSES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_GROUPS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "bang": b"!?", "marks": b"#$%&*+=<>@^_~|", "digit": b"0123456789", "stop": b".,;:"}


def features(text: bytes) -> set[bytes]:
    """Words, and binned shares of kinds of characters, of distinct words and of word repetitions in a row."""
    words = text.translate(_CLASSES).split()
    out = set(words)
    n, m = max(1, len(text)), max(1, len(words))
    bins = {"kinds": int(10 * len(out) / m), "again": int(10 * sum(map(bytes.__eq__, words, words[1:])) / m), "length": len(words).bit_length()}
    for name, chars in _GROUPS.items():
        share = (len(text) - len(text.translate(None, chars))) / n
        bins[name] = int(share * 100) if share < 0.05 else 5 + int(share * 10)
    out.update(f" {name}{x}".encode() for name, x in bins.items())
    return out


class Posterior:
    """Softmax regression over the presence of features."""

    def __init__(self, domains: list[str], at: dict[bytes, int], weights: np.ndarray) -> None:
        self.domains, self.at, self.weights = domains, at, weights  # the last row of weights is the intercept

    def rows(self, found: set[bytes]) -> list[int]:
        return [*sorted(self.at[f] for f in found & self.at.keys()), len(self.at)]

    def __call__(self, text: bytes | None) -> np.ndarray:
        z = self.weights[self.rows(features(text or b""))].sum(axis=0)
        p = np.exp(z - z.max(initial=-np.inf))
        return p / p.sum()

    def fit(self, rows: list[list[int]], labels: list[int], shares: np.ndarray, ridge: float = 1e-3, steps: int = 400) -> None:
        """Weighted maximum likelihood by Adam; each domain weighs as it does in the labelled table. Without rows: those shares."""
        if not rows:
            self.weights[-1] = np.log(shares)
            return
        at, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        y = np.eye(len(self.domains))[labels]
        w = (y * (shares / np.maximum(y.sum(axis=0), 1))).sum(axis=1, keepdims=True)
        begins = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
        m = v = np.zeros_like(self.weights)
        for t in range(1, steps + 1):
            z = np.add.reduceat(self.weights[at], begins)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = w * (p / p.sum(axis=1, keepdims=True) - y)
            slope = np.column_stack([np.bincount(at, g[row, k], len(self.weights)) for k in range(y.shape[1])]) + ridge * np.append(self.weights[:-1], np.zeros((1, y.shape[1])), axis=0)
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            self.weights = self.weights - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def fit_posterior(docs: DataFrame, labelled: DataFrame, per_domain: int = 2000, least: int = 5, chi2: float = 15.0, spare: tuple[str, ...] = ()) -> Posterior:
    """docs(doc_id, text), labelled(doc_id, domain) -> classifier, from at most ``per_domain`` hash-picked texts of each domain.

    Only features that tell the domains apart (chi-squared per degree of freedom) count. Domains weigh as they do in the
    whole labelled table; their values are taken as text. Without labelled rows the domains are ``spare``, all alike.
    """
    known = keep(labelled.where("doc_id is not null and domain is not null").select("doc_id", F.col("domain").cast("string").alias("domain")).distinct(), "known")
    shares = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()} or dict.fromkeys(spare, 1)
    domains = sorted(shares)
    ids = bounded_sample(known, "domain", per_domain, "mixing")
    number = F.array_position(F.array(*map(F.lit, domains)).cast("array<string>"), F.col("domain")).cast("int") - 1
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id") if len(domains) <= MANY else docs.select("doc_id", "text").join(ids, "doc_id")  # ids of the bounded sample
    picked = one_text(found, "text", "doc_id", "domain").select(number.alias("number"), F.col("text").cast("binary").alias("body"))
    picked = keep(picked, "picked")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            domain, found = [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = features(text or b"")
                domain += [d] * len(got)
                found += got
            yield pa.RecordBatch.from_arrays([pa.array(domain, pa.int32()), pa.array(found, pa.binary())], ["number", "feature"])

    held = [F.count(F.when(F.col("number") == i, 1)) for i in range(len(domains))]
    counts = picked.mapInArrow(counted, "number int, feature binary").groupBy("feature").agg(F.array(*held).cast("array<double>").alias("n"))
    total = {r.number: r.n for r in picked.groupBy("number").agg(F.count("*").alias("n")).collect()}
    n, seen = max(1, sum(total.values())), F.aggregate("n", F.lit(0.0), lambda x, y: x + y)
    share = [total.get(i, 0) / n for i in range(len(domains))]
    excess = [F.pow(F.col("n")[i] - seen * x, 2) / (seen * (1 - seen / n) * max(x, 1e-9)) for i, x in enumerate(share)]
    strength = sum(excess, F.lit(0.0)) / max(1, len(domains) - 1)
    frequent = counts.where((seen >= least) & (seen < n)).where(strength >= chi2).select("feature").orderBy("feature").collect()  # of a bounded sample
    model = Posterior(domains, {bytes(r.feature): i for i, r in enumerate(frequent)}, np.zeros((len(frequent) + 1, len(domains))))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.rows(features(t or b"")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["number", "found"])

    sample = picked.mapInArrow(coded, "number int, found array<int>").orderBy("number", "found").collect()
    model.fit([r.found for r in sample], [r.number for r in sample], np.array([shares[d] for d in domains]) / max(1, sum(shares.values())))
    return model


def posteriors(docs: DataFrame, model: Posterior) -> DataFrame:
    """docs, all columns, and ``mix_tokens`` (words) and ``mix_p`` (posterior of each domain)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            tokens = pa.array([len(t.split()) if t else 0 for t in texts], pa.int64())
            p = pa.array([model(t).tolist() for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens, p], [*batch.schema.names, "mix_tokens", "mix_p"])

    schema = T.StructType([*docs.schema.fields, T.StructField("mix_tokens", T.LongType()), T.StructField("mix_p", T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(run, schema)


class Descent:
    """Accelerated projected gradient; ``history`` has, for each step, the totals' weighed error at its point and its momentum."""

    def __init__(self, targets: list[float], rate: float, ridge: float) -> None:
        self.targets, self.rate, self.ridge = np.array(targets), rate, ridge
        self.history: list[tuple[np.ndarray, float]] = []
        self.totals = np.zeros(len(targets))  #: expected domain totals that the rates reach, as shares of all tokens

    def at(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rates, look-ahead point) of documents with posteriors ``p`` after the recorded steps."""
        r = y = np.ones(len(p))
        for error, momentum in self.history:
            new = np.maximum(0, y - self.rate * (p @ error + self.ridge * (y - 1)))
            r, y = new, new + momentum * (new - r)
        return r, y


def _batch(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    tokens = batch.column(batch.schema.get_field_index("mix_tokens")).to_numpy()
    return tokens, np.asarray(batch.column(batch.schema.get_field_index("mix_p")).flatten(), float).reshape(len(tokens), k)


def _totals(members: DataFrame, k: int, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over documents of the rows that ``weigh(tokens, posteriors)`` gives; one short row leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [weigh(*_batch(b, k)) for b in batches if b.num_rows]
        if parts:
            total = np.sum(parts, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.float64())], ["i", "x"])

    rows = members.select("mix_tokens", "mix_p").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    return np.array([r.x for r in rows])


def fit_rates(members: DataFrame, targets: list[float], ridge: float = 0.002, steps: int = 60, tolerance: float = 1e-5, even: bool = True) -> Descent:
    """members(mix_tokens, mix_p) -> descent whose rates bring the expected domain totals to ``targets`` (shares of all tokens).

    ``even`` weighs errors by the inverse of the domains' own second moments, so that rare domains meet their targets as
    closely as frequent ones and the descent needs few steps; else all errors weigh the same. It ends where the objective
    no longer moves by ``tolerance``, or after ``steps``; ``totals`` says what is reached.
    """
    k = len(targets)
    sums = _totals(members, k, lambda w, p: np.concatenate([[w.sum()], ((p * w[:, None]).T @ p).reshape(-1)]))
    everything = float(sums[0]) if len(sums) else 0.0
    if not everything or not k:
        return Descent(targets, 0.0, ridge)
    moments = sums[1:].reshape(k, k) / everything
    weigh_error = np.linalg.inv(moments + 1e-6 * np.trace(moments) * np.eye(k)) if even else np.eye(k)
    out = Descent(targets, 1 / (float(np.linalg.eigvals(weigh_error @ moments).real.max()) + ridge), ridge)
    since, last = 0, float("inf")
    for turn in range(steps + 1):

        def weigh(w: np.ndarray, p: np.ndarray) -> np.ndarray:
            r, y = out.at(p)
            return np.concatenate([(w * y) @ p, [w @ (y - 1) ** 2], (w * r) @ p])

        now = _totals(members, k, weigh) / everything
        error, out.totals = now[:k] - out.targets, now[k + 1 :]
        value = float(error @ weigh_error @ error + ridge * now[k])
        since = 0 if value > last else since + 1
        moved = abs(last - value) / max(value, 1e-12)
        last = value
        if turn == steps or moved < tolerance:
            break
        out.history.append((weigh_error @ error, since / (since + 3)))
    return out


def reached(mixed: DataFrame, targets: dict[str, float]) -> DataFrame:
    """mixed, as ``mix`` gives it -> (domain, target, total): the expected shares of tokens, targets beside them."""
    domains = [c[2:] for c in mixed.columns if c.startswith("p_")]
    sums = mixed.agg(F.sum("tokens").alias("n"), *(F.sum(F.col("tokens") * F.col("rate") * F.col(f"`p_{d}`")).alias(f"s{i}") for i, d in enumerate(domains)))
    rows = [F.struct(F.lit(d).alias("domain"), F.lit(float(targets.get(d, 0.0))).alias("target"), (F.col(f"s{i}") / F.col("n")).alias("total")) for i, d in enumerate(domains)]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """All rows and columns of docs, with ``tokens``, ``p_<domain>`` and ``rate`` (columns of these names are replaced).

    ``targets`` are shares of the corpus's tokens that each domain of ``labelled`` (doc_id, domain) should hold; domains
    without a target get zero, targets of domains that no row is labelled with are left out. Null and empty texts have no
    tokens, the posterior of their features and a rate like any other; very long texts count as a whole. Repeated rows are
    each a document. Without labelled rows the domains of ``targets`` are equally likely for every text (without targets
    too, all rates are 1); where no labelled document has a text, every text gets the table's own shares as posterior; an
    empty docs gives no rows. Domains may be of any type and are named by their text.
    """
    model = fit_posterior(docs, labelled, spare=tuple(targets))
    own = {"mix_tokens", "mix_p", "tokens", "rate", *(f"p_{d}" for d in model.domains)}
    rows = docs.drop(*own)
    members = keep(posteriors(rows, model), "members")
    descent = fit_rates(members, [targets.get(d, 0.0) for d in model.domains], **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, p = _batch(batch, len(model.domains))
            kept = [i for i, n in enumerate(batch.schema.names) if n != "mix_p"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array(x) for x in p.T), pa.array(descent.at(p)[0])], names)

    names = [*rows.columns, "tokens", *(f"p_{d}" for d in model.domains), "rate"]
    schema = T.StructType([*rows.schema.fields, T.StructField("tokens", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names[len(rows.columns) + 1 :])])
    return members.mapInArrow(run, schema)

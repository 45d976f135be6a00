"""Language identification by nearest centroid over TF-IDF byte trigrams.

Each language gets several centroids (spherical k-means over a bounded sample of its labelled texts), so mixed styles
of one language are not averaged away. A text takes the language of its nearest centroid by cosine; texts farther from
every centroid than the language's training texts ever are, by a wide margin, are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, keep, one_text

UNKNOWN = "und"
_BASE = 91
#: Byte classes: letters a-z, bytes of non-ASCII characters by their low six bits, everything else a blank.
_CLASSES = bytes(b - 96 if 97 <= b <= 122 else 27 + (b & 63) if b >= 128 else 0 for b in range(256))


def _codes(text: str) -> np.ndarray:
    x = np.frombuffer((" " + text.lower() + " ").encode().translate(_CLASSES), np.uint8).astype(np.int32)
    return (x[:-2] * _BASE + x[1:-1]) * _BASE + x[2:]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    codes: np.ndarray  #: trigram codes of the features
    idf: np.ndarray
    langs: list[str]  #: of each centroid
    centroids: np.ndarray  #: unit rows
    floors: np.ndarray  #: of each centroid: smallest accepted cosine

    def __post_init__(self) -> None:
        self.slot = np.zeros(_BASE**3, np.int32)
        self.slot[self.codes] = np.arange(1, len(self.codes) + 1)

    def vector(self, text: str) -> np.ndarray:
        tf = np.bincount(self.slot[_codes(text)], minlength=len(self.codes) + 1)[1:]
        v = np.log1p(tf).astype(np.float32) * self.idf
        norm = float(np.sqrt(v @ v))
        return v / norm if norm else v

    def vectors(self, texts: list[str]) -> np.ndarray:
        return np.array([self.vector(t) for t in texts], np.float32).reshape(len(texts), len(self.codes))


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds; returns centroids and each row's best cosine."""
    mean = x.mean(axis=0)
    seeds = [int(np.argmax(x @ mean))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(axis=1))))
    c = x[seeds]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.array([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))], np.float32)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).max(axis=1)


def sample_labelled(labelled: DataFrame, per_lang: int) -> DataFrame:
    """At most ``per_lang`` rows (lang, text) of each language, picked by a hash among its distinct ids and texts."""
    body = F.xxhash64("text").alias("_body")
    picked = bounded_sample(labelled.where("doc_id is not null").select("lang", "doc_id", body), "lang", per_lang, "langid")
    found = labelled.select("lang", "doc_id", body, "text").join(F.broadcast(picked), ["lang", "doc_id", "_body"])  # keys of the bounded sample
    return one_text(found, "text", "lang", "doc_id", "_body").select("lang", "text")


def fit(labelled: DataFrame, per_lang: int = 400, features: int = 3000, clusters: int = 4, slack: float = 0.35) -> Model | None:
    """labelled(doc_id, lang, text) -> model, from at most ``per_lang`` texts a language; None if nothing is labelled.

    Rows with a null lang, text or id are not learned from; rows that repeat all three count once.
    """
    sample = sample_labelled(labelled.where("lang is not null and text is not null"), per_lang)
    sample = keep(sample, "sample")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(_BASE**3, np.int64)
        n = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[np.unique(_codes(text))] += 1
                n += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], n))], ["code", "df"])

    counts = sample.select("text").mapInArrow(grams, "code long, df long").groupBy("code").agg(F.sum("df").alias("df"))
    top = counts.where("code <> 0").orderBy(F.expr("code = -1").desc(), F.desc("df"), "code").limit(features + 1).collect()
    total = next((r.df for r in top if r.code == -1), 0)
    if not total:
        return None
    picked = [r for r in top if r.code != -1]
    codes = np.array([r.code for r in picked], np.int64)
    idf = (np.log((1 + total) / (1 + np.array([r.df for r in picked]))) + 0.1).astype(np.float32)
    blank = Model(codes, idf, [], np.zeros((0, len(codes)), np.float32), np.zeros(0))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        c, best = _kmeans(blank.vectors(sorted(pdf.text)), clusters)
        return pd.DataFrame({"lang": pdf.lang.iloc[0], "centroid": [row.tobytes() for row in c], "floor": slack * float(np.quantile(best, 0.01))})

    rows = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, floor double").orderBy("lang", "centroid").collect()
    return Model(codes, idf, [r.lang for r in rows], np.array([np.frombuffer(r.centroid, np.float32) for r in rows]), np.array([r.floor for r in rows]))


def judge(texts: list[str | None], model: Model | None) -> list[tuple[str, float, bool]]:
    """(language, cosine, rejected) of each text."""
    out = [(UNKNOWN, 0.0, True)] * len(texts)
    known = [i for i, t in enumerate(texts) if model and has_letter(t)]
    if known:
        cosine = model.vectors([texts[i] for i in known]) @ model.centroids.T
        for i, j, row in zip(known, cosine.argmax(axis=1).tolist(), cosine, strict=True):
            out[i] = model.langs[j], float(min(max(row[j], 0), 1)), bool(row[j] < model.floors[j])
    return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, lang_pred, score, rejected), a row per input row.

    ``lang_pred`` is 'und' (score 0, rejected) where the text is null or has no letter, or where nothing was learned.
    ``rejected`` also marks texts below the floor of their nearest centroid; ties go to the first language in order.
    Whole texts are read; repeated rows and null ids are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                columns = list(zip(*judge(part.column(1).to_pylist(), model), strict=True))
                kinds = (pa.string(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "lang_pred", "score", "rejected"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {key}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns, whose text ``predict`` would not reject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield part.filter(pa.array([not r for *_, r in judge(part.column(part.schema.get_field_index("text")).to_pylist(), model)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(column: str = "doc_id"):
    """Remainder by 3 of the CRC-32 of the id as text; 1 is held out."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all -> (doc_id, held_out, lang_pred, score, rejected)."""
    rows = docs.select("doc_id", "text", "lang")
    model = fit(rows.where(fold() != 1))
    held = F.coalesce(fold() == 1, F.lit(False)).alias("held_out")
    return predict(rows, model).select("doc_id", held, "lang_pred", "score", "rejected")

"""Language identification: held-out accuracy and edge cases."""

import math
import zlib
from collections import Counter

import numpy as np

from gaugewright.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs)
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in rows) / len(rows) < 0.01


def test_edge_cases(spark):
    train = [(k, t * 5, lang, "x") for k, (t, lang) in enumerate([("the quick brown fox ", "en"), ("der schnelle braune fuchs ", "de"), ("the lazy dog ", "en"), ("ein fauler hund ", "de"), ("no label ", None)] * 6)]
    rows = [*train, (100, None, "en", None), (101, "", None, None), (102, "123 !?", "de", None), (103, "the fox " * 20000, None, None), (None, "der hund", None, None), (100, "the dog", "en", None), (104, "Ж日本語" * 30, None, None)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")).collect()
    assert len(out) == len(rows)
    by = {(r.doc_id, r.lang_pred): r for r in out}
    assert (100, "und") in by and (100, "en") in by
    assert by[101, "und"].rejected and by[102, "und"].score == 0
    assert (103, "en") in by and (None, "de") in by
    assert next(r for r in out if r.doc_id == 104).rejected


def test_nothing_to_learn(spark):
    rows = [(1, "abc", None)]
    assert [(r.lang_pred, r.rejected) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()] == [("und", True)]
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def trigrams(text):
    """Counts of byte trigrams: letters a-z and bytes of other letters by their low six bits, the rest a blank."""
    marks = [b - 96 if 97 <= b <= 122 else 27 + (b & 63) if b >= 128 else 0 for b in f" {text.lower()} ".encode()]
    return Counter(zip(marks, marks[1:], marks[2:], strict=False))


def test_whole_small_table_against_plain_cosines(spark):
    """Every prediction and score from plain vectors, all centroids compared one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.where(langid.fold() != 1))
    names = [(c // 91**2, c // 91 % 91, c % 91) for c in model.codes.tolist()]
    assert len(set(model.langs)) == 4 and len(model.langs) > 8
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.identify(docs).collect():
        tf = trigrams(texts[r.doc_id])
        v = [math.log1p(tf[n]) * float(w) for n, w in zip(names, model.idf, strict=True)]
        norm = math.sqrt(sum(x * x for x in v))
        cosines = [sum(x * float(y) for x, y in zip(v, c, strict=True)) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        assert abs(r.score - min(max(cosines[best], 0), 1)) < 1e-4
        assert r.lang_pred == model.langs[best] or max(c for c, x in zip(cosines, model.langs, strict=True) if x == r.lang_pred) > cosines[best] - 1e-5
        assert r.rejected == bool(r.score < model.floors[best])
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)


def test_samples_of_repeated_rows(spark):
    """Repeated rows count once and crowd out nothing; one id of very many texts is bounded like many ids of one text."""
    one_id = [(7, f"text {i}", "en") for i in range(4000)]
    repeated = [(100 + i, f"other {i}", "de") for i in range(40) for _ in range(100)]
    few = [(1, "only", "fr"), (1, "only", "fr"), (2, "null id's twin", "fr"), (None, "none", "fr")]
    rows = spark.createDataFrame(one_id + repeated + few, "doc_id long, text string, lang string")
    got = langid.sample_labelled(rows, 10).collect()
    assert Counter(r.lang for r in got) == {"en": 10, "de": 10, "fr": 2} and len({r.text for r in got}) == 22


def test_repeated_tables_learn_alike(spark):
    docs = spark.createDataFrame([(k, f"{t} {k}", lang) for k, (t, lang) in enumerate([("the quick brown fox", "en"), ("der schnelle braune fuchs", "de")] * 20)], "doc_id long, text string, lang string")
    many = docs
    for _ in range(5):
        many = many.union(many)
    once = {(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()}
    assert {(r.doc_id, r.lang_pred) for r in langid.identify(many).collect()} == once
    assert {lang for _, lang in once} == {"en", "de"}

"""Fingerprints and edited texts against plain comparison of strings."""

import hashlib
import random

import numpy as np
import pytest

from gaugewright.llm import fingerprints
from gaugewright.llm.queries import op13_fingerprints


def spans(text):
    """Distinct spans of up to WIDTH code points that end at each place."""
    return {text[max(0, e - fingerprints.WIDTH) : e] for e in range(1, len(text) + 1)}


def shared(a, b):
    return 1.0 if a == b else len(spans(a) & spans(b)) / max(1, len(spans(a) | spans(b)))


def begin(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def check(got, docs):
    """got: rows by id, docs: [(id, text)] in the order of succession."""
    assert len(got) == len(docs)
    errors = []
    for k, (doc_id, text) in enumerate(docs):
        r, following = got[doc_id], docs[(k + 1) % len(docs)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.fingerprint(text), fingerprints.fingerprint(edited))
        assert (r.common_edited, r.common_next) == (begin(text, edited), begin(text, following))
        assert (r.near_edited == 1.0) == (text == edited) and (r.near_next == 1.0) == (text == following)
        for value, other in ((r.near_edited, edited), (r.near_next, following)):
            exact = shared(text, other)
            if len(spans(text) | spans(other)) <= fingerprints.SKETCH:
                assert value == pytest.approx(exact, abs=1e-6)
            errors.append(value - exact)
    assert max(map(abs, errors)) < 0.25 and abs(np.mean(errors)) < 0.02


def test_extensions_of_any_two_places(monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", 64)  # many blocks; powers are made anew
    monkeypatch.setattr(fingerprints, "_powers", [])
    pick = random.Random(1)
    for _ in range(60):
        a = "".join(pick.choices("ab😀", k=pick.randint(0, 300)))
        b = a[pick.randint(0, len(a)) :] + "".join(pick.choices("ab", k=pick.randint(0, 40)))
        p, q = fingerprints.Prefixes(a), fingerprints.Prefixes(b)
        for _ in range(20):
            i, j = pick.randint(0, len(a)), pick.randint(0, len(b))
            assert p.extension(i, q, j) == begin(a[i:], b[j:])
            n = min(5, len(a) - i, len(b) - j)
            assert p.same(i, q, j, n) == (a[i : i + n] == b[j : j + n]) == (p.hash(i, i + n) == q.hash(j, j + n))
        assert len(np.unique([p.hash(e - min(e, 16), e) for e in range(1, len(a) + 1)], axis=0)) == len(spans(a)) if a else True


def test_blocks_do_not_show(monkeypatch):
    texts = ["".join(random.Random(k).choices("abcdefgh ", k=n)) for k, n in enumerate((0, 1, 63, 64, 65, 1000))]
    want = [fingerprints.fingerprint(t) for t in texts]
    monkeypatch.setattr(fingerprints, "BLOCK", 64)
    monkeypatch.setattr(fingerprints, "_powers", [])
    assert [fingerprints.fingerprint(t) for t in texts] == want
    assert fingerprints.likeness(want[0], want[0]) == 1.0 and fingerprints.likeness(want[0], want[5]) == 0.0


def test_edits_of_odd_rows(spark):
    pick = random.Random(2)
    texts = ["", "a", "ab", "abc", "abcd", "x" * 15, "x" * 16, "x" * 17, "y" * 400, "é😀̀" * 20, "word " * 40_000, *(" ".join(pick.choices(["one", "two", "three", "ünd"], k=pick.randint(1, 300))) for _ in range(50))]
    rows = [(k, t, "extra", 1) for k, t in enumerate(texts)] + [(100, "same text here", "z", 0), (101, "same text here", "z", 0), (99, None, "z", 0)]
    docs = sorted(((r[0], r[1] or "") for r in rows), reverse=True)
    frame = spark.createDataFrame(rows, "doc_id long, text string, piece string, lead int")
    for pieces in (1, 7, 400):
        check({r.doc_id: r for r in fingerprints.edits(frame, pieces).collect()}, docs)


def test_repeated_and_null_ids_and_empty_table(spark):
    schema = "doc_id long, text string"
    rows = spark.createDataFrame([(5, "b"), (5, "a"), (None, "zz"), (None, "yyy"), (9, "top text")], schema)
    got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in fingerprints.edits(rows).collect())
    order = [("9", "top text"), ("5", "a"), ("5", "b"), ("None", "yyy"), ("None", "zz")]
    edited = [t[: len(t) - len(t) // 3] + order[(k + 1) % 5][1][: len(t) // 3] for k, (_, t) in enumerate(order)]
    assert got == sorted((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, t), e in zip(order, edited, strict=True))
    (alone,) = fingerprints.edits(rows.where("doc_id = 9")).collect()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"top teto").hexdigest()
    assert fingerprints.edits(rows.where("doc_id is null")).count() == 2
    assert fingerprints.edits(rows.where("false")).collect() == []


def test_columns(spark):
    pairs = spark.createDataFrame([("abcdef", 2, "xxcdx", 2), ("a", 1, "b", 1), (None, 0, "b", 0), ("a", 5, "b", 0)], "a string, i int, b string, j int")
    assert [r.extension for r in fingerprints.with_extension(pairs, "a", "i", "b", "j").collect()] == [2, 0, None, None]
    marks = fingerprints.fingerprints(spark.createDataFrame([(1, "some text", 0), (2, "some text", 0), (3, None, 0)], "doc_id int, text string, n_chars int"))
    one, two, three = (r.fingerprint for r in marks.orderBy("doc_id").collect())
    assert one == two != three
    assert marks.select(fingerprints.likeness_of(marks.fingerprint, marks.fingerprint).alias("x")).distinct().collect()[0].x == 1.0


def test_query_on_the_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check({r.doc_id: r for r in op13_fingerprints(spark, "/root/testdata/sf0.001").collect()}, sorted(((r.doc_id, r.text or "") for r in rows), reverse=True))

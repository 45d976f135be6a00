"""Greedy string tiling against a plain implementation that compares words."""

import random

import numpy as np

from gaugewright.llm import decontaminate as d

DOCS, ITEMS = "doc_id long, text string, item_id string, body string", "item_id long, text string, doc_id string"


def plain_tiles(doc, test, least):
    """Repeat: find the longest run of equal unmarked words (first by document, then test position), mark it."""
    in_doc, in_test, total = [False] * len(doc), [False] * len(test), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(test)):
                n = 0
                while i + n < len(doc) and j + n < len(test) and doc[i + n] == test[j + n] and not in_doc[i + n] and not in_test[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        total += n
        in_doc[i : i + n] = [True] * n
        in_test[j : j + n] = [True] * n


def plain(rows, items, seed=5, least=0.8):
    out = []
    for doc_id, text, *_ in rows:
        for item_id, test in {(i[0], i[1]) for i in items}:
            a, b = d.words_of((text or "").encode()), d.words_of((test or "").encode())
            if b:
                matched = plain_tiles(a, b, min(seed, len(b)))
                if matched >= least * len(b):
                    out.append((str(doc_id), str(item_id), matched, len(b)))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), str(r.item_id), r.matched, r.words) for r in df.collect())


def made():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 24))), "x") for i in range(25)]
    items += [(100, None, None), (101, "", None), (102, " ?! ", None), (None, "é ü ö ä ß ñ", None), items[0]]
    rows = []
    for i in range(60):
        t = items[rng.randrange(25)][1].split()
        cut = rng.randint(0, len(t))
        moved = t[cut:] + rng.choices(words, k=rng.randint(0, 3)) + t[:cut]
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(0, 6)) + moved).upper(), "clash", "b"))
    rows += [(70, None, "", ""), (71, "", "", ""), (72, "É Ü", "", ""), (73, "x é ü ö ä ß ñ y", "", ""), (None, items[1][1], "", ""), rows[0]]
    return rows, items


def test_made_rows(spark):
    rows, items = made()
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    want = plain(rows, items)
    assert len(want) > 30
    assert result(d.leaks(docs, bench)) == want
    left = sorted(str(r.doc_id) for r in d.clean(docs, bench).collect())
    dirty = {x[0] for x in want}
    assert left == sorted(str(r[0]) for r in rows if str(r[0]) not in dirty)


def test_blocks_give_the_same(spark, monkeypatch):
    rows, items = made()
    monkeypatch.setattr(d, "BLOCK_BYTES", 300)
    assert result(d.leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS))) == plain(rows, items)


def test_reordered_passage_in_a_long_text(spark):
    rng = random.Random(9)
    test = [f"q{i}" for i in range(40)]
    filler = rng.choices(["some", "other", "words"], k=20000)
    text = " ".join([*filler, *test[20:], *filler, *test[:20], *filler])
    bench = spark.createDataFrame([(1, " ".join(test))], "item_id int, text string")
    (row,) = d.leaks(spark.createDataFrame([(5, text)], "doc_id int, text string"), bench).collect()
    assert (row.tiles, row.coverage) == (2, 1.0)


def test_empty(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert d.leaks(docs, bench).count() == 0
    assert d.leaks(spark.createDataFrame([(1, "a", "", "")], DOCS), bench).count() == 0
    assert d.clean(spark.createDataFrame([(1, "a", "", "")], DOCS), bench).count() == 1


def test_tiles_of_repetitive_words():
    rng = random.Random(4)
    for _ in range(300):
        doc, test = ([rng.randint(1, 3) for _ in range(rng.randint(1, 30))] for _ in range(2))
        least = rng.randint(1, 4)
        got = d.tiles(np.array(doc, np.uint64), np.array(test, np.uint64), least)
        assert sum(n for n, *_ in got) == plain_tiles(doc, test, least)
        assert all(doc[a : a + n] == test[b : b + n] for n, a, b in got)


def test_very_long_repetitive_text(spark):
    bench = spark.createDataFrame([(1, "the " * 200), (2, "the end " * 100)], "item_id int, text string")
    docs = spark.createDataFrame([(5, "the " * 300000), (6, "an end, " * 50000), (7, "the the end " * 3000)], "doc_id int, text string")
    assert result(d.leaks(docs, bench)) == [("5", "1", 200, 200)]

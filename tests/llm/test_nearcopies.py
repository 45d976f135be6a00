"""Near copies against all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from gaugewright.llm import nearcopies


def brute(rows):
    sets = {d: set(nearcopies.shingles(t.encode() if t else None).tolist()) for d, t in rows}
    part = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    while any(part[a] != part[b] for a, b in links):
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    return part


@pytest.mark.parametrize("limit", [48, 2])
def test_near_copies(spark, limit):
    rng = np.random.default_rng(1)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows, line = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE  two"), (5, "one two three")], " ".join(words(9))
    for _ in range(12):
        base = words(int(rng.integers(20, 300)))
        for _ in range(8):
            text = list(base)
            for at in rng.integers(0, len(text), int(rng.integers(0, max(2, len(text) // 40)))):
                text[at] = words(1)[0]
            rows.append((len(rows) + 10, line + "\n" + " ".join(text)))
    chain = words(200)
    rows += [(500 + i, " ".join(chain[3 * i :] + words(3 * i))) for i in range(8)]
    long = words(1500)  # sizes on both sides of a power of two have different numbers of cells
    rows += [(600 + i, " ".join(long[: 980 + 20 * i])) for i in range(8)] + [(700, " ".join(reversed(long)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len(set(want.values())) < len(rows) - 20
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs, frequent=limit).collect()} == want
    left = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert {r.doc_id for r in left} == set(want.values())


def test_defined_cases(spark):
    schema = "doc_id long, text string, body string, node string, h string"
    rows = [(1, "a b c d e f", "x", "y", "z"), (1, "a b c d e f", None, "", ""), (None, "A  b c d e f", "", "", ""), (3, None, "", "", ""), (2, "", "", "", ""), (4, "w " * 60000, "", "", ""), (None, "only this one here now", "", "", "")]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in nearcopies.near_copies(docs).collect())
    assert got == sorted([("1", "1"), ("1", "1"), ("None", "1"), ("3", "2"), ("2", "2"), ("4", "4"), ("None", "None")])
    left = corpus_pipeline.near_copies(spark, docs, "")
    assert left.columns == docs.columns
    want = sorted([("1", "x"), ("1", "None"), ("None", ""), ("None", ""), ("2", ""), ("4", "")])
    assert sorted((str(r.doc_id), str(r.body)) for r in left.collect()) == want
    assert nearcopies.near_copies(spark.createDataFrame([], schema)).count() == 0

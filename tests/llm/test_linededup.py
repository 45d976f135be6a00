"""Line dedup against a comparison of all pairs of positions."""

import random

import pytest

from gaugewright.llm import linededup

SCHEMA = "doc_id long, text string, line string, seq int, removed string"


def brute(rows, min_words):
    """Texts per (id, text), by the definition: any run with enough words that also stands earlier."""
    docs = {}
    for r in rows:
        if r[1] is not None:
            docs.setdefault((r[0] is None, r[0] or 0, r[2]), r[1])
    order = sorted(docs)
    places, gone = [], {k: set() for k in order}
    for k in order:
        lines = docs[k].split("\n")
        worded = [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        places += [(k, n, worded) for n in range(len(worded))]
    for b, (kb, sb, wb) in enumerate(places):
        for ka, sa, wa in places[:b]:
            n = 0
            while sa + n < len(wa) and sb + n < len(wb) and wa[sa + n][1] == wb[sb + n][1]:
                n += 1
            if sum(len(wb[sb + j][1].split()) for j in range(n)) >= min_words:
                gone[kb].update(wb[sb + j][0] for j in range(n))
    return gone


@pytest.mark.parametrize("min_words", [1, 3, 7])
def test_made_rows(spark, min_words):
    rng = random.Random(min_words)
    lines = ["a", "b c", "d e f", "", "  ", "g", "h i j k", " a "]
    rows = [[i, "\n".join(rng.choices(lines, k=rng.randint(1, 12)))] for i in range(30)]
    rows += [[100, rows[3][1]], [101, rows[3][1]], [50, "u1 u2\nu3\nu4 u5\nu6"], [51, "zz\nu1 u2\nu3\nu4 u5\nu6\nyy"], [52, "u3\nu4 u5"], [60, None], [61, ""], [None, rows[5][1]], [7, rows[7][1]], [62, "r\n" * 9 + "r"]]
    docs = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], SCHEMA)
    sums = {(r[0], r[1]): r[2] for r in docs.selectExpr("doc_id", "text", "xxhash64(text)").collect()}
    gone = brute([[*r, sums[r[0], r[1]]] for r in rows], min_words)
    out = linededup.line_dedup(docs, min_words).collect()
    assert len(out) == len(rows)
    texts = {}
    for r in out:
        texts.setdefault(r.doc_id, []).append((r.text, sorted(r.lines_removed)))
        assert (r.line, r.seq, r.removed) == ("clash", 1, "x")
    for doc_id, text in rows:
        want = gone[doc_id is None, doc_id or 0, sums[doc_id, text]] if text is not None else set()
        parts = text.split("\n") if text is not None else []
        left = [x for i, x in enumerate(parts) if i not in want]
        cleaned = text if not want else "" if not any(x.strip() for x in left) else "\n".join(left)
        assert (cleaned, sorted(want)) in texts[doc_id], (doc_id, text)


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    rows = docs.selectExpr("doc_id", "text", "xxhash64(text) as s").collect()
    gone = brute(rows, 20)
    got = {r.doc_id: sorted(r.lines_removed) for r in linededup.line_dedup(docs).collect()}
    assert got == {r.doc_id: sorted(gone[False, r.doc_id, r.s]) for r in rows}


def test_empty(spark):
    assert linededup.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "a b c\nd", 1, 2, "x", "y", 3), (2, "a b c\ne", 1, 2, "x", "y", 3)], "doc_id long, text string, gw_doc int, gw_absent int, `GW_sum` string, gw_removed string, `a``b.c` int")
    out = linededup.line_dedup(docs, 3)
    assert out.columns == [*docs.columns, "lines_total", "lines_removed"]
    assert sorted((r.doc_id, r.text, r.gw_doc, r.gw_removed, r["a`b.c"]) for r in out.collect()) == [(1, "a b c\nd", 1, "y", 3), (2, "e", 1, "y", 3)]

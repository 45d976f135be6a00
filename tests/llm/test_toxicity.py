"""Toxicity: exact neighbours against brute force, held-out ranking, edge cases."""

import math
import zlib
from collections import Counter

import numpy as np

from gaugewright.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, score double"


def test_block_max_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(900):
        v = {int(t): float(x) for t, x in zip(rng.choice(80, rng.integers(1, 12), replace=False), rng.random(12) + 0.01, strict=False)}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / norm for t, x in sorted(v.items())})
    rows = [(np.array(list(v), np.int64), np.array(list(v.values()), np.float32)) for v in vectors]
    index = toxicity.BlockMax(list(range(900)), np.zeros(900), rows, 80)
    assert index.blocks > 10
    for q in vectors[:60]:
        near = index.nearest(np.array(list(q), np.int64), np.array(list(q.values()), np.float32), 7)
        true = sorted((sum(q[t] * v.get(t, 0) for t in q) for v in vectors), reverse=True)[:7]
        assert np.allclose([c for c, _ in near], true[: len(near)], atol=1e-5)
        assert len(near) == sum(x > 0 for x in true)
        for c, i in near:
            assert abs(sum(q[t] * vectors[index.ids[i]].get(t, 0) for t in q) - c) < 1e-5


def test_scores_are_votes_of_the_nearest_by_brute_force(spark):
    """The whole small table: plain vectors over all words of the examples, all cosines, the k largest."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: Counter(toxicity.words_of((r.text or "").encode())) for r in docs.collect()}
    known = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts}
    n = [sum(y == k for y in known.values()) for k in (0, 1)]
    assert min(n) > 3
    by = [Counter(w for i, y in known.items() if y == k for w in texts[i]) for k in (0, 1)]
    df = Counter(w for t in texts.values() for w in t)
    odds = {w: math.log((by[1][w] + 5) / (n[1] + 10)) - math.log((by[0][w] + 5) / (n[0] + 10)) for w in by[0].keys() | by[1].keys()}
    factor = {w: (math.log((len(texts) + 1) / (df[w] + 1)) + 0.01) * (0.01 + x * x) for w, x in odds.items()}

    def vector(counts):
        v = {w: (1 + math.log(c)) * factor[w] for w, c in counts.items() if w in factor}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    examples = {i: vector(texts[i]) for i in known}
    model = toxicity.fit(docs, labels.where(toxicity.fold() != 0))
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == len(texts)
    for doc_id, counts in texts.items():
        q = vector(counts)
        near = sorted(((sum(x * v.get(w, 0) for w, x in q.items()), i) for i, v in examples.items()), reverse=True)[:10]
        near = [(c, i) for c, i in near if c > 0]
        vote = sum(c * c * known[i] for c, i in near) / (sum(c * c for c, _ in near) + 0.05)
        shown = [float(x.rsplit(":", 1)[1]) for x in got[doc_id].evidence.split(",") if x]
        assert np.allclose(shown, [c for c, _ in near[:3]], atol=2e-3)
        assert abs(got[doc_id].score - model.score(vote)) < 1e-3
    assert sum(r.evidence == "" for r in got.values()) <= 0.02 * len(got)


def made():
    mild, rude = ["sun", "tree", "river", "stone"], ["zork", "blarg", "snik"]
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        words = [*rng.choice(mild, 12), *(rng.choice(rude, 3) if bad else [])]
        rows.append((i, " ".join(words), "x", None))
        labels.append((i, 1, int(bad), "clash"))
    return rows, labels


def test_made_labels_and_edge_cases(spark):
    rows, labels = made()
    rows += [(500, None, "", 1.0), (501, "", "", 1.0), (502, "zork BLARG snik", "", 1.0), (503, "sun " * 50000 + "zork blarg", "", 1.0), (None, "snik snik", "", 1.0), rows[0]]
    labels += [(None, 1, 1, ""), (3, 1, None, ""), labels[1], (9999, 1, 1, "")]
    out = toxicity.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")).collect()
    assert len(out) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    by = {r.doc_id: r for r in out}
    assert [by[k].predicted for k in (500, 501, 502, None)] == [0, 0, 1, 1]
    assert by[503].score > by[500].score
    truth = {i: y for i, _, y, _ in labels[:300]}
    assert sum(by[i].predicted == y for i, y in truth.items()) > 290
    assert by[502].evidence.count(":1:") == 3


def test_one_sided_and_empty_labels(spark):
    docs = spark.createDataFrame([(1, "a", "", 0.0), (7, "b", "", 0.0)], SCHEMA)
    schema = "doc_id long, toxic int"
    assert {r.score for r in toxicity.classify(docs, spark.createDataFrame([], schema)).collect()} == {0.0}
    assert {r.score for r in toxicity.classify(docs, spark.createDataFrame([(1, 1), (7, 1), (2, 1)], schema)).collect()} == {1.0}
    assert toxicity.classify(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1)], schema)).count() == 0


def test_held_out_ranking(spark):
    out = toxicity.classify(*(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")))
    rows = out.where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    good, bad = [r.score for r in rows if not r.toxic], [r.score for r in rows if r.toxic]
    below = Counter(good)
    auc = sum(sum(n * (1.0 if g < b else 0.5 if g == b else 0.0) for g, n in below.items()) for b in bad) / len(good) / len(bad)
    assert auc > 0.93

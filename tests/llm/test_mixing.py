"""Mixing: totals meet targets, rates match a reference solver, posteriors hold out, edge cases."""

import numpy as np

from gaugewright.llm import mixing

SCHEMA = "doc_id long, text string, rate string, tokens string"


def made(n=240):
    rng = np.random.default_rng(1)
    words = {"a": ["ant", "ape", "axe"], "b": ["bee", "bat", "box"], "c": ["cat", "cow", "cup"]}
    rows, labels = [], []
    for i in range(n):
        d = "aaabbc"[i % 6]
        rows.append((i, " ".join(rng.choice([*words[d], "the", "of"], rng.integers(5, 40))), "clash", None))
        labels.append((i, d))
    return rows, labels


def test_targets_are_met(spark):
    rows, labels = made()
    extra = [(900, None, "", ""), (901, "", "", ""), (902, "zzz " * 30000, "", ""), (None, "bee bat", "", ""), rows[5]]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    known = spark.createDataFrame([*labels[:120], labels[0], (None, "a"), (1, None)], "doc_id long, domain string")
    out = mixing.mix(docs.where("doc_id < 900"), known, {"a": 0.2, "b": 0.3, "c": 0.5}).collect()
    total = sum(r.tokens for r in out)
    for d, share in (("a", 0.2), ("b", 0.3), ("c", 0.5)):
        assert abs(sum(r.tokens * r.rate * r[f"p_{d}"] for r in out) / total - share) < 0.02
    assert all(r.rate >= 0 for r in out)
    truth = dict(labels)
    assert sum(max("abc", key=lambda d: r[f"p_{d}"]) == truth[r.doc_id] for r in out) > 0.95 * len(out)
    whole = mixing.mix(docs, known, {"a": 0.5, "b": 0.25, "c": 0.25}).collect()
    assert len(whole) == len(rows) + len(extra)
    assert all(abs(r.p_a + r.p_b + r.p_c - 1) < 1e-9 for r in whole)
    assert next(r.tokens for r in whole if r.doc_id == 900) == 0


def test_rates_match_a_plain_solver(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.3, 0.3], 60)
    w = rng.integers(1, 50, 60)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(w, p, strict=True)], "mix_tokens long, mix_p array<double>")
    targets = [0.7, 0.3, 0.0]
    got = mixing.fit_rates(members, targets, ridge=0.01, steps=300, tolerance=1e-12, even=False).at(p)[0]
    share, r = w / w.sum(), np.ones(60)
    for _ in range(100000):
        error = (share * r) @ p - targets
        r = np.maximum(0, r - 0.5 * (p @ error + 0.01 * (r - 1)))
    assert np.abs(got - r).max() < 1e-3
    assert (r == 0).any()


def test_rare_domains_meet_their_targets(spark):
    rng = np.random.default_rng(7)
    hard = [[0.99, 0.0, 0.01] if i % 250 else [0.0, 1.0, 0.0] for i in range(2000)]
    members = spark.createDataFrame([(int(w), x) for w, x in zip(rng.integers(20, 60, 2000), hard, strict=True)], "mix_tokens long, mix_p array<double>")
    got = mixing.fit_rates(members, [0.9, 0.05, 0.01])
    assert np.abs(got.totals - [0.9, 0.05, 0.01]).max() < 0.002
    assert len(got.history) < 40


def test_posteriors_match_a_plain_sum(spark):
    rows, labels = made(60)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, domain string")
    model = mixing.fit_posterior(docs, known, chi2=1.0)
    assert model.domains == ["a", "b", "c"] and len(model.at) > 3
    for r in mixing.posteriors(docs.select("doc_id", "text"), model).collect():
        z = [model.weights[-1][k] + sum(model.weights[i][k] for f, i in model.at.items() if f in mixing.features(r.text.encode())) for k in range(3)]
        p = np.exp(np.array(z) - max(z))
        assert np.allclose(r.mix_p, p / p.sum()) and r.mix_tokens == len(r.text.split())


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a", "", ""), (2, None, "", "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, domain string")
    for r in mixing.mix(docs, none, {"x": 0.5, "y": 0.25}).collect():
        assert (r.p_x, r.p_y) == (0.5, 0.5)
    assert [r.rate for r in mixing.mix(docs, none, {}).collect()] == [1.0, 1.0]
    docs = docs.where("doc_id = 1")
    known = spark.createDataFrame([(1, "a")], "doc_id long, domain string")
    assert mixing.mix(docs.where("false"), known, {"a": 1.0}).count() == 0
    (row,) = mixing.mix(docs, known, {"a": 1.0}).collect()
    assert abs(row.rate - 1) < 1e-6
    (row,) = mixing.mix(docs, spark.createDataFrame([(7, "a"), (8, "a"), (9, "b"), (6, "a")], "doc_id long, domain string"), {"a": 1.0}).collect()
    assert abs(row.p_a - 0.75) < 1e-9


def test_domains_of_other_types_and_names(spark):
    rows, labels = made(60)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs, spark.createDataFrame([(i, "abc".index(d)) for i, d in labels], "doc_id long, domain int"), {"0": 0.5, "1": 0.25, "2": 0.25})
    assert {"p_0", "p_1", "p_2"} <= set(out.columns) and out.count() == 60
    names = {"a": "feature", "b": "n", "c": "rate.x`y"}
    out = mixing.mix(docs, spark.createDataFrame([(i, names[d]) for i, d in labels], "doc_id long, domain string"), {"feature": 0.4, "n": 0.3, "rate.x`y": 0.3})
    assert {"p_feature", "p_n", "p_rate.x`y"} <= set(out.columns) and out.count() == 60


def test_reached_totals(spark):
    rows, labels = made()
    targets = {"a": 0.3, "b": 0.3, "c": 0.4}
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, domain string"), targets)
    for r in mixing.reached(out, targets).collect():
        assert r.target == targets[r.domain] and abs(r.total - r.target) < 0.01


def test_one_text_of_an_id(spark):
    from gaugewright.llm.common import one_text

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, None), (3, "c"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in one_text(rows, "text", "doc_id").collect()}
    assert len(got) == 3 and got[1] in ("a", "b") and got[2] is None

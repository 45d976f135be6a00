"""Embedding near-duplicates against brute force."""

import numpy as np

from gaugewright.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, node string"


def brute(rows, threshold=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v, *_ in rows]
    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i].add(j)
    part = list(range(n))
    for _ in range(n):
        new = [min([part[i], *(part[j] for j in links[i])]) for i in range(n)]
        if new == part:
            break
        part = new
    least = {}
    for i, p in enumerate(part):
        if rows[i][0] is not None:
            least[p] = min(least.get(p, rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), len(links[i]), str(least.get(part[i])), rows[i][0] == least.get(part[i])) for i in range(n))


def result(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in df.collect())


def test_edge_cases_and_cliques(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(i, base[i].tolist(), "x") for i in range(40)]
    rows += [(100 + i, (base[1] + 0.05 * rng.standard_normal(16)).tolist(), None) for i in range(60)]
    rows += [(200 + i, base[2].tolist(), "copy") for i in range(5)]
    rows += [(300, None, None), (301, [0.0] * 16, None), (302, [None] + [1.0] * 15, None), (303, [float("nan")] * 16, None), (304, [float("inf")] + [0.0] * 15, None), (305, [], None)]
    rows += [(306, [1.0, 0.0], None), (307, [2.0, 0.0], None), (None, base[3].tolist(), None), (None, [1.0, 5.0, 9.0], None), (5, base[6].tolist(), None), (40, base[5].tolist(), None)]
    assert result(neighbours.near_dedup(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_component_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(4)
    center = rng.standard_normal(8)
    rows = [(i, (center + 0.3 * rng.standard_normal(8)).tolist(), "") for i in range(150)]
    assert result(neighbours.near_dedup(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_whole_table(spark):
    """No pair of these vectors is linked, so the recall is unknown."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found = neighbours.near_dedup(table)
    assert result(found) == brute(rows)
    assert {r.audited_recall for r in found.select("audited_recall").distinct().collect()} == {None}


def test_planted_groups_of_many_sizes(spark):
    """5000 vectors: pairs, groups to 600, and single ones; every link and component, and the audit per node."""
    rng = np.random.default_rng(11)
    vectors = []
    for size in [2] * 200 + [5] * 60 + [30] * 10 + [200, 600]:
        center = rng.standard_normal(24)
        spread = rng.choice([0.05, 0.25])
        vectors += [center + spread * rng.standard_normal(24) for _ in range(size)]
    vectors += list(rng.standard_normal((5000 - len(vectors), 24)))
    order = rng.permutation(len(vectors))
    x = np.array(vectors)[order]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    least = np.arange(len(x))
    while True:
        lower = np.array([min(least[i], least[near[i]].min(initial=len(x))) for i in range(len(x))])
        if (lower == least).all():
            break
        least = lower
    found = {r.vec_id: r for r in neighbours.near_dedup(spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], SCHEMA)).collect()}
    assert all(found[i].n_links == near[i].sum() and found[i].component_id == least[i] for i in range(len(x)))
    assert found[0].audited_recall >= 0.995


def test_empty(spark):
    assert neighbours.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_between_tight_groups_larger_than_a_list(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g, size in enumerate((12, 20, 100)):
        a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
        for side, center in enumerate((a, 0.94 * a + np.sqrt(1 - 0.94**2) * b)):
            rows += [(1000 * g + 500 * side + i, (center + 0.005 * rng.standard_normal(32)).tolist(), "") for i in range(size)]
    found = result(neighbours.near_dedup(spark.createDataFrame(rows, SCHEMA)))
    assert found == brute(rows)
    assert {n for _, n, *_ in found} == {23, 39, 199}


def test_groups_that_link_only_at_their_rims(spark):
    rng = np.random.default_rng(6)
    turn = lambda degrees: np.array([np.cos(np.radians(degrees)), np.sin(np.radians(degrees))] + [0.0] * 6)
    centers = [turn(d) for d in (0, 10, 34, 44, 180)]  # rims 24 degrees apart, centres 34; the last is far from all
    rows = [(100 * g + i, (c + 0.002 * rng.standard_normal(8)).tolist(), "") for g, c in enumerate(centers) for i in range(30)]
    assert result(neighbours.near_dedup(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_missed_recall_is_made_up_for(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_audit", lambda *_: 0.0)
    monkeypatch.setattr(neighbours, "_refine", lambda lists, nodes, k: lists.where("u % 3 = 0"))
    rng = np.random.default_rng(7)
    base = rng.standard_normal((20, 16))
    rows = [(i, (base[i % 20] + 0.1 * rng.standard_normal(16)).tolist(), "") for i in range(120)]
    assert result(neighbours.near_dedup(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_tight_blocks_are_counted_without_comparing_them(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(8)
    center, other = rng.standard_normal((2, 8))
    rows = [(i, (center + 0.01 * rng.standard_normal(8)).tolist(), "") for i in range(200)] + [(500 + i, (other + 0.3 * rng.standard_normal(8)).tolist(), "") for i in range(60)]
    rows += [(900 + i, rows[i][1], "copy") for i in range(40)]
    compared = []
    groups = neighbours._groups

    def watched(df, keys, work, schema, names):
        if names == ["node", "links"]:
            compared.append(df.where("node is not null").select("component").distinct().count())
        return groups(df, keys, work, schema, names)

    monkeypatch.setattr(neighbours, "_groups", watched)
    found = result(neighbours.near_dedup(spark.createDataFrame(rows, SCHEMA)))
    assert found == brute(rows)
    parts = {c for _, n, c, _ in found if n}
    assert compared and compared[0] < len(parts)  # the tight component is not among them

import numpy as np

from sluice.llm import embedding_links
from sluice.llm.embedding_links import link_vectors, quantise


def brute(rows, threshold=0.9):
    usable = [(i, np.array(x, float)) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(np.array(x, float)).all() and np.any(x)]
    links, root = {}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(usable):
        for j, b in usable[:k]:
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (links.get(i, 0), find(i)) for i, _ in rows}


def got(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS label", "3 AS rep").repartition(3)
    found = [(r.vec_id, r.n_links, r.component_id) for r in link_vectors(df).collect()]
    assert len(found) == len(rows)
    return {i: (n, c) for i, n, c in found}


def made(rng, n, dim=16):
    base = rng.standard_normal((n // 6, dim))
    x = base[rng.integers(0, len(base), n)] * rng.uniform(0.5, 2, (n, 1)) + rng.standard_normal((n, dim)) * rng.choice([0, 0.1, 0.3, 0.6], (n, 1))
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_against_all_pairs(spark, monkeypatch):
    rows = made(np.random.default_rng(1), 500)
    rows += [(1000 + k, rows[7][1]) for k in range(30)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [float("inf")] * 16), (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (2007, []), (2008, [1e-200] * 16), (2009, [1e200] * 16)]
    want = brute([r for r in rows if r[0] < 2008])
    found = got(spark, rows)
    assert {i: x for i, x in found.items() if i < 2008} == want
    assert found[2008] == found[2009] and found[2008][0] >= 1
    monkeypatch.setattr(embedding_links, "LEAST_TILE", 60)
    monkeypatch.setattr(embedding_links, "BLOCK", 16)
    assert {i: x for i, x in got(spark, rows).items() if i < 2008} == want


def test_wide_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = made(rng, 60, dim=2500)
    assert got(spark, rows) == brute(rows)
    # all components at the largest value: sums beyond what single precision holds exactly
    q = np.full((2, 3 * embedding_links.DIMS + 7), 127, np.float32)
    q[1, ::2] = -126
    want = q.astype(np.int64) @ q.astype(np.int64).T
    assert (embedding_links.integer_products(q, q) == want).all()
    flat = [(i, (np.ones(3000) + (k == 1) * 1e-3 * rng.standard_normal(3000)).tolist()) for i, k in enumerate([0, 1, 1, 1])]
    assert got(spark, flat) == brute(flat)


def test_one_hot_group_and_pairs_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(embedding_links, "LEAST_TILE", 50)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(8)
    rows = [(i, (centre + 0.25 * rng.standard_normal(8)).tolist()) for i in range(300)]
    # exactly 0.9 in double precision: 9 of 10 equal units of length
    rows += [(1000, [9.0, 1.0] + [0.0] * 6), (1001, [1.0] + [0.0] * 7), (1002, [3.0, 1.0] + [0.0] * 6), (1003, [0.9, 0.19**0.5] + [0.0] * 6)]
    assert got(spark, rows) == brute(rows)
    assert embedding_links.TILES and got(spark, rows) == got(spark, rows[::-1])


def test_labels_of_edges():
    rng = np.random.default_rng(6)
    for n in (1, 5, 80):
        label, root = np.arange(n), list(range(n))
        for _ in range(4):
            u, v = rng.integers(0, n, (2, n // 4))
            embedding_links.join(label, u, v)
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
        assert label.tolist() == root


def test_error_bound():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 24)) * rng.choice([1, 10], (300, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e, n = quantise(x)
    assert np.abs(q).max() <= 127
    off = np.abs(x @ x.T - (q.astype(float) @ q.T.astype(float)) * s[:, None] * s)
    assert (off <= e[:, None] * n + e[None] + 1e-12).all()


def test_edges(spark):
    assert link_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (3, None)], "vec_id long, embedding array<double>")
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in link_vectors(df).collect()), key=str) == sorted([(1, 1, 1), (1, 1, 1), (None, 0, None), (3, 0, 3)], key=str)


def test_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r.vec_id, list(r.embedding)) for r in df.collect()])
    assert {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(df).collect()} == want

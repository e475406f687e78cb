"""Leader clustering against the rule itself, member by member."""

import time

import numpy as np
import pytest

from sluice.operators.cluster import MODES, TILE, Leader, similar_pairs, tile_pairs


def by_rule(vectors, right, threshold, share, mode):
    """Each item in turn, with all members looked at."""
    groups, out = [], []
    for x, r in zip(vectors, right, strict=True):
        best, top = None, -np.inf
        for i, g in enumerate(groups):
            sim = g["rep"] @ x
            if sim <= threshold:
                continue
            if mode == "all":
                each = np.stack(g["members"]) @ x
                if not (each > threshold).all():
                    continue
                sim = each.mean()
            if sim > top:
                best, top = i, sim
        new = best is None
        if new:
            groups.append({"rep": x, "members": [], "right": 0})
            best = len(groups) - 1
        g = groups[best]
        g["members"].append(x)
        g["right"] += r
        m = np.stack(g["members"])
        if len(m) > 1 and mode == "centroid":
            g["rep"] = m.mean(0) / (np.linalg.norm(m.mean(0)) + 1e-8)
        elif len(m) > 1 and mode == "medoid":
            g["rep"] = m[int(np.argmax(m @ m.mean(0)))]
        out.append((best, bool(r) if new else g["right"] / len(m) > share))
    return out


def some(n, seed, spread, kinds=6, width=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(kinds, width))[rng.integers(0, kinds, n)] + spread * rng.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True), list(rng.random(n) < 0.6)


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("spread", [0.0, 0.2, 0.6, 3.0])
@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.95])
def test_same_clusters_as_the_rule(mode, spread, threshold):
    x, right = some(700, 3, spread)
    assert Leader(threshold, 0.5, mode).put_all(x, right) == by_rule(x, right, threshold, 0.5, mode)


def test_parts_of_a_sample_go_on_from_each_other():
    x, right = some(500, 5, 0.4)
    whole, parts = Leader(0.7), Leader(0.7)
    assert whole.put_all(x, right) == [p for a in range(0, 500, 77) for p in parts.put_all(x[a : a + 77], right[a : a + 77])]


def test_ties_go_to_the_first_cluster_and_zero_vectors_stay_alone():
    x = np.array([[1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [1.0, 1.0] / np.sqrt(2), [0.0, 0.0]])
    assert [c for c, _ in Leader(0.5).put_all(x, [True] * 5)] == [0, 1, 2, 0, 3]


def test_a_sample_of_a_hundred_thousand_steps():
    x, right = some(100_000, 7, 0.15, kinds=8, width=64)
    began = time.time()
    found = Leader(0.9).put_all(x, right)
    assert len(found) == 100_000 and time.time() - began < 60


def test_similar_pairs_of_odd_rows_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), int(i) % 50, [float(v) for v in np.float32(rng.normal(0, 1, 3 + int(k)))]) for i, k in enumerate(rng.integers(0, 3, 90))]
    rows += [(None, 1, [9.0] * 3), (0, None, [9.0] * 3), (0, 91, None), (0, 92, [9.0, None, 9.0]), (0, 93, [9.0]), (0, 94, [float("nan"), 1.0, 1.0]), (0, 95, [float("inf"), 1.0, -1.0]), (1, 96, []), (1, 97, [])]
    whole = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    want = []
    for k, a, x in whole:
        for j, b, y in whole:
            if k == j and a < b and len(x) == len(y):
                sim = 0.0
                for v, w in zip(x, y, strict=True):
                    sim += v * w
                if sim > 0.5 or sim != sim:
                    want.append((k, a, b, sim))
    got = similar_pairs(spark.createDataFrame(rows, "k int, id long, v array<float>"), "k", "id", "v", None, 0.5)
    assert got.columns == ["k", "a", "b", "sim"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_a_large_key_is_joined_by_tiles(spark):
    n = 4 * TILE
    rows = spark.range(n).selectExpr("1 AS k", "id", "array(cast(cos(id) AS float), cast(sin(id) AS float)) AS v")
    assert tile_pairs(rows, "k", "id", "v").count() == 10
    ids = np.arange(n)
    v = np.stack([np.cos(ids), np.sin(ids)], 1).astype(np.float32).astype(float)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(v @ v.T > 0.99999, 1)), strict=True)}
    assert {(r.a, r.b) for r in similar_pairs(rows, "k", "id", "v", None, 0.99999).collect()} == want

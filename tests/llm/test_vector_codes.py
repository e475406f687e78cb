import random
from collections import defaultdict

import numpy as np
import pytest

from sluice.llm import vector_codes
from sluice.llm.vector_codes import Nearest, codebooks_digest, compress


def brute(rows, parts=8, entries=16, rounds=6):
    """({(id, code, error, label_error)}, codebooks) by plain Python integers."""
    kept = [(i, [int(np.floor(4096 * float(y))) for y in v], g) for i, v, g in rows if v is not None and all(y is not None and np.isfinite(y) for y in v)]
    if not kept:
        return [], []
    m = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * m : (p + 1) * m]
    first = {}
    for i, v, _ in sorted(((i, [float(y) for y in v], 0) for i, v, _ in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    books = [[[int(y) for y in cut(v, p)] for v in list(first.values())[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x, p: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                held[p, nearest(cut(v, p), p)].append(cut(v, p))
        for (p, e), xs in held.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by_label = [], defaultdict(int)
    for i, v, g in kept:
        codes = [nearest(cut(v, p), p) for p in range(parts)]
        error = sum(far(cut(v, p), books[p][e]) for p, e in enumerate(codes))
        out.append((i, "".join(f"{c:02x}" for c in codes), error, g))
        by_label[g] += error
    return [(i, c, e, by_label[g]) for i, c, e, g in out], books


def made(n, m, seed=1):
    rng = random.Random(seed)
    return [(1000 - i, [rng.gauss(0, 0.3) for _ in range(m)], rng.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("m", [8, 24, 64])
def test_against_brute_force(spark, m):
    rows = made(150, m)
    # dropped vectors, repeated rows, ties, a null id, an id with two vectors
    rows += [(1, None, 0), (2, [None] * m, 0), (3, [float("nan")] * m, 1), (4, [float("inf")] * m, 1), (5, [-float("inf")] + [0.0] * (m - 1), 1)]
    rows += [(7, [0.5] * m, 2)] * 3 + [(7, [0.25] * m, 2), (8, [0.5] * m, None), (None, [0.1] * m, 1), (9, [-0.0] * m, 1), (10, [-1e-9] * m, 1)]
    df = spark.createDataFrame([(i, v, g, "x", 1) for i, v, g in rows], "vec_id long, embedding array<double>, label int, code string, id int").repartition(4)
    coded, books = compress(df)
    want, want_books = brute(rows)
    assert books.tolist() == want_books
    assert sorted(map(tuple, coded.collect()), key=repr) == sorted(want, key=repr)


def test_few_rows_and_none(spark):
    schema = "vec_id string, embedding array<float>, label string"
    df = spark.createDataFrame([("b", [1.0] * 8, "x"), ("a", [2.0] * 8, "x"), ("c", [2.0] * 8, None)], schema)
    coded, books = compress(df)
    assert sorted(map(tuple, coded.collect())) == [("a", "00" * 8, 0, 0), ("b", "01" * 8, 0, 0), ("c", "00" * 8, 0, 0)] and books.shape == (8, 3, 1)
    coded, books = compress(df.limit(0))
    assert coded.count() == 0 and codebooks_digest(books) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    nothing = spark.createDataFrame([(None, [0.5] * 8, None)], schema)
    assert [tuple(r) for r in compress(nothing, label_col=None)[0].collect()] == [(None, "00" * 8, 0)]


@pytest.mark.parametrize("vectors", [[[1.0] * 8, [1.0] * 16], [[1.0] * 9], [[]], [[1e30] * 8]])
def test_what_has_no_exact_code_is_an_error(spark, vectors):
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="components"):
        compress(df)[0].collect()


@pytest.mark.parametrize("m", [1, 2, 3, 7, 8, 16, 33])
def test_bounds_lose_no_entry(m):
    rng = np.random.default_rng(m)
    for high in (3, 200, 2**29 // m):
        entries, x = rng.integers(-high, high, (20, m)), rng.integers(-high, high, (400, m))
        x[:20] = entries  # distance 0
        entries[5] = entries[4]  # a tie
        x[20:40, : m // 2 + 1] = entries[:, : m // 2 + 1]
        find = Nearest(entries)
        got, least = find(x)
        far = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (least == far.min(axis=1)).all() and (got == far.argmin(axis=1)).all()
        assert find.exact <= find.pairs


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(5)
    entries = rng.normal(0, 1000, (64, 16)).astype(np.int64)
    x = entries[rng.integers(0, 64, 5000)] + rng.integers(-100, 100, (5000, 16))
    find = Nearest(entries)
    find(x)
    assert find.exact < find.pairs / 20


def test_lower_bounds_hold():
    rng = np.random.default_rng(9)
    x, c = rng.integers(-5000, 5000, (300, 13)), rng.integers(-5000, 5000, (300, 13))
    far = ((x - c) ** 2).sum(axis=1)
    for size in (13, 7, 4, 2, 1):
        bound = Nearest._bound(size, *vector_codes._blocks(x, size), *vector_codes._blocks(c, size))
        assert (bound <= far).all()

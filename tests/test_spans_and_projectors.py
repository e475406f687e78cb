import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions.arrays import _of_common_keys, dyadic_cells, overlap_join
from sluice.operators.projectors import Moments, group_projectors, projector, residual_energy


def test_cells_are_the_span(spark):
    rng = random.Random(1)
    spans = [(s, s + n) for s in range(-9, 9) for n in range(1, 20)] + [(s := rng.randint(-(10**12), 10**12), s + rng.randint(1, 10**9)) for _ in range(50)]
    df = spark.createDataFrame(spans, "s long, e long").withColumn("c", dyadic_cells(F.col("s"), F.col("e"), 30))
    for r in df.collect():
        parts = sorted((x.cell << x.level, (x.cell + 1) << x.level) for x in r.c)
        assert parts[0][0] == r.s and parts[-1][1] == r.e and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))  # noqa: B905
        assert len(parts) <= 2 * (r.e - r.s).bit_length()


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(2)
    made = lambda n: [(rng.choice([1, 2, None]), s := rng.randint(-30, 30), s + rng.choice([-1, 0, 1, 2, 7, 40, 10**9])) for _ in range(n)]
    a, b = made(80), made(80)
    left, right = spark.createDataFrame(a, "k int, start long, end long"), spark.createDataFrame(b, "k int, other int, other_end long")
    want = sorted((k, s, e, o, f) for k, s, e in a for j, o, f in b if k is not None and k == j and s < e and o < f and s < f and o < e)
    got = overlap_join(left, right, "k")
    assert got.columns == ["k", "start", "end", "other", "other_end"]
    assert sorted(map(tuple, got.collect())) == want
    assert overlap_join(left.limit(0), right, "k").count() == 0


def test_a_long_span_makes_few_rows(spark):
    left = spark.createDataFrame([(1, 0, 10**9)], "k int, start long, end long")
    right = spark.range(20000).select(F.lit(1).alias("k"), (F.col("id") * 60000).alias("other"), (F.col("id") * 60000 + 1).alias("other_end"))
    assert overlap_join(left, right, "k").count() == sum(60000 * i < 10**9 for i in range(20000))
    assert left.select(F.size(dyadic_cells(F.col("start"), F.col("end"), 29))).first()[0] <= 60


def test_pairs_of_one_key_are_dealt_over_tasks(spark):
    left = spark.range(600).coalesce(1).selectExpr("if(id >= 0, 1, 0) AS k", "id * 1000 AS start", "id * 1000 + 3000000000 AS end")
    right = spark.range(600).coalesce(1).selectExpr("if(id >= 0, 1, 0) AS k", "id * 1000 AS other", "id * 1000 + 1 AS other_end")
    rows = overlap_join(left, right, "k").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in rows) == 600 * 601 // 2
    assert max(r["count"] for r in rows) < 600 * 601 // 2 / 3


def test_rows_of_other_keys_are_left_out_before_spans_are_cut(spark):
    left = spark.range(1000).selectExpr("id AS k", "0 AS start", "5 AS end")
    right = spark.createDataFrame([(3, 1, 2), (3, 2, 9), (None, 1, 2), (5000, 1, 2)], "k long, other int, other_end int")
    assert [r.k for r in _of_common_keys(left, right, "k").collect()] == [3]
    assert overlap_join(left, right, "k").count() == 2


def test_moments_merge():
    rng = np.random.default_rng(3)
    x = rng.normal(1e4, 1, (500, 6)) * np.array([1, 2, 3, 0.1, 0, 5])
    total = None
    for part in np.array_split(x, [1, 2, 40, 300]):
        total = Moments.of(part) if total is None else total.merge(Moments.of(part))
    want = Moments.of(x)
    assert total.n == 500 and np.allclose(total.mean, want.mean) and np.allclose(total.products, want.products, rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize(("rank", "energy"), [(None, None), (1, None), (2, None), (None, 0.9), (3, 0.5)])
def test_projectors_are_those_of_the_decomposition(spark, rank, energy):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(0, 1, (300, 5)) * [5, 3, 2, 1, 0] + 7, "b": np.ones((4, 5)), "c": rng.normal(0, 1, (1, 5)), None: rng.normal(0, 1, (40, 5))}
    rows = [(g, v.tolist()) for g, x in groups.items() for v in x] + [("a", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v array<double>").repartition(5)
    found = {r.g: r for r in group_projectors(df, "g", "v", rank, energy).collect()}
    assert set(found) == set(groups)
    for g, x in groups.items():
        mean, basis, valid = projector(x, rank, energy)
        r = found[g]
        got = np.array(r.basis).reshape(-1, 5).T
        assert np.allclose(r.mu, mean) and r["rank"] == basis.shape[1]
        assert np.allclose(got @ got.T, basis @ basis.T, atol=1e-6)  # the same subspace, whatever the signs
        assert np.isclose(r.residual, residual_energy(x, mean, basis, valid), atol=1e-6)


def test_a_group_of_a_million_rows(spark):
    # one group has nearly all rows; their decomposition is that of the whole
    n = 1_000_000
    u, v = (F.col("id") % 1009) / 1009.0, (F.col("id") * 7 % 997) / 997.0
    df = spark.range(0, n, numPartitions=8).select(F.when(F.col("id") % 1000 == 0, "rare").otherwise("hot").alias("g"), F.array(u + v, u - v, u * 2.0, F.lit(1.0)).alias("v"))
    found = {r.g: r for r in group_projectors(df, "g", "v", None).collect()}
    i = np.arange(n)
    u, v = (i % 1009) / 1009.0, (i * 7 % 997) / 997.0
    x = np.stack([u + v, u - v, 2 * u, np.ones(n)], axis=1)
    for g, mask in (("hot", i % 1000 != 0), ("rare", i % 1000 == 0)):
        mean, basis, _ = projector(x[mask])
        got = np.array(found[g].basis).T
        assert found[g]["rank"] == basis.shape[1] == 2
        assert np.allclose(found[g].mu, mean) and np.allclose(got @ got.T, basis @ basis.T, atol=1e-8)

"""Hand vectors and invariants of the library's operators."""

import random
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sluice.functions import arrays as g
from sluice.functions import numeric as n
from sluice.functions import text as t
from sluice.operators import advantage as a
from sluice.operators import balance, batch, cluster, ingest, metrics, projectors, reward
from sluice.operators import segments as seg
from sluice.streaming import latents


def rows(spark, k=5):
    return spark.createDataFrame([(i, i * 10) for i in range(k)], "row_id long, x long")


def ordered(df, column="x"):
    return [r[column] for r in df.orderBy("row_id").collect()]


def test_gae_hand_vector(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.5, 0.5, 0.5], [1.0, 1.0, 1.0])], "rewards array<double>, values array<double>, mask array<double>")
    r = a.whiten_arrays(a.gae(df, 0.9, 0.95), "raw", "mask", "adv").first()
    assert np.allclose(r.raw, [4.4448125, 4.0875, 2.5]) and np.allclose(r.returns, [4.9448125, 4.5875, 3.0]) and np.allclose(r.adv, [0.741265, 0.396110, -1.137375], atol=1e-5)


def test_discounted_returns_stop_at_the_mask(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 1.0, 0.0]), ([1.0], [1.0]), ([], [])], "rewards array<double>, mask array<double>")
    got = [r.returns for r in a.discounted_returns(df, 0.9).collect()]
    assert np.allclose(got[0], [2.8, 2.0, 3.0]) and got[1] == [1.0] and got[2] == []


def test_group_estimators(spark):
    df = spark.createDataFrame([(i, "u", s) for i, s in enumerate([1.0, 0.0, 0.0, 1.0])], "row_id long, uid string, s double")
    assert np.allclose(ordered(df.select("row_id", a.advantage("grpo", F.col("s"), "uid").alias("x"))), [0.866024, -0.866024, -0.866024, 0.866024], atol=1e-5)
    assert np.allclose(ordered(df.select("row_id", a.advantage("rloo", F.col("s"), "uid").alias("x"))), [0.666667, -0.666667, -0.666667, 0.666667], atol=1e-5)
    with pytest.raises(NotImplementedError):
        a.advantage("none", F.col("s"), "uid")
    with pytest.raises(PySparkException):
        df.limit(1).select(a.advantage("grpo", F.col("s"), "uid")).collect()


def test_fill_left(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.0, 2.0, 0.0, 5.0, 0.0])], "r long, row_id long, v double")
    assert ordered(df.select("row_id", a.fill_left(F.col("v"), "r", "row_id").alias("x"))) == [2, 2, 5, 5, 0]


def test_losses(spark):
    df = spark.createDataFrame([(0, -1.5, -1.0, 1.0), (1, -1.0, -1.5, -1.0), (2, -2.0, -0.2, -1.0)], "row_id long, old double, new double, adv double")
    terms = n.policy_loss(F.col("old"), F.col("new"), F.col("adv"), 0.2, 0.3, 3.0)
    got = df.select("row_id", *(c.alias(k) for k, c in terms.items())).orderBy("row_id").collect()
    assert np.allclose([r.loss for r in got], [-1.3, 0.8, 3.0]) and [r.high_clip for r in got] == [1, 1, 0] and [r.low_clip for r in got] == [0, 0, 1]
    kl = df.limit(1).select(*(n.kl(F.lit(-1.0), F.lit(-0.5), k).alias(k) for k in ("low_var_kl", "mse", "abs", "kl"))).first()
    assert np.allclose(list(kl), [0.148721, 0.125, 0.5, -0.5], atol=1e-6)
    assert abs(n.adaptive_coefficient(0.001, 0.3, 64, 0.1, 10000) - 0.00100128) < 1e-12


def test_eos_mask_and_budget(spark):
    df = spark.createDataFrame([([0, 0, 2, 4, 3, 5, 1, 0, 0], 2000, 1500)], "ids array<long>, w int, h int")
    r = df.select(g.eos_mask(F.col("ids"), 1).alias("m"), n.budget_size(F.col("w"), F.col("h"), F.col("w") * F.col("h"), 2000 * 784).alias("s")).first()
    assert r.m == [1, 1, 1, 1, 1, 1, 1, 0, 0] and tuple(r.s) == (1428, 1064)


def test_spans_and_scores(spark):
    df = spark.createDataFrame([(1, 5, 7), (1, 1, 3), (1, 3, 4), (1, 9, 9)], "k long, start long, end long")
    assert sorted((r.start, r.end) for r in g.merge_spans(df, "k").collect()) == [(1, 4), (5, 7), (9, 9)]
    x = spark.range(1).select(reward.score(F.lit(1.0), F.lit(1.0), F.lit(120), F.lit(100)).alias("a"), reward.score(F.lit(1.0), F.lit(1.0), F.lit(120), F.lit(0)).alias("b")).first()
    assert abs(x.a.overall - 0.98) < 1e-9 and x.b.overall == 1.0
    ids = spark.createDataFrame([(s,) for s in ("0_1", "3", "2-7", "a_4_9", "abc")], "rid string").select(latents.parse_request(F.col("rid")).alias("x"))
    assert [tuple(r.x) for r in ids.collect()] == [("1", 0), ("3", 0), ("7", 2), ("9", 4), ("abc", 0)]
    assert spark.range(1).select(t.grouped_digits(F.lit("Hello 1234324asdasd"))).first()[0] == "Hello 1,234,324asdasd"


def test_batch_algebra(spark):
    df = rows(spark)
    assert ordered(batch.repeat_rows(df.limit(2), 2)) == [0, 0, 10, 10] and ordered(batch.repeat_rows(df.limit(2), 2, False)) == [0, 10, 0, 10]
    padded, pad = batch.pad_to_divisor(df, 4)
    assert pad == 3 and ordered(padded) == [0, 10, 20, 30, 40, 0, 10, 20] and ordered(batch.unpad(padded, 8, pad)) == [0, 10, 20, 30, 40]
    assert ordered(batch.slice_rows(df, 1, None, 2)) == [10, 30] and ordered(batch.slice_rows(df, -2)) == [30, 40]
    perm = batch.index_table(spark, [3, 1, 4, 0, 2])
    there = batch.take_rows(df, perm)
    assert ordered(there) == [30, 10, 40, 0, 20] and ordered(batch.take_rows(there, batch.inverse_permutation(perm))) == [0, 10, 20, 30, 40]
    with pytest.raises(ValueError):
        batch.chunk_ids(5, 2)
    with pytest.raises(ValueError):
        batch.split_ids(5, 6)
    with pytest.raises(KeyError):
        batch.select_columns(df, ["nope"])
    with pytest.raises(PySparkException):
        batch.union_columns(df, df.withColumn("x", F.col("x") + 1)).collect()
    with pytest.raises(ValueError):
        batch.from_columns(spark, {"a": "text"})
    batch.check_ids(df)
    with pytest.raises(ValueError):
        batch.check_ids(df.filter("row_id <> 2"))
    assert batch.unflatten_dict(batch.flatten_dict({"a": {"b": 1, "c": {"d": 2}}})) == {"a": {"b": 1, "c": {"d": 2}}}
    assert batch.positions(spark.createDataFrame([], "k long"), "k").count() == 0
    with pytest.raises(ValueError):
        batch.check_group_sizes(64, 1, 32, "grpo")


def test_retention(spark):
    steps = spark.createDataFrame([(s,) for s in (10, 20, 30, 40)], "step long")
    assert {r.step: r.keep for r in metrics.retained(steps, 50, 3).collect()} == {40: True, 30: True, 20: False, 10: False}
    assert all(r.keep for r in metrics.retained(steps, 50, 0).collect())


def test_balance():
    rng = random.Random(1)
    for _ in range(40):
        k = rng.randint(1, 6)
        lengths = [rng.randint(1, 900) for _ in range(k * rng.randint(1, 8))]
        parts = balance.balanced(lengths, k)
        assert sorted(i for p in parts for i in p) == list(range(len(lengths)))
        even = balance.balanced(lengths, k, equal_size=True)
        assert {len(p) for p in even} == {len(lengths) // k}
        assert {len(p) for p in balance.least_loaded(lengths, k, equal_size=True)} == {len(lengths) // k}
        sums = [sum(lengths[i] for i in p) for p in parts]
        worst = [sum(lengths[i] for i in range(j, len(lengths), k)) for j in range(k)]
        assert max(sums) <= max(worst) + max(lengths)
    assert sorted(sum([4, 5, 6, 7, 8][i] for i in p) for p in balance.balanced([4, 5, 6, 7, 8], 2)) == [14, 16]
    assert len(balance.parts_for_budget([5, 5, 5, 5], 10)) == 2
    with pytest.raises(ValueError):
        balance.parts_for_budget([11], 10)


def test_leader_clusters(spark):
    unit = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    steps = [(1, i, str(i), unit(d), ok) for i, (d, ok) in enumerate([(0, True), (10, False), (90, False), (5, True), (95, True)])]
    df = spark.createDataFrame(steps, "sample_id long, ord long, text string, embedding array<double>, lead_correct boolean").repartition(3)
    got = [(r.cluster, r.correct) for r in cluster.cluster_steps(df, 0.9).orderBy("ord").collect()]
    assert got == [(0, True), (0, False), (1, False), (0, True), (1, False)]
    for mode in cluster.MODES:
        assert cluster.cluster_steps(df, 0.9, mode=mode).select("cluster").distinct().count() == 2


def test_segments_and_observations():
    tags = seg.Tags(1, 2, 3, 4, 5, 6, 7, 8)
    ids = [1, 3, 2, 9, 1, 3, 3, 2, 4, 6, 6, 5, 7, 9, 9, 8, 0, 7, 9, 8, 1, 3, 2, 4, 6, 5, 9]
    question, steps = seg.segments(ids, tags)
    assert question == [1] and steps == [([5, 6], [9, 10], [[13, 14], [18]]), ([21], [24], [])]
    assert seg.segments([9, 9], tags) == ([], [])
    assert seg.strip_observations("a<observation>b<observation>c</observation>d</observation>e</observation>f<observation>g") == ("abcdefg", [(1, 4), (6, 7)])
    assert seg.observed_words("x <observation>y z</observation> w") == ("x y z w", [1, 2])


def test_projectors():
    rng = np.random.default_rng(0)
    flat = rng.standard_normal((50, 2)) @ rng.standard_normal((2, 6)) + 3
    mean, basis, valid = projectors.projector(flat)
    assert basis.shape == (6, 2) and valid and projectors.residual_energy(flat, mean, basis, valid) < 1e-20
    assert not projectors.projector(np.ones((4, 3)))[2]


def test_frames():
    frame = latents.encode_frame(["a_1", "b"], [[1.0, 2.0], None], 3, 1)
    events, rest = latents.decode_frames(frame + frame[:20])
    assert rest == frame[:20] and events == [{"req_ids": ["a_1", "b"], "latents": [[1.0, 2.0], None], "step": 3, "rank": 1}]
    assert latents.decode_frames(b"XXXX" + frame) == ([], b"")
    body = struct.pack(">H", 1) + b"r" + struct.pack(">B", 1) + np.array([0.5], "<f4").tobytes()
    size = struct.calcsize(">4sBBHIHIi")
    old = struct.pack(">4sBBHIHIi", b"AVTB", 1, 0, 0, size + len(body), 1, 1, -1) + body
    assert latents.decode_frames(old)[0] == [{"req_ids": ["r"], "latents": [[0.5]], "step": -1, "rank": None}]
    assert latents.decode_states([0, 1, 6, 6, 6, 1, 4, 0], 1, 4, 2) == [False, True, True, False, False, True, False, False]


def test_ingest_errors(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "i long, x string")
    with pytest.raises(ValueError):
        ingest.by_valid_ids(df, spark.createDataFrame([(5,)], "i long"), "i")
    with pytest.raises(ValueError):
        ingest.read_many(spark, ["x.csv"], "a int")
    with pytest.raises(PySparkException):
        df.select(ingest.dataset_name(F.col("x"))).collect()
    with pytest.raises(PySparkException):
        ingest.required(df, df.filter("i = 0").select("i", F.col("x").alias("y")), "i", "y").collect()
    df.write.parquet(f"{tmp_path}/d/a.parquet")
    (tmp_path / "f.py").write_text("def main(x, k=1):\n    return x + k\n")
    assert reward.load_function(f"{tmp_path}/f.py:main", k=3)(1) == 4 and reward.split_function_path("a/b.py") == ("a/b.py", "main")
    with pytest.raises(AttributeError):
        reward.load_function(f"{tmp_path}/f.py:nope")
    assert reward.with_accepted(lambda a, b=0: a + b, b=5, c=7)(1) == 6


def test_visible_pairs_raises_on_long_rows(spark):
    made = lambda last: spark.createDataFrame([(1, p, True, "text", None, None) for p in (0, last)], "row_id long, pos long, valid boolean, kind string, step long, block long")
    assert g.visible_pairs(made(4095)).count() == 4
    with pytest.raises(PySparkException, match="more than 4096 tokens"):
        g.visible_pairs(made(4096)).collect()

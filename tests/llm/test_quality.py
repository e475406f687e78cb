import zlib

import numpy as np
import pyarrow as pa

from sluice.llm import quality_fm as q


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = {r.doc_id: r.score for r in q.score_quality(docs, q.learn_quality(docs, labels)).collect()}
    assert len(scored) == docs.count() and all(0 <= s <= 1 for s in scored.values())
    held = [(scored[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = (np.array([s for s, y in held if y == k]) for k in (1, 0))
    auc = np.mean([(good > b).mean() for b in bad])
    right = np.mean([(s >= 0.3) == y for s, y in held])
    print("AUC", auc, "accuracy", right, "good kept", (good >= 0.3).mean(), "bad dropped", (bad < 0.3).mean())
    assert auc > 0.9 and right > 0.9


def test_sum_of_squares_identity():
    m = q.FactorisationMachine()
    p, v, rows = q.features(pa.array(["a b c c", None, "X! y"]))
    rng = np.random.default_rng(1)
    m.linear[:] = rng.standard_normal(q.DIMS)
    m.bias = 0.3
    for i, s in enumerate(m.scores(p, v, rows)):
        a, x = p[rows[i] : rows[i + 1]], v[rows[i] : rows[i + 1]].astype(float)
        y = 0.3 + (m.linear[a] * x).sum()
        for j in range(len(a)):
            for k in range(j):
                y += (m.factors[a[j]].astype(float) @ m.factors[a[k]]) * x[j] * x[k]
        assert abs(1 / (1 + np.exp(-y)) - s) < 1e-5


def test_slices_give_the_same_features():
    texts = pa.array(["x", "Aa bb. C", "é \n 12", None, "", "Z" * 5000])
    whole, part = q.features(texts), q.features(texts.slice(1, 3))
    a, b = whole[2][1], whole[2][4]
    assert (whole[0][a:b] == part[0]).all() and (whole[1][a:b] == part[1]).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x"), (5, "y " * 100_000)], "doc_id long, text string").selectExpr("*", "1 AS label", "2 AS score")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.score_quality(docs, q.learn_quality(docs, none)).count() == 5
    some = spark.createDataFrame([(1, 1), (2, None), (None, 0), (5, 1), (5, 1)], "doc_id long, quality int")
    scores = [r.score for r in q.score_quality(docs, q.learn_quality(docs, some)).collect()]
    assert len(scores) == 5 and min(scores) > 0.5
    assert q.score_quality(docs.limit(0), q.learn_quality(docs, some)).count() == 0


def test_layout_of_the_table_does_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.limit(20))
    one = q.learn_quality(docs.coalesce(1).orderBy("n_chars"), labels.orderBy("quality"))
    other = q.learn_quality(docs.repartition(7), labels.repartition(3))
    assert one.bias == other.bias and (one.linear == other.linear).all() and (one.factors == other.factors).all()


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"words of {i} " * (i + 1)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert (q.learn_quality(docs, labels, sample_values=0).linear == 0).all()
    few, more = (q.learn_quality(docs, labels, sample_values=n) for n in (300, 600))
    assert 0 < (few.linear != 0).sum() < (more.linear != 0).sum()

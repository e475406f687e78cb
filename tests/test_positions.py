import pytest
from pyspark.sql import functions as F

from sluice.operators import batch
from sluice.operators.batch import positions


def check(found, rows):
    assert [r[0] for r in sorted(found, key=lambda r: r[1])] == sorted(rows)
    assert sorted(r[1] for r in found) == list(range(len(rows)))


@pytest.mark.parametrize("keys", [[2**k for k in range(60)] + list(range(-40, 0)), [f"key {k * 7919 % 1000:x}" for k in range(300)], [10**12], []])
def test_skewed_keys_and_texts(spark, keys, monkeypatch):
    monkeypatch.setattr(batch, "BUCKET_ROWS", 20)
    kind = "string" if keys and isinstance(keys[0], str) else "long"
    keys = sorted(set(keys), key=lambda k: hash(str(k)))
    df = spark.createDataFrame([(k, 1) for k in keys], f"k {kind}, x int").repartition(3)
    out = positions(df, "k")
    assert out.columns == ["k", "x", "row_id"]
    check([(r.k, r.row_id) for r in out.collect()], keys)


def test_ranges_are_even(spark, monkeypatch, tmp_path):
    # nearly all keys lie close together, and some far away
    monkeypatch.setattr(batch, "scratch_path", lambda spark, name: f"file://{tmp_path}/ranges")
    monkeypatch.setattr(batch, "BUCKET_ROWS", 1000)
    df = spark.range(20_000).select(F.when(F.col("id") % 1000 == 0, F.col("id") * 10**13).otherwise(F.col("id")).alias("k"))
    out = positions(df, "k")
    assert out.agg(F.count_distinct("row_id"), F.max("row_id")).first()[:] == (20_000, 19_999)
    sizes = [r["count"] for r in spark.read.parquet(f"file://{tmp_path}/ranges").groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 2.5 * sorted(sizes)[len(sizes) // 2]

"""What the fourth round's findings were about: pairs on a cluster, products that round at a half, answers in tags."""

import __spark_entry__
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from oracle import differences
from pyspark.sql import functions as F

from sluice.functions import answers
from sluice.llm import line_dedup
from sluice.llm.base import Scratch
from sluice.operators import cluster


def test_a_tile_in_another_order_on_either_side(spark, monkeypatch):
    # executors get shuffled rows in any order, so pairs of a tile with itself were lost and others made twice
    rows = spark.range(60).selectExpr("1 AS k", "id", "array(cast(cos(id) AS float), cast(sin(id) AS float)) AS v")
    want = sorted(map(tuple, cluster.similar_pairs(rows, "k", "id", "v", None, 0.9).collect()))
    tiles = cluster.tile_pairs
    monkeypatch.setattr(cluster, "tile_pairs", lambda *a: tiles(*a).withColumn("y", F.when(F.col("same"), F.reverse("y")).otherwise(F.col("y"))))
    assert sorted(map(tuple, cluster.similar_pairs(rows, "k", "id", "v", None, 0.9).collect())) == want


def test_products_at_a_half_round_as_in_sql(spark, tmp_path):
    # 0.35005 was 0.3501, in SQL it is 0.35
    vectors = [[1.0], *([0.35005 + i / 1000] for i in range(40))]
    pq.write_table(pa.table({"vec_id": range(len(vectors)), "label": pa.array([1] * len(vectors), pa.int32()), "embedding": pa.array(vectors, pa.list_(pa.float64()))}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    name = "op_l04_similar_pairs"
    assert differences(spark, str(tmp_path), name, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], con) is None


def test_numbers_in_a_tag_are_right_if_they_are_equal():
    # 7777797 is near 100 x 77779, which the SQL does not allow
    wrong = [("7777797", "77779"), ("7777477", "77774"), ("<answer>100000</answer>", "100001"), ("<answer>x = 7777797</answer>", "77779"), ("700", "7")]
    right = [("<answer>77779.0 </answer>", "77779"), ("1,000", "1000"), ("<answer>50%</answer>", "50%"), ("<answer>\\frac12</answer>", "1/2"), ("<answer>$5$</answer>", "5.0"), ("nan", "nan")]
    assert [answers.tagged_accuracy(*x) for x in wrong + right] == [0.0] * len(wrong) + [1.0] * len(right)
    assert answers.tagged_accuracy("", "5") == answers.tagged_accuracy(None, "5") == 0.0


def test_rounds_of_tiles_make_the_same_pairs(spark, monkeypatch):
    # all tiles were shuffled with their bitmaps at once
    monkeypatch.setattr(line_dedup, "TILE", 16)
    monkeypatch.setattr(line_dedup, "ROUND", 16)
    monkeypatch.setattr(line_dedup, "ROUND_SHARE", 0.25)
    words = [f"word{i * i}" for i in range(30)]
    lines = spark.createDataFrame([(i, " ".join([*words[: i % 30], f"x{i}", *words[i % 30 + 1 :]])) for i in range(120)], "h long, line string")
    rows = lines.selectExpr("1L AS band", "h", "h % 2 = 0 AS few", "true AS wide")
    roots = spark.createDataFrame([(h, 0) for h in range(20)], "node long, root long")
    own = line_dedup._bitmaps(lines).withColumn("mine", F.array(F.lit(1).cast("long")))
    kept, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: kept.append(df.columns) or keep(self, df))
    for few in (True, False):
        kept.clear()
        found = sorted(map(tuple, line_dedup._tile_pairs(rows, roots, own, few, Scratch(spark, "rounds")).collect()))
        assert found == sorted(map(tuple, line_dedup._tile_pairs(rows, roots, own, few).collect())) and len(set(found)) == len(found) > 1000
        assert kept.count(["u", "v"]) > 4


def test_texts_of_lines_in_no_pair_are_not_shuffled(spark):
    # each comparison of pairs shuffled all lines
    lines = spark.range(20000).selectExpr("xxhash64(id) AS h", "concat('some line of text ', id) AS line")
    pairs = spark.range(100).selectExpr("xxhash64(id) AS u", "xxhash64(id + 7) AS v")
    left = {r.h for r in line_dedup._ends(lines, pairs).select("h").collect()}
    assert {r.h for r in pairs.selectExpr("explode(array(u, v)) AS h").collect()} <= left and len(left) < 150
    assert line_dedup._ends(lines, pairs.limit(0)).count() == 0

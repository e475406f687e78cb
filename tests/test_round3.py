"""What the third round's findings were about: zeros, long rows, ragged batches and the time of graders."""

import re
import time

import __spark_entry__
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sluice.functions import answers, masks
from sluice.functions import text as t
from sluice.llm import line_dedup
from sluice.operators import advantage, balance


def test_grading_time():
    # a grade took 5 ms, as each of some 18 normalisations ran 270 patterns
    began = time.process_time()
    assert not any(answers.grade(str(2 * i + 7), str(i)) for i in range(1000, 1300))
    assert time.process_time() - began < 0.5


def test_units_go_as_before():
    for text in ("5 cm", "cm", "a . m 5 sq m", "3 m sqaure m", "x = 7 o", "12 apples", "π", "5 hours ago", "90 deg.", "p . m"):
        want = text
        for _ in range(2):
            for u in answers.UNITS:
                want = answers.re.sub(r"(^|\W)" + u + r"($|\W)", r"\1\2", want) or want
        assert answers._drop_units(text) == want


def test_place_of_a_box_in_a_long_text(spark):
    # the text was searched for its box once more for each token
    df = spark.range(1).select(F.concat(F.repeat(F.lit("word "), 60000), F.lit("\\boxed{1} end")).alias("x"))
    began = time.time()
    assert df.select(F.size(t.before_box(F.col("x"), F.split("x", " ", -1)))).first()[0] == 60001
    assert time.time() - began < 15


def test_fill_left_of_zero_values(spark):
    rows = spark.createDataFrame([(1, 0, 5.0, True), (1, 1, 0.0, True), (1, 2, 3.0, False), (1, 3, 7.0, True)], "r int, p int, v double, m boolean")
    out = rows.select("p", advantage.fill_left(F.col("v"), "r", "p", at=F.col("m")).alias("x")).orderBy("p").collect()
    assert [r.x for r in out] == [5.0, 0.0, 7.0, 7.0]


def test_materialised_rows_longer_than_the_padding(spark, tmp_path):
    n = 100
    pq.write_table(pa.table({"event_id": range(n), "user_id": [1] * n, "event_type": ["view"] * n, "value": [0.0] * n}), tmp_path / "events.parquet")
    row = __spark_entry__.queries()["op_b33_materialise"](spark, str(tmp_path)).first()
    assert list(row.input_ids) == [0] * n


def test_ragged_batches(spark):
    rows = spark.createDataFrame([(0, 0, 4), (0, 1, 9), (0, 2, 1), (1, 3, 0), (1, 4, 6), (2, 5, 0)], "b long, id long, n long")
    put = lambda k, **o: {r.id: r.part for r in balance.assign_parts(rows, "b", "id", "n", k=k, **o).collect()}
    assert put(3) == {0: 1, 1: 0, 2: 2, 3: 1, 4: 0, 5: 0}
    assert put(2, equal_size=True) == {0: 1, 1: 0, 2: 1, 3: 1, 4: 0, 5: 0}


def test_bands_are_shuffled_once(spark, tmp_path):
    # the grouping and the join each wrote all bands of all lines
    h = [F.xxhash64(F.col("id") % (50 * (i + 1)), F.lit(i)) for i in range(6)]
    spark.range(5000).select(F.xxhash64("id").alias("h"), F.array(*h).alias("sketch"), F.lit(None).cast("array<bigint>").alias("dense")).write.parquet(str(tmp_path / "s"))
    shared = line_dedup._shared_bands(spark.read.parquet(str(tmp_path / "s")))
    assert shared.count() > 5000
    shared.collect()
    assert "Reused" in shared._jdf.queryExecution().executedPlan().toString()


def test_runs_of_a_row_go_through_no_window(spark):
    # each token carried the runs of its whole row through windows and sorts
    rows = spark.createDataFrame([(1, i, True, "latent" if i % 3 else "text", i // 8, i // 4) for i in range(40)], "row_id long, pos long, valid boolean, kind string, step long, block long")
    out = masks.visible_ranges(rows, observations_see="question_and_latents")
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if re.search(r"Window .*collect_list.*, \[row_id#\d+L?\]$", x)]
    assert out.count() == 40

"""Versions of keyed state, and resume from listings with lost runs and cut files."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from sluice.operators.state import StateStore, length_increments, length_means, length_state
from sluice.session import shared_dir
from sluice.sources.listing import ResumableFolder, list_files


@pytest.fixture
def path(spark):
    return f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"


def local(path):
    return path.removeprefix("file://")


def some(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(r.choice([1, 2, 3, None]) if r.random() < 0.7 else r.randrange(50), k % 6, float(r.randrange(1, 100)), r.random() < 0.6) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, step long, len double, ok boolean")


def by_hand(rows, last):
    out = {}
    for key, step, length, ok in rows:
        if step <= last:
            least, total, cnt, right = out.get(key, (None, None, 0, False))
            if ok:
                least, total = min(length, least or length), (total or 0) + length
            out[key] = (least, total, cnt + ok, right or ok)
    return out


def state_of(df):
    return {r.id: (r.min_len, r.total_len, r.cnt, r.correct) for r in df.collect()}


@pytest.mark.parametrize("compact", [1, 2, 4, 100])
def test_steps_one_by_one_equal_one_batch_at_every_version(spark, path, compact):
    rows, df = some(spark)
    store = length_state(spark, path, "id", compact)
    for step in range(6):
        store.put(step, length_increments(df.filter(F.col("step") == step), "id", "len", F.col("ok")))
    assert store.steps() == list(range(6))
    for step in range(6):
        assert state_of(store.read(step)) == by_hand(rows, step)
    means = {r.id: r.mean_len for r in length_means(store.read()).collect()}
    assert means == {k: v[1] / v[2] if v[2] else None for k, v in by_hand(rows, 5).items()}
    store.forget_before(4)
    assert state_of(store.read(5)) == by_hand(rows, 5)


def test_a_step_again_changes_nothing_and_an_earlier_one_forgets_later_ones(spark, path):
    rows, df = some(spark)
    step = lambda k: length_increments(df.filter(F.col("step") == k), "id", "len", F.col("ok"))
    store = length_state(spark, path, "id", 2)
    for k in (0, 1, 2, 2, 2, 3):
        store.put(k, step(k))
    assert state_of(store.read()) == by_hand(rows, 3)
    store.put(1, step(1))
    assert store.steps() == [0, 1] and state_of(store.read()) == by_hand(rows, 1)


def test_an_unfinished_step_does_not_count(spark, path):
    rows, df = some(spark)
    store = StateStore(spark, path, "id", {"cnt": "sum"}, 3)
    one = df.select("id", F.lit(1).cast("long").alias("cnt"))
    store.put(0, one)
    store.put(1, one)
    os.remove(local(path) + "/step-000000000001/_SUCCESS")
    with pytest.raises(ValueError, match="step 1 was not finished"):
        store.put(2, one)
    assert store.steps() == [0] and store.read().agg(F.sum("cnt")).first()[0] == len(rows)
    store.put(1, one)
    assert store.read().agg(F.sum("cnt")).first()[0] == 2 * len(rows)


def test_empty_steps_and_wrong_merges(spark, path):
    store = StateStore(spark, path, "id", {"cnt": "sum"})
    with pytest.raises(ValueError):
        store.read()
    store.put(0, spark.createDataFrame([], "id string, cnt long, other int"))
    assert store.read().columns == ["id", "cnt"] and store.read().count() == 0
    with pytest.raises(ValueError):
        StateStore(spark, path, "id", {"cnt": "mean"})
    with pytest.raises(ValueError):
        store.put(-1, store.read())


SCHEMA = "id long, text string"


def ids(df):
    return sorted(r.id for r in df.collect())


def test_resume_writes_what_is_in_no_complete_file(spark, path):
    rows = spark.range(1000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    folder = ResumableFolder(spark, path, "id", width=100)
    assert folder.read(SCHEMA).count() == 0 and folder.done_files().count() == 0
    folder.write(rows.filter("id < 500"))
    assert ids(folder.read(SCHEMA)) == list(range(500))
    marks = {m.path: m for m in folder.marks().collect()}
    cut, gone = sorted(marks)[0], sorted(marks)[-1]
    file = f"{local(path)}/data/{cut}"
    with open(file, "r+b") as f:  # a file that was cut, one that was lost, and one that no run has marked
        f.truncate(os.path.getsize(file) // 2)
    os.remove(f"{local(path)}/data/{gone}")
    with open(f"{os.path.dirname(file)}/part-half.parquet", "wb") as f:
        f.write(b"PAR1")
    left = folder.read(SCHEMA).count()
    assert left == 500 - marks[cut].n - marks[gone].n
    folder.resume(rows, SCHEMA)
    assert ids(folder.read(SCHEMA)) == list(range(1000))
    assert folder.read(SCHEMA).filter("ord = 1").count() == left
    folder.resume(rows, SCHEMA)
    assert ids(folder.read(SCHEMA)) == list(range(1000))


def test_a_range_of_ids_lists_only_its_blocks(spark, path):
    folder = ResumableFolder(spark, path, "id", width=100)
    folder.write(spark.range(1000).select("id", F.lit("x").alias("text")))
    assert [p.rsplit("=", 1)[1] for p in folder._paths(250, 420)] == ["2", "3", "4"]
    assert ids(folder.read(SCHEMA, 250, 420)) == list(range(250, 421))
    assert folder.done_files(250, 420).agg(F.min("least") >= 200, F.max("most") < 500).first() == (True, True)
    assert {r.length > 0 for r in list_files(spark, [f"{path}/data"]).collect()} == {True}
    with pytest.raises(Exception, match="null or negative"):
        folder.write(spark.createDataFrame([(None, "x")], SCHEMA))
    assert folder.read(SCHEMA).count() == 1000


def test_a_run_that_was_lost_before_its_marks_is_written_again(spark, path):
    folder = ResumableFolder(spark, path, "id", width=10)
    rows = spark.range(30).select("id", F.lit("x").alias("text"))
    folder.write(rows)
    marks = f"{local(path)}/marks"
    os.remove(f"{marks}/{os.listdir(marks)[0]}/_SUCCESS")
    assert folder.read(SCHEMA).count() == 0
    folder.resume(rows, SCHEMA)
    assert ids(folder.read(SCHEMA)) == list(range(30))

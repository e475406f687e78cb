import random
import time

import pytest
from pyspark.errors import PySparkException

from sluice.streaming import latents


@pytest.fixture
def state_store(spark):
    for k, v in latents.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in latents.STATE_STORE:
        spark.conf.unset(k)


def made(seed, n=120):
    """Events of few requests: steps repeat with other times and vectors, some have no time or no vector."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        ids = [f"{rng.randint(0, 2)}_{rng.randint(5, 7)}" for _ in range(rng.randint(1, 3))]
        vectors = [rng.choice([None, [], [rng.random(), float(rng.randint(0, 3))]]) for _ in ids]
        out.append((rng.choice([None, round(rng.random(), 1)]), 1, rng.randint(0, 1), rng.randint(0, 12), ids, vectors))
    return out


def rows_of(df):
    return sorted((r.parent, r["sample"], [list(v) for v in r.vectors]) for r in df.collect())


def run_once(spark, path, rank=None):
    events = spark.readStream.schema(latents.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    run = latents.record_trajectories(events, rank).writeStream.format("parquet").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start(f"{path}/out")
    run.awaitTermination()


def test_stream_is_batch_in_any_order(spark, tmp_path, state_store):
    events = made(3)
    whole = spark.createDataFrame(events, latents.EVENT)
    # shuffled batches, the last ones repeat events that came before; the query is ended and started between them
    rng = random.Random(9)
    rng.shuffle(events)
    for part in (events[:40], events[40:90], events[90:] + events[:30]):
        spark.createDataFrame(part, latents.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_once(spark, tmp_path, rank=1)
    stored = rows_of(latents.stored_trajectories(spark, f"{tmp_path}/c"))
    assert stored == rows_of(latents.trajectories(whole, rank=1)) and len(stored) > 5
    # each step was told once
    told = spark.read.schema(latents._RECORD).parquet(f"{tmp_path}/out")
    assert told.count() == told.select("parent", "sample", "step").distinct().count() == sum(len(v) for _, _, v in stored)
    # the state after an earlier batch is there too
    first = rows_of(latents.stored_trajectories(spark, f"{tmp_path}/c", batch=0))
    assert sum(len(v) for _, _, v in first) < sum(len(v) for _, _, v in stored)


def test_batch_against_plain_python(spark):
    events = made(5)
    best = {}
    for ts, _, rank, step, ids, vectors in events:
        for rid, v in zip(ids, vectors, strict=True):
            if rank == 0 and v:
                sample, parent = rid.split("_")
                key = (parent, int(sample), step)
                x = (ts is not None, ts or 0.0, list(v))
                best[key] = min(best.get(key, x), x)
    want = {}
    for (parent, sample, _), x in sorted(best.items()):
        want.setdefault((parent, sample), []).append(x[2])
    got = latents.trajectories(spark.createDataFrame(events, latents.EVENT), rank=0).collect()
    assert {(r.parent, r["sample"]): [[round(x, 5) for x in v] for v in r.vectors] for r in got} == {k: [[round(x, 5) for x in v] for v in vs] for k, vs in want.items()}


def test_entries_go_after_their_time(spark, tmp_path, state_store):
    one = lambda step: spark.createDataFrame([(0.0, 1, 0, step, ["1_2"], [[1.0]])], latents.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    one(1)
    events = spark.readStream.schema(latents.EVENT).parquet(f"{tmp_path}/in")
    run = latents.record_trajectories(events, ttl=15000).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="100 milliseconds").start()
    def left():
        try:
            return [(r.parent, r["sample"], len(r.vectors)) for r in latents.stored_trajectories(spark, f"{tmp_path}/c").collect()]
        except PySparkException:  # no batch yet
            return None

    def becomes(want):
        end = time.time() + 90
        while (got := left()) != want and time.time() < end:
            time.sleep(0.5)
        return got == want

    try:
        # with times, Spark runs batches all the time; one of them drops what is too old
        assert becomes([("2", 1, 1)])
        assert becomes([])
        one(2)
        assert becomes([("2", 1, 1)])
    finally:
        run.stop()

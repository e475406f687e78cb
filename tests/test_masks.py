import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from sluice.functions import arrays as g
from sluice.functions import masks

SCHEMA = "row_id long, pos long, valid boolean, kind string, step long, block long"
KINDS = ("text", "question", "question_image", "question_edge", "image", "latent", "observation")


def made(seed, rows, most, gaps=False):
    """Random tokens: kinds anywhere, steps with and without latents, invalid tokens, nulls in steps and blocks."""
    rng, out = random.Random(seed), []
    for r in range(rows):
        places = range(rng.randint(1, most))
        if gaps:
            places = sorted(rng.sample(range(3 * most), len(places)))
        for i, p in enumerate(places):
            out.append((r, p, rng.random() < 0.8, rng.choice(KINDS), rng.choice([None, i // 6, i // 6]), rng.choice([None, i // 3, i // 3, i // 3])))
    return out


def options():
    for keep, hide, question, see_all in itertools.product((False, True), repeat=4):
        yield {"keep_images": keep, "hide_latents": hide, "hide_question_image": question, "latents_see_all": see_all}
    for see, skip, hide in itertools.product(masks.SEEN, (False, True), (False, True)):
        yield {"observations_see": see, "observations_skip_question_image": skip, "hide_latents": hide}


@pytest.mark.parametrize("gaps", [False, True])
def test_ranges_are_the_pairs(spark, gaps):
    rows = spark.createDataFrame(made(1 + gaps, 8, 24, gaps), SCHEMA).cache()
    for o in list(options())[gaps :: 3 + 4 * gaps]:
        pairs = g.visible_pairs(rows, **o).filter("allowed").select("row_id", "q", "k")
        ranges = masks.visible_ranges(rows, **o)
        got = masks.expanded(ranges)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())), o
        for r in ranges.collect():
            assert all(a.start < a.end for a in r.ranges) and all(a.end < b.start for a, b in itertools.pairwise(r.ranges)), o
    for hide in (False, True):
        pairs = g.visible_pairs_without_images(rows, hide_latents=hide).filter("allowed").select("row_id", "q", "k")
        assert sorted(map(tuple, masks.expanded(masks.visible_ranges_without_images(rows, hide_latents=hide)).collect())) == sorted(map(tuple, pairs.collect()))
    rows.unpersist()


def test_one_exchange_and_no_join(spark):
    rows = spark.createDataFrame(made(3, 2, 9), SCHEMA)
    plan = masks.visible_ranges(rows, hide_question_image=True, observations_see="question_and_latents")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_long_rows(spark):
    # two rows of 100,000 tokens: a question, then steps of a thousand tokens with latents, images and observations
    p, at = F.col("pos"), F.col("pos") % 1000
    kind = F.when(p < 50, "question").when(at < 20, "image").when(at < 40, "latent").when((at >= 500) & (at < 530), "observation").otherwise("text")
    rows = spark.range(200_000).select((F.col("id") % 2).alias("row_id"), F.expr("id div 2").alias("pos")).withColumn("valid", p % 9973 != 9972)
    rows = rows.withColumn("kind", kind).withColumn("step", F.when(p >= 50, F.expr("pos div 1000"))).withColumn("block", F.expr("pos div 1000"))
    began = time.time()
    found = masks.visible_ranges(rows).withColumn("n", F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]))
    got = {(r.row_id, r.q): (r.n, len(r.ranges)) for r in found.filter("q IN (0, 49, 1019, 2025, 50510, 99999)").select("row_id", "q", "n", "ranges").collect()}
    # a text sees all valid tokens before it but the images of steps, which all have latents
    assert got[0, 0] == (1, 1) and got[1, 49] == (50, 1)
    images = lambda q: sum(1 for k in range(50, q + 1) if k % 1000 < 20)
    invalid = lambda q: sum(1 for k in range(q + 1) if k % 9973 == 9972)
    assert got[1, 99999][0] == 100_000 - images(99999) - invalid(99999)
    assert got[0, 2025][0] == 2026 - images(2025) + 20  # a latent also sees its step's images
    assert found.agg(F.count("*")).first()[0] == 200_000
    assert time.time() - began < 300

"""Queries of what configuration decides: batch construction and its checks, estimators, controllers, loaded functions, resume."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import functions as F

from sluice.catalog import query
from sluice.functions import numeric as n
from sluice.functions.answers import udf
from sluice.operators import advantage as a
from sluice.operators import batch as b
from sluice.operators import ingest
from sluice.operators import reward as r
from sluice.plans.data_queries import _chats
from sluice.plans.numeric_queries import _LONG, _STATS, _arrays, _reinforce_sql
from sluice.session import shared_dir, table

# batches


@query("op_b01_from_dict", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id, n_nationkey AS key, n_name AS name, [n_regionkey, n_nationkey] AS ids FROM nation")
def b01(spark, d):
    # the driver's lists of a table of fixed size
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()
    return b.from_columns(spark, {"key": [x.n_nationkey for x in rows], "name": [x.n_name for x in rows], "ids": [[x.n_regionkey, x.n_nationkey] for x in rows]})


@query("op_b02_from_parts", "SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS row_id, [CAST(r_regionkey AS DOUBLE), 0.5e0] AS dense, r_name AS object, 'a' AS wrong FROM region")
def b02(spark, d):
    # arrays and objects of one length; columns of two lengths are refused
    rows = table(spark, d, "region").orderBy("r_regionkey").collect()
    dense, objects = [[float(x.r_regionkey), 0.5] for x in rows], [x.r_name for x in rows]
    try:
        b.from_columns(spark, {"dense": dense, "object": objects[1:]})
        wrong = "b"
    except ValueError:
        wrong = "a"
    return b.from_columns(spark, {"dense": dense, "object": objects}).withColumn("wrong", F.lit(wrong))


@query("op_b11_merge_meta", "SELECT event_type AS key, count(*) AS value FROM events GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM events")
def b11(spark, d):
    # counts of the kinds in two parts of meta data, which share the total
    counts = {x.event_type: x["count"] for x in table(spark, d, "events").groupBy("event_type").count().collect()}
    total = {"total": sum(counts.values())}
    merged = b.merge_meta({k: v for k, v in counts.items() if k < "p"} | total, {k: v for k, v in counts.items() if k >= "p"} | total)
    try:
        b.merge_meta(total, {"total": -1})
    except ValueError:
        return spark.createDataFrame(sorted(merged.items()), "key string, value long")
    raise AssertionError("meta data that differ were merged")


@query("op_b54_group_sizes", """WITH p AS (SELECT p_partkey, 1 + p_partkey % 3 AS rollouts, 1 + p_partkey % 9 AS mini, 1 + p_partkey % 5 AS micro, CASE WHEN p_partkey % 2 = 0 THEN 1 + p_partkey % 7 END AS critic FROM part)
 SELECT p_partkey, CASE WHEN 64 % mini <> 0 THEN 'batch' WHEN 64 * rollouts % micro <> 0 THEN 'micro' WHEN 64 % coalesce(critic, 1) <> 0 THEN 'batch' WHEN rollouts < 2 AND p_partkey % 4 < 2 THEN 'group' ELSE 'ok' END AS verdict FROM p""")
def b54(spark, d):
    def verdict(key):
        rollouts, mini, micro = 1 + key % 3, 1 + key % 9, 1 + key % 5
        try:
            b.check_group_sizes(64, rollouts, mini, ("grpo", "rloo", "gae", "remax")[key % 4], micro, 1 + key % 7 if key % 2 == 0 else None)
        except ValueError as e:
            return "group" if "rollouts of" in str(e) else "batch" if "mini" in str(e) else "micro"
        return "ok"

    return table(spark, d, "part").select("p_partkey", udf(verdict, "string")(F.col("p_partkey").cast("long")).alias("verdict"))


# estimators and controllers

_GAE = """SELECT event_id, round((x - mu) / sqrt(var + 1e-8), 4) AS adv FROM a, q"""
_PLAIN = """SELECT event_id, round({} * m, 4) AS adv FROM (SELECT event_id, m, u, s, sum(s) OVER w / count(s) OVER w AS mu, stddev_samp(CASE WHEN pos = 0 THEN s END) OVER w AS sd, count(CASE WHEN pos = 0 THEN 1 END) OVER w AS k,
  sum(CASE WHEN pos = 0 THEN s END) OVER w AS total FROM (SELECT event_id, m, pos, user_id % 5 AS u, sum(r) OVER (PARTITION BY user_id) AS s FROM t) WINDOW w AS (PARTITION BY u))"""
_ESTIMATORS = (("gae", "greedy"), ("grpo", "greedy"), ("grpo", "latent"), ("reinforce_plus_plus", "greedy"), ("remax", "greedy"), ("rloo", "greedy"))


def _estimator_sql() -> str:
    gae = _LONG + """, dl AS (SELECT *, r + 0.9e0 * coalesce(lead(v) OVER (PARTITION BY user_id ORDER BY pos), 0) - v AS delta FROM t),
      a AS (SELECT x.event_id, any_value(x.m) AS m, sum(pow(0.855e0, y.pos - x.pos) * y.delta) AS x FROM dl x JOIN dl y ON x.user_id = y.user_id AND y.pos >= x.pos GROUP BY 1)""" + _STATS + " " + _GAE
    reinforce = f"SELECT event_id, round(adv * CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END, 4) AS adv FROM ({_reinforce_sql()}) JOIN events USING (event_id)"
    grpo = _LONG + " " + _PLAIN.format("(s - total / k) / (sd + 1e-6)")
    texts = {"gae": gae, "reinforce_plus_plus": reinforce, "grpo": grpo, "rloo": _LONG + " " + _PLAIN.format("(s - (total - s) / (k - 1))"), "remax": _LONG + " " + _PLAIN.format("(s - u)")}
    return " UNION ALL ".join(f"SELECT '{name}' AS estimator, '{strategy}' AS strategy, event_id, adv FROM ({texts[name]})" for name, strategy in _ESTIMATORS)


@query("op_w09_dispatch", _estimator_sql())
def w09(spark, d):
    # a user's events are a row; users are in five groups, whose numbers are the baselines
    rows = _arrays(spark, d).withColumn("uid", F.col("user_id") % 5).withColumn("reward_baseline", (F.col("user_id") % 5).cast("double"))

    def one(name, strategy):
        out = a.compute_advantage(rows, name, strategy, 0.9, 0.95).select(F.explode(F.arrays_zip("event_id", "advantages")).alias("x")).select("x.*")
        return out.select(F.lit(name).alias("estimator"), F.lit(strategy).alias("strategy"), "event_id", F.round("advantages", 4).alias("adv"))

    return reduce(lambda x, y: x.unionByName(y), (one(*e) for e in _ESTIMATORS))


_CURRENT = "SELECT month(o_orderdate) AS step, count(*) AS n, avg(o_totalprice) / 1e6 AS kl FROM orders GROUP BY 1"


@query("op_n05_controllers", f"SELECT 'fixed' AS kind, step, 0.01e0 AS beta FROM ({_CURRENT}) UNION ALL SELECT 'adaptive', step, round(0.01e0 * product(1 + least(greatest(kl / 0.1e0 - 1, -0.2e0), 0.2e0) * n / 1e6) OVER (ORDER BY step), 9) FROM ({_CURRENT})")
def n05(spark, d):
    # at most twelve steps, whose measured divergence updates both controllers
    steps = table(spark, d, "orders").groupBy(F.month("o_orderdate").alias("step")).agg(F.count(F.lit(1)).alias("n"), (F.avg("o_totalprice") / 1e6).alias("kl")).orderBy("step").collect()
    rows = []
    for kind in ("fixed", "adaptive"):
        controller = n.KLController(kind, 0.01, 0.1, 1e6)
        for s in steps:
            controller.update(s.kl, s.n)
            rows.append((kind, s.step, round(controller.coefficient, 9)))
    return spark.createDataFrame(rows, "kind string, step long, beta double")


# functions from files

_FILE = """
def main(pred, gt, scale=1.0):
    return scale * float(pred == gt)


def judge(question, pred, gt, word="yes"):
    return word if pred == gt else "no"
"""


def _loaded(name: str, **kwargs):
    """A function of a file that the driver has; executors get the function itself."""
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, "rewards.py")
    with open(path, "w") as f:
        f.write(_FILE)
    return r.load_function(f"{path}:{name}", **kwargs)


def _pairs(spark, d):
    wanted = F.when(F.col("event_type") == "purchase", F.col("user_id")).otherwise(-1)
    return table(spark, d, "events").select("event_id", F.lit("q").alias("question"), F.col("user_id").cast("string").alias("pred"), wanted.cast("string").alias("gt"))


@query("op_e01_loaded_reward", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 2.5e0 ELSE 0e0 END AS reward FROM events")
def e01(spark, d):
    score = _loaded("main", scale=2.5)
    return _pairs(spark, d).select("event_id", udf(lambda p, g: score(p, g), "double")(F.col("pred"), F.col("gt")).alias("reward"))


@query("op_e03_loaded_judge", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'right' ELSE 'no' END AS reply FROM events")
def e03(spark, d):
    judge = _loaded("judge", word="right")
    return r.judge_rows(_pairs(spark, d), lambda question, pred, gt: judge(question, pred, gt)).select("event_id", "reply")


@query("op_e04_accepted_arguments", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 3e0 ELSE 0e0 END AS reward FROM events")
def e04(spark, d):
    # the function takes scale, and no argument named length
    score = r.with_accepted(_loaded("main"), scale=3.0, length=9)
    return _pairs(spark, d).select("event_id", udf(lambda p, g: score(p, g), "double")(F.col("pred"), F.col("gt")).alias("reward"))


@query("op_e05_tasks", "SELECT conv_id, turns FROM (SELECT conv_id, count(*) AS turns, count(CASE WHEN role = 'assistant' THEN 1 END) AS answers FROM conversations GROUP BY 1) WHERE answers > 0 AND conv_id % 5 <> 0 AND conv_id % 3 <> 0")
def e05(spark, d):
    return ingest.preprocess("mm-reasoning", _chats(spark, d)).select("conv_id", F.size("data").cast("long").alias("turns"))


# resume


@query("op_x10_resume_position", "SELECT 20 AS step, event_id FROM events WHERE event_id >= 20 * 32 UNION ALL SELECT 7, event_id FROM events")
def x10(spark, d):
    # a loader of batches of 32 events goes on after step 20; step 7 has kept no position, so all is read again
    path = f"{shared_dir(spark)}/loader-{uuid.uuid4().hex}"
    ingest.save_position(spark, path, 20, 20 * 32)
    events = table(spark, d, "events").select("event_id")
    read = lambda step: ingest.resumed(spark, events, "event_id", path, step).select(F.lit(step).alias("step"), "event_id")
    return read(20).unionByName(read(7))

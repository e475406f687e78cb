"""Flagship plan: difficulty selection and group-relative advantage in one pass over rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.catalog import query
from sluice.session import table

ORACLE = """
WITH roll AS (
  SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN 1e0 ELSE 0e0 END AS correct,
         CAST(trunc(value) AS INTEGER) AS len FROM events),
g AS (
  SELECT *, avg(correct) OVER (PARTITION BY user_id) AS acc,
         coalesce(min(CASE WHEN correct = 1e0 THEN len END) OVER (PARTITION BY user_id), 0) AS ref FROM roll),
s AS (
  SELECT *, 0.9e0 * correct + 0.1e0 - CASE WHEN len > ref AND ref <> 0 THEN 0.001e0 * (len - ref) ELSE 0e0 END AS score
  FROM g WHERE acc > 0 AND acc <= 0.2)
SELECT event_id, user_id, round(acc, 6) AS acc, round(score, 6) AS score,
       round((score - avg(score) OVER (PARTITION BY user_id)) / (stddev_samp(score) OVER (PARTITION BY user_id) + 1e-6), 6) AS adv
FROM s
"""


@query("flagship", ORACLE)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep users with 0 < success rate <= 0.2, score each event, normalise scores inside the user's group.

    All windows share one hash exchange on user_id.
    """
    group = Window.partitionBy("user_id")
    rollouts = table(spark, sf_dir, "events").select(
        "event_id", "user_id",
        F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("correct"),
        F.col("value").cast("int").alias("len"),
    )
    judged = rollouts.select(
        "*", F.avg("correct").over(group).alias("acc"),
        F.coalesce(F.min(F.when(F.col("correct") == 1.0, F.col("len"))).over(group), F.lit(0)).alias("ref"),
    ).filter("acc > 0 AND acc <= 0.2")
    penalty = F.when((F.col("len") > F.col("ref")) & (F.col("ref") != 0), 0.001 * (F.col("len") - F.col("ref"))).otherwise(0.0)
    scored = judged.withColumn("score", 0.9 * F.col("correct") + 0.1 - penalty)
    adv = (F.col("score") - F.avg("score").over(group)) / (F.stddev_samp("score").over(group) + 1e-6)
    return scored.select("event_id", "user_id", F.round("acc", 6).alias("acc"), F.round("score", 6).alias("score"), F.round(adv, 6).alias("adv"))

"""Metrics over rollouts, batches and training steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sections whose time is divided by response tokens; all others by all tokens.
RESPONSE_SECTIONS = ("gen", "reward")


def spread(df: DataFrame, column: str, prefix: str) -> list[Column]:
    """Mean, max and min of a column as aggregates named after a prefix."""
    return [f(column).alias(f"{prefix}_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]


def data_metrics(rows: DataFrame, tokens: DataFrame, max_length: int, critic: bool = False) -> DataFrame:
    """One row of batch metrics.

    ``rows`` has score, reward, response_length; ``tokens`` has the valid positions' adv, ret and, for a critic, value.
    """
    clipped = F.avg((F.col("response_length") == max_length).cast("double")).alias("length_clip_ratio")
    per_row = rows.agg(*spread(rows, "score", "score"), *spread(rows, "reward", "reward"), *spread(rows, "response_length", "length"), clipped)
    aggregates = [*spread(tokens, "adv", "adv"), *spread(tokens, "ret", "ret")]
    if critic:
        explained = 1 - F.var_samp(F.col("ret") - F.col("value")) / (F.var_samp("ret") + 1e-5)
        aggregates += [*spread(tokens, "value", "value"), explained.alias("explained_var")]
    # both sides are one row
    return per_row.withColumn("_k", F.lit(1)).join(tokens.agg(*aggregates).withColumn("_k", F.lit(1)), "_k").drop("_k")


def ms_per_token(section: Column, seconds: Column, response_tokens: Column, all_tokens: Column) -> Column:
    """Milliseconds per token of a section."""
    return seconds * 1000 / F.when(section.isin(*RESPONSE_SECTIONS), response_tokens).otherwise(all_tokens)


def throughput(tokens: Column, seconds: Column, devices: int) -> Column:
    """Tokens a second and device."""
    return tokens / (seconds * devices)


def reduce_metrics(long: DataFrame) -> DataFrame:
    """Mean of each name."""
    return long.groupBy("name").agg(F.avg("value").alias("value"))


def success_rates(rollouts: DataFrame, key: str, correct: str) -> DataFrame:
    """acc of each key."""
    return rollouts.groupBy(key).agg(F.avg(F.col(correct).cast("double")).alias("acc"))


def select_by_difficulty(rollouts: DataFrame, key: str, correct: str, threshold: float) -> DataFrame:
    """Keys that are solved at times, but in at most ``threshold`` of tries."""
    return success_rates(rollouts, key, correct).filter((F.col("acc") > 0) & (F.col("acc") <= threshold))


def length_stats(correct: DataFrame, key: str, length: str) -> DataFrame:
    """min_len, mean_len and cnt of correct rows of each key."""
    return correct.groupBy(key).agg(F.min(length).alias("min_len"), F.avg(length).alias("mean_len"), F.count(F.lit(1)).alias("cnt"))


def look_up(keys: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Stats of each key, with infinity and 0 for an unseen one."""
    found = keys.join(stats, key, "left")
    return found.select(*keys.columns, F.coalesce("min_len", F.lit(float("inf"))).alias("min_len"), F.coalesce("mean_len", F.lit(0.0)).alias("mean_len"))


def rolling_log(steps: DataFrame, every: int, value: str, positive_only: bool = False) -> DataFrame:
    """Mean of a value between log points, rounded to six places; ``positive_only`` leaves out sums of 0."""
    out = steps.groupBy(F.expr(f"step div {every}").alias("point")).agg(F.round(F.avg(value), 6).alias(value), F.sum(value).alias("_s"))
    return (out.filter("_s > 0") if positive_only else out).drop("_s")


def emphasised_accuracy(tokens: DataFrame, row: str, hit: str, mark: str) -> DataFrame:
    """Mean over rows of the mean of hits at marked positions; rows without any do not count; 0 if there are none."""
    per_row = tokens.filter(F.col(mark)).groupBy(row).agg(F.avg(F.col(hit).cast("double")).alias("acc"))
    return per_row.agg(F.coalesce(F.avg("acc"), F.lit(0.0)).alias("accuracy"))


def weighted_loss(ce: Column, weight: Column, valid: Column) -> Column:
    """Weighted mean of valid losses; the weights sum to at least 1."""
    w = F.when(valid, weight).otherwise(0.0)
    return F.sum(ce * w) / F.greatest(F.lit(1.0), F.sum(w))


def imbalance(rows: DataFrame, length: str, part: str) -> DataFrame:
    """min, max and difference of the parts' sums of lengths, and their mean."""
    sums = rows.groupBy(part).agg(F.sum(length).alias("s"))
    return sums.agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("diff"), F.avg("s").alias("mean"))


def retained(checkpoints: DataFrame, current: int, limit: int) -> DataFrame:
    """``keep`` of each step below the current one: the newest ``limit - 1``, or all for a limit of 0 or less."""
    below = checkpoints.filter(F.col("step") < current)
    if limit <= 0:
        return below.withColumn("keep", F.lit(True))
    rank = F.row_number().over(Window.orderBy(F.desc("step")))  # a listing of checkpoints is short
    return below.withColumn("keep", rank <= limit - 1)


def wide_samples(samples: DataFrame, step: str, index: str, columns: list[str], n: int) -> DataFrame:
    """One row for each step with column_i for the first n samples."""
    picks = [F.max(F.when(F.col(index) == i, F.col(c))).alias(f"{c}_{i}") for i in range(n) for c in columns]
    return samples.groupBy(step).agg(*picks)

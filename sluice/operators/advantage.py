"""Advantage estimators over rollouts.

Token data comes in two forms: arrays per row, or long form with ``row_id`` and ``pos``. Group statistics are
windows over the group key, with one exchange; recurrences from the end of a row run over Arrow batches,
vectorised over the rows of a batch, since no window frame expresses them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-6
MEAN_EPS = 1e-8
#: Scale of step advantages.
STEP_SCALE = 1.78
#: Positions from a delimiter on whose advantage is zero.
DELIMITER_WIDTH = 5


def masked_mean(value: Column, mask: Column) -> Column:
    """Aggregate: ``sum(v m) / (sum(m) + 1e-8)``."""
    return F.sum(value * mask) / (F.sum(mask) + MEAN_EPS)


def masked_stats(long: DataFrame, value: str, mask: str) -> tuple[float, float]:
    """(mean, variance) of masked values: one aggregate, with Bessel's correction if more than one is masked in."""
    n, s, ss = long.agg(F.sum(mask), F.sum(F.col(value) * F.col(mask)), F.sum(F.col(value) * F.col(value) * F.col(mask))).first()
    n, s, ss = float(n or 0), float(s or 0), float(ss or 0)
    mean = s / (n + MEAN_EPS)
    var = max(0.0, ss - 2 * mean * s + mean * mean * n) / (n + MEAN_EPS)
    return mean, var * n / (n - 1) if n > 1 else var


def whiten(value: Column, mean: float, var: float) -> Column:
    """``(v - mean) / sqrt(var + 1e-8)``."""
    return (value - F.lit(mean)) / F.lit((var + MEAN_EPS) ** 0.5)


def _matrix(xs: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(xs), width))
    for i, x in enumerate(xs):
        out[i, : len(x)] = x
    return out


def reverse_scan(df: DataFrame, inputs: list[str], out: str, step: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Add an array column by a scan from the end of each row.

    ``step(carry, next_values, *values)`` gives (result, new carry) for one position of all rows of a batch.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf[inputs[0]].map(len).to_numpy()
            width = int(sizes.max()) if len(sizes) else 0
            cols = [_matrix(pdf[c], width) for c in inputs]
            res, carry, after = np.zeros((len(pdf), width)), np.zeros(len(pdf)), [np.zeros(len(pdf)) for _ in cols]
            for t in range(width - 1, -1, -1):
                live = t < sizes
                now = [c[:, t] for c in cols]
                value, new = step(carry, after, *now)
                res[:, t] = np.where(live, value, 0)
                carry = np.where(live, new, carry)
                after = [np.where(live, x, y) for x, y in zip(now, after, strict=True)]
            yield pdf.assign(**{out: [r[:n] for r, n in zip(res, sizes, strict=True)]})

    return df.mapInPandas(run, schema)


def gae(df: DataFrame, gamma: float, lam: float, rewards: str = "rewards", values: str = "values") -> DataFrame:
    """Columns ``raw`` (unwhitened advantages) and ``returns``: ``A_t = delta_t + gamma lam A_{t+1}``, value 0 after the end."""

    def step(carry, after, r, v):
        a = r + gamma * after[1] - v + gamma * lam * carry
        return a, a

    scanned = reverse_scan(df, [rewards, values], "raw", step)
    return scanned.withColumn("returns", F.zip_with("raw", values, lambda a, v: a + v))


def discounted_returns(df: DataFrame, gamma: float, rewards: str = "rewards", mask: str = "mask") -> DataFrame:
    """Column ``returns``: ``G_t = r_t + gamma G_{t+1}``, where what is carried on is multiplied by the mask."""

    def step(carry, after, r, m):
        g = r + gamma * carry
        return g, g * m

    return reverse_scan(df, [rewards, mask], "returns", step)


def whiten_arrays(df: DataFrame, value: str, mask: str, out: str) -> DataFrame:
    """Whiten an array column with statistics of its masked positions over all rows."""
    long = df.select(F.explode(F.arrays_zip(F.col(value).alias("v"), F.col(mask).alias("m"))).alias("x")).select("x.*")
    mean, var = masked_stats(long, "v", "m")
    return df.withColumn(out, F.transform(value, lambda x: whiten(x, mean, var)))


def group_relative(score: Column, group: str | Column, eps: float = EPS) -> Column:
    """``(s - mean) / (std + eps)`` inside the group, with the sample deviation; a group of one is an error."""
    w = Window.partitionBy(group)
    value = (score - F.avg(score).over(w)) / (F.stddev_samp(score).over(w) + eps)
    return F.when(F.count(F.lit(1)).over(w) > 1, value).otherwise(F.raise_error(F.lit("a group needs more than one rollout")).cast("double"))


def leave_one_out(score: Column, group: str | Column) -> Column:
    """Score minus the mean of the group's other scores."""
    w = Window.partitionBy(group)
    n = F.count(F.lit(1)).over(w)
    value = score - (F.sum(score).over(w) - score) / (n - 1)
    return F.when(n > 1, value).otherwise(F.raise_error(F.lit("a group needs more than one rollout")).cast("double"))


def to_tokens(value: Column, mask: str) -> Column:
    """A row's scalar on each masked position."""
    return F.transform(mask, lambda m: m * value)


def fill_left(value: Column, row: str, pos: str, at: Column | None = None) -> Column:
    """Each position's value is the next non-zero one at or right of it, else 0 (long form).

    ``at`` marks the positions that have a value, where that may be 0 too.
    """
    w = Window.partitionBy(row).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(F.when(value != 0 if at is None else at, value), ignorenulls=True).over(w), F.lit(0.0))


def step_advantage(long: DataFrame, normalize: bool = True, eps: float = EPS) -> DataFrame:
    """Column ``adv`` for long rows with uid, row_id, pos, score, mask, is_end, is_delim.

    Scores at step ends are normalised over all step ends of the group, filled to the left, masked, and set to
    zero on DELIMITER_WIDTH positions from each delimiter (those beyond the end fall on the last one).
    """
    group = Window.partitionBy("uid")
    end = F.when(F.col("is_end"), F.col("score"))
    scaled = (F.col("score") - F.avg(end).over(group)) / (F.stddev_samp(end).over(group) + eps)
    if normalize:
        scaled = scaled * STEP_SCALE / (F.sqrt(F.count(end).over(group) - 1) + eps)
    rows = long.withColumn("_x", F.when(F.col("is_end"), scaled).otherwise(F.col("score")))
    near = Window.partitionBy("row_id").orderBy("pos").rowsBetween(-(DELIMITER_WIDTH - 1), 0)
    rows = rows.withColumn("_fill", fill_left(F.col("_x"), "row_id", "pos")).withColumn("_near", F.max(F.col("is_delim").cast("int")).over(near))
    return rows.withColumn("adv", F.when(F.col("_near") == 1, 0.0).otherwise(F.col("_fill") * F.col("mask"))).drop("_x", "_fill", "_near")


def minus_baseline(score: Column, baseline: Column) -> Column:
    """Score minus a baseline's score."""
    return score - baseline


#: Estimators of one scalar for each row: (score, group, baseline) to a column.
ESTIMATORS: dict[str, Callable[[Column, str, Column | None], Column]] = {
    "grpo": lambda s, g, b: group_relative(s, g),
    "grpo_latent": lambda s, g, b: group_relative(s, g),
    "rloo": lambda s, g, b: leave_one_out(s, g),
    "remax": lambda s, g, b: minus_baseline(s, b),
}


def advantage(name: str, score: Column, group: str, baseline: Column | None = None) -> Column:
    """The estimator by name; an unknown one is an error. GAE, REINFORCE++ and step advantages take DataFrames."""
    if name not in ESTIMATORS:
        raise NotImplementedError(f"no such estimator: {name}")
    return ESTIMATORS[name](score, group, baseline)


#: Estimators by name and, for group-relative ones, by the sampling strategy.
BY_STRATEGY = {("grpo", "greedy"): "grpo", ("grpo", "latent"): "grpo_latent"}


def compute_advantage(batch: DataFrame, estimator: str, strategy: str = "greedy", gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Array columns ``advantages`` and ``returns`` by the estimator's name: gae, grpo, reinforce_plus_plus, remax or rloo.

    Rows have uid, rewards and mask (arrays of a length), and for gae values, for remax reward_baseline. A row's score is
    the sum of its rewards; gae and reinforce_plus_plus are whitened over all masked positions. Other names, and
    strategies without a rule, are errors.
    """
    if estimator == "gae":
        scanned = gae(batch, gamma, lam)
        return whiten_arrays(scanned, "raw", "mask", "advantages").drop("raw")
    if estimator == "reinforce_plus_plus":
        scanned = whiten_arrays(discounted_returns(batch, gamma), "returns", "mask", "white")
        return scanned.withColumn("advantages", F.zip_with("white", "mask", lambda x, m: x * m)).drop("white")
    name = BY_STRATEGY.get((estimator, strategy)) if estimator == "grpo" else estimator
    score = F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x)
    value = advantage(name or f"{estimator} by {strategy}", score, "uid", F.col("reward_baseline") if "reward_baseline" in batch.columns else None)
    out = batch.withColumn("advantages", to_tokens(value, "mask"))
    return out.withColumn("returns", F.col("advantages"))

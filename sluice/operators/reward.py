"""Scores of rollouts and judging."""

from __future__ import annotations

import importlib.util
import inspect
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import answers


def length_penalty(length: Column, reference: Column) -> Column:
    """Tokens beyond a reference length, none if that is 0."""
    return F.when((length > reference) & (reference != 0), (length - reference).cast("double")).otherwise(0.0)


def score(accuracy: Column, formatted: Column, length: Column, reference: Column, format_weight: float = 0.1, penalty_weight: float = 0.001) -> Column:
    """Struct overall, format, accuracy of the batch score."""
    overall = (1 - format_weight) * accuracy + format_weight * formatted - penalty_weight * length_penalty(length, reference)
    return F.struct(overall.alias("overall"), formatted.alias("format"), accuracy.alias("accuracy"))


def simple_score(accuracy: Column, formatted: Column, format_weight: float = 0.5) -> Column:
    """Overall score without a length term."""
    return (1 - format_weight) * accuracy + format_weight * formatted


def cascade(rule: Column, asked: Column) -> Column:
    """The rule's verdict; where it is not right, the judge's if there is one."""
    return F.when(rule == 1, rule).otherwise(F.coalesce(asked, rule))


def verdict(response: Column, pred: Column, truth: Column, repetition: bool = False) -> Column:
    """A judge's reply as a number: null for an empty reply, 0 for an ambiguous one or a blank prediction."""
    r = F.lower(F.trim(response))
    yes, no = r.contains("yes"), r.contains("no")
    one, zero, minus = r.contains("1"), r.contains("0"), r.contains("-1")
    if repetition:
        value = F.when(one & ~zero & ~minus, 1.0).when(zero & ~one, 0.0).when(minus & ~zero, -1.0).otherwise(0.0)
    else:
        value = F.when(yes & ~no, 1.0).otherwise(0.0)
    return F.when(pred.isNull() | truth.isNull() | (F.trim(pred) == ""), 0.0).when(r.isNotNull() & (r != ""), value)


def judgement_format(x: Column) -> Column:
    """Whether a judgement is 0 or 1, after an optional label."""
    return F.coalesce(F.trim(F.replace(F.lower(x), F.lit("[judgment]:"), F.lit(""))).isin("0", "1"), F.lit(False))


def judge_rows(df: DataFrame, ask: Callable[[str, str, str], str | None], out: str = "reply", threads: int = 8, attempts: int = 5) -> DataFrame:
    """Replies of an injected judge for rows with question, pred, gt: a pool of threads for each Arrow batch.

    An error or an empty reply is tried again; after the last attempt the reply is null. Row order is kept.
    """

    def one(row) -> str | None:
        for _ in range(attempts):
            try:
                if reply := ask(*row):
                    return reply
            except Exception:  # noqa: BLE001  the judge is not ours: a failed call is tried again
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                yield pdf.assign(**{out: list(pool.map(one, pdf[["question", "pred", "gt"]].itertuples(index=False)))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, {out} string")


def rule_judge(pred: Column, truth: Column) -> Column:
    """1 or 0 by the grading cascade."""
    return answers.udf(lambda t, p: float(answers.grade(t, p)), "double")(truth, pred)


#: Columns by which a batch is scored, the first that it has counts.
REWARD_SOURCES = ("single_step_rewards", "full_step_rewards", "correctness", "ground_truth")


def reward_source(df: DataFrame) -> str:
    """Which column a batch is scored by; an error if it has none."""
    for c in REWARD_SOURCES:
        if c in df.columns:
            return c
    raise ValueError(f"the batch has none of {REWARD_SOURCES}")


def split_function_path(path: str) -> tuple[str, str]:
    """``file.py:name`` as its parts; the name is main if it is not given."""
    file, _, name = path.rpartition(":") if ":" in path else (path, "", "main")
    return file, name


def load_function(path: str, **kwargs) -> Callable:
    """A function of a file, with arguments bound; a missing file or name is an error."""
    file, name = split_function_path(path)
    spec = importlib.util.spec_from_file_location("loaded_function", file)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(file)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{file} has no {name}")
    return partial(getattr(module, name), **kwargs)


def with_accepted(f: Callable, **optional) -> Callable:
    """Bind those optional arguments that a function's signature has."""
    return partial(f, **{k: v for k, v in optional.items() if k in inspect.signature(f).parameters})


#: Reward functions by name.
REWARDS: dict[str, Callable] = {}


def register_reward(name: str) -> Callable[[Callable], Callable]:
    """Add a reward function to the registry."""

    def add(f: Callable) -> Callable:
        REWARDS[name] = f
        return f

    return add

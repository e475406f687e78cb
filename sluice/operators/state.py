"""Keyed state in versions: each step's increments are merged into what was before, without a look at all history.

A step writes one table of its own increments, an aggregate by key. Every ``compact`` steps all since the last base are
merged into a new base. A version is read as its last base and the increments after it, in one exchange that combines
rows before they move. So a step costs its own rows, and a base is written for every ``compact`` of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.folders import Folder

#: How two values of a column are merged; each is associative, so increments may be merged in any grouping.
MERGES: dict[str, Callable[[str], Column]] = {"min": F.min, "max": F.max, "sum": F.sum, "any": F.bool_or}


class StateStore:
    """Versions of keyed state below ``path``, a folder that driver and executors share.

    ``merges`` names for each column how values are merged (MERGES). Null values do not count in a merge; a null key is
    a key. A table counts once its writer has marked it as complete, so a step whose driver was lost is as if it had
    not been, and is put again. One driver writes at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, merges: dict[str, str], compact: int = 16):
        wrong = [m for m in merges.values() if m not in MERGES]
        if wrong or not merges or compact < 1:
            raise ValueError(f"no such merges: {wrong}" if wrong else "a store needs columns, and compact of at least 1")
        self.spark, self.key, self.merges, self.compact, self.folder = spark, key, merges, compact, Folder(spark, path)

    def _tables(self) -> list[tuple[int, str, bool]]:
        """(step, kind, complete) of all tables, the oldest first."""
        found = [name.split("-") for name in self.folder.names() if name.startswith(("base-", "step-"))]
        return sorted((int(step), kind, self.folder.has(f"{kind}-{step}/_SUCCESS")) for kind, step in found)

    def _path(self, kind: str, step: int) -> str:
        return f"{self.folder.path}/{kind}-{step:012d}"

    def _merged(self, df: DataFrame) -> DataFrame:
        return df.groupBy(self.key).agg(*(MERGES[how](c).alias(c) for c, how in self.merges.items()))

    def steps(self) -> list[int]:
        """Complete steps that are kept, the oldest first."""
        return sorted({step for step, _, complete in self._tables() if complete})

    def put(self, step: int, increments: DataFrame) -> None:
        """Merge a step's rows (the key and the columns of ``merges``; others are left out).

        A step that is put again replaces what it wrote before and forgets all later steps, so running a step twice
        changes nothing, and a run that goes back goes on from there. An unfinished earlier step is an error.
        """
        if step < 0:
            raise ValueError("steps are 0 or more")
        tables = self._tables()
        lost = [s for s, kind, complete in tables if kind == "step" and not complete and s < step]
        if lost:
            raise ValueError(f"step {lost[0]} was not finished; put it again first")
        for s, kind, _ in reversed(tables):
            if s >= step:
                self.folder.delete(f"{kind}-{s:012d}")
        self._merged(increments).write.parquet(self._path("step", step))
        bases = [s for s, kind, complete in tables if kind == "base" and complete and s < step]
        since = [s for s, kind, _ in tables if kind == "step" and (bases[-1] if bases else -1) < s < step]
        if len(since) + 1 >= self.compact:
            self.read(step).write.mode("overwrite").parquet(self._path("base", step))

    def read(self, step: int | None = None) -> DataFrame:
        """State after ``step``, or after the last one; a version that is no longer kept is an error."""
        done = [(s, kind) for s, kind, complete in self._tables() if complete and (step is None or s <= step)]
        bases = [s for s, kind in done if kind == "base"]
        base = bases[-1] if bases else -1
        paths = [self._path("base", base)] * bool(bases) + [self._path("step", s) for s, kind in done if kind == "step" and s > base]
        if not paths:
            raise ValueError(f"nothing is kept for step {step}")
        if bases and len(paths) == 1:
            return self.spark.read.parquet(paths[0])
        return self._merged(reduce(DataFrame.unionByName, (self.spark.read.parquet(p) for p in paths)))

    def forget_before(self, step: int) -> None:
        """Delete what no version from ``step`` on needs; what was before the last base up to it."""
        tables = self._tables()
        bases = [s for s, kind, complete in tables if kind == "base" and complete and s <= step]
        for s, kind, _ in tables:
            if bases and (s < bases[-1] or (s == bases[-1] and kind == "step")):
                self.folder.delete(f"{kind}-{s:012d}")


def length_state(spark: SparkSession, path: str, key: str, compact: int = 16) -> StateStore:
    """A store of least, total and number of lengths and a sticky flag for each key."""
    return StateStore(spark, path, key, {"min_len": "min", "total_len": "sum", "cnt": "sum", "correct": "any"}, compact)


def length_increments(rows: DataFrame, key: str, length: str, correct: Column) -> DataFrame:
    """Rows for ``length_state``: lengths of correct rows count, others only leave the flag as it is."""
    value = F.when(correct, F.col(length).cast("double"))
    return rows.select(key, value.alias("min_len"), value.alias("total_len"), F.when(correct, 1).otherwise(0).cast("long").alias("cnt"), F.coalesce(correct, F.lit(False)).alias("correct"))


def length_means(state: DataFrame) -> DataFrame:
    """The state with mean_len; null where no row was correct."""
    return state.withColumn("mean_len", F.when(F.col("cnt") > 0, F.col("total_len") / F.col("cnt")))

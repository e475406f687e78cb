"""Batch algebra over DataFrames. A batch is a DataFrame with a ``row_id`` from 0 to n - 1 that stands for position.

Nothing here gathers rows on the driver; checks that need a count run one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import LongType, StructField, StructType

from sluice.session import scratch_path

ROW = "row_id"
#: Rows aimed at in a range of ``positions``.
BUCKET_ROWS = 100_000


def positions(df: DataFrame, key: str, name: str = ROW) -> DataFrame:
    """Number rows from 0 in the order of a unique key of any type that sorts, without sorting all rows in one task.

    Rows are dealt over ranges of the key that Spark bounds by sampled quantiles, so each has about as many rows however
    the keys lie, and sorted there. A row's position is the number of rows in lower ranges, from a small table of counts,
    plus its place in its range. The ranges are written once, so that both steps see the same ones.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "positions")
    ranges = max(1, -(-df.count() // BUCKET_ROWS))
    dealt = df.repartitionByRange(ranges, F.col(key)).sortWithinPartitions(key)
    # an id has its range in the upper bits and counts from 0 in it
    dealt.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.schema(StructType([*df.schema.fields, StructField("_id", LongType())])).parquet(path)
    kept = kept.withColumn("_range", F.shiftright("_id", 33))
    counts = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(before, "_range").withColumn(name, (F.col("_before") + place).cast("long")).drop("_id", "_range", "_before")


def count_rows(df: DataFrame) -> int:
    """Number of rows."""
    return df.count()


def check_same_length(*dfs: DataFrame) -> int:
    """The common number of rows; an error if batches differ in length."""
    sizes = {d.count() for d in dfs}
    if len(sizes) > 1:
        raise ValueError(f"batches differ in length: {sorted(sizes)}")
    return sizes.pop() if sizes else 0


def check_ids(df: DataFrame) -> None:
    """An error unless row ids are 0 to n - 1, each once."""
    n, low, high, distinct = df.agg(F.count(F.lit(1)), F.min(ROW), F.max(ROW), F.count_distinct(ROW)).first()
    if n and (low, high, distinct) != (0, n - 1, n):
        raise ValueError("row ids are not 0 to n - 1")


def from_columns(spark, columns: dict[str, Sequence], schema: T.StructType | None = None) -> DataFrame:
    """A batch from lists of equal length; anything but lists and tuples is an error."""
    for k, v in columns.items():
        if not isinstance(v, (list, tuple)):
            raise ValueError(f"column {k} is a {type(v).__name__}, not a list")
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    names = [ROW, *columns]
    rows = [(i, *x) for i, x in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, T.StructType([T.StructField(ROW, T.LongType()), *schema.fields]) if schema else names)


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, n: int | None = None) -> DataFrame:
    """Rows of a Python slice with a positive step, renumbered."""
    if step < 1:
        raise ValueError("the step must be positive")
    n = df.count() if n is None and ((start or 0) < 0 or stop is None or stop < 0) else n
    a, b, _ = slice(start, stop, 1).indices(n if n is not None else max(0, stop or 0))
    kept = df.filter((F.col(ROW) >= a) & (F.col(ROW) < b) & ((F.col(ROW) - a) % step == 0))
    return kept.withColumn(ROW, F.expr(f"({ROW} - {a}) div {step}"))


def index_table(spark, indices: Sequence[int]) -> DataFrame:
    """(row_id, source) of an index list."""
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(indices)], f"{ROW} long, source long")


def take_rows(df: DataFrame, index: DataFrame) -> DataFrame:
    """Rows in the order of an index table (row_id, source), with repetitions."""
    return index.join(df.withColumnRenamed(ROW, "source"), "source").drop("source").select(*df.columns)


def select_columns(df: DataFrame, dense: Sequence[str] = (), objects: Sequence[str] = ()) -> DataFrame:
    """Project columns: a missing dense column is an error, a missing object column is ignored."""
    missing = [c for c in dense if c not in df.columns]
    if missing:
        raise KeyError(f"no such columns: {missing}")
    wanted = [ROW] * (ROW in df.columns) + [*dense, *(c for c in objects if c in df.columns)]
    return df.select(*dict.fromkeys(wanted))


def pop_columns(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(popped, rest): the named columns, and the batch without them."""
    return select_columns(df, columns), df.drop(*columns)


def rename_columns(df: DataFrame, old: str | Sequence[str], new: str | Sequence[str]) -> DataFrame:
    """Rename columns; both lists must have the same length."""
    old, new = [old] if isinstance(old, str) else list(old), [new] if isinstance(new, str) else list(new)
    if len(old) != len(new):
        raise ValueError("old and new names differ in number")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def union_columns(a: DataFrame, b: DataFrame, overwrite: Sequence[str] = ("multi_modal_inputs",)) -> DataFrame:
    """One-to-one column union by position. Shared columns must be equal, except those in ``overwrite``, taken from ``b``."""
    shared = [c for c in b.columns if c in a.columns and c != ROW]
    right = b.withColumnsRenamed({c: f"_b_{c}" for c in shared})
    joined = a.join(right, ROW)
    for c in shared:
        if c in overwrite:
            joined = joined.withColumn(c, F.col(f"_b_{c}"))
        else:
            same = F.col(c).eqNullSafe(F.col(f"_b_{c}"))
            joined = joined.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs between the batches"))))
    return joined.select(*a.columns, *(c for c in b.columns if c not in a.columns))


def merge_meta(a: dict, b: dict) -> dict:
    """Union of meta data; a key in both must have the same value."""
    for k in a.keys() & b.keys():
        if a[k] != b[k]:
            raise ValueError(f"meta key {k} differs")
    return a | b


def concat_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Row concatenation in order; a part's offset is the sum of the lengths before it."""
    out, offset = [], 0
    for p in parts:
        out.append(p.withColumn(ROW, F.col(ROW) + F.lit(offset)))
        offset += p.count() if p is not parts[-1] else 0
    return reduce(DataFrame.unionByName, out)


def chunk_ids(n: int, chunks: int) -> Column:
    """Number of the equal chunk of each row; an error if ``chunks`` does not divide ``n``."""
    if chunks < 1 or n % chunks:
        raise ValueError(f"{n} rows do not make {chunks} equal chunks")
    return F.expr(f"{ROW} div {max(1, n // chunks)}")


def split_ids(n: int, size: int) -> Column:
    """Number of each row's part when split by size: ``n // size`` equal parts."""
    if size < 1 or size > n:
        raise ValueError(f"parts of {size} cannot be cut from {n} rows")
    return chunk_ids(n, n // size)


def repeat_rows(df: DataFrame, times: int, interleave: bool = True, n: int | None = None) -> DataFrame:
    """Each row ``times`` times: a, a, b, b or, not interleaved, a, b, a, b."""
    each = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    new = F.col(ROW) * times + F.col("_k") if interleave else F.col("_k") * F.lit(df.count() if n is None else n) + F.col(ROW)
    return each.withColumn(ROW, new.cast("long")).drop("_k")


def inverse_permutation(index: DataFrame) -> DataFrame:
    """The index table that undoes a permutation."""
    return index.select(F.col("source").alias(ROW), F.col(ROW).alias("source"))


def pad_to_divisor(df: DataFrame, divisor: int, n: int | None = None) -> tuple[DataFrame, int]:
    """(batch, padding): rows from the top are repeated, cyclically, until the length divides by ``divisor``."""
    n = df.count() if n is None else n
    pad = -n % divisor
    if not pad or not n:
        return df, pad if n else 0
    rounds = -(-pad // n)
    more = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_at", F.col("_k") * n + F.col(ROW)).filter(F.col("_at") < pad)
    return df.unionByName(more.withColumn(ROW, (F.lit(n) + F.col("_at")).cast("long")).select(*df.columns)), pad


def unpad(df: DataFrame, n: int, pad: int) -> DataFrame:
    """Without the last ``pad`` of ``n`` rows."""
    return df.filter(F.col(ROW) < n - pad)


def fold_rows(df: DataFrame, value: str, folds: int, n: int) -> DataFrame:
    """``folds`` rows that hold ``n / folds`` consecutive values each."""
    fold = chunk_ids(n, folds).alias("fold")
    return df.groupBy(fold).agg(F.transform(F.array_sort(F.collect_list(F.struct(ROW, value))), lambda x: x[value]).alias(value))


def collate(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Rows to lists in the order of row ids, for each group."""
    lists = F.array_sort(F.collect_list(F.struct(ROW, *columns)))
    return df.groupBy(group).agg(lists.alias("_x")).select(group, *(F.transform("_x", _field(c)).alias(c) for c in columns))


def _field(name: str):
    return lambda x: x[name]


def mini_batches(df: DataFrame, size: int, epochs: int, n: int, seed: int | None = None) -> DataFrame:
    """(epoch, batch) of each row for ``epochs`` passes; with a seed, each pass has an order of its own."""
    if n % size:
        raise ValueError(f"mini-batches of {size} do not divide {n} rows")
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        return each.withColumn("batch", F.expr(f"{ROW} div {size}"))
    order = Window.partitionBy("epoch").orderBy(F.xxhash64(ROW, "epoch", F.lit(seed)), ROW)
    return each.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("long"))


def loader_batches(df: DataFrame, size: int, n: int, drop_last: bool) -> DataFrame:
    """Sequential batches; size -1 makes one batch; ``drop_last`` leaves out an incomplete tail."""
    size = n if size == -1 else size
    out = df.withColumn("batch", F.expr(f"{ROW} div {max(1, size)}"))
    return out.filter(F.col(ROW) < n // size * size) if drop_last and size else out


def shard_ids(n: int, world: int) -> Column:
    """Rank of each row for contiguous shards of ``ceil(n / world)`` rows."""
    return F.expr(f"{ROW} div {max(1, -(-n // world))}")


def size_of(column: str, kind: T.DataType) -> Column:
    """Estimated bytes of a column: elements times width for arrays, octets for strings and binaries."""
    widths = {T.LongType: 8, T.DoubleType: 8, T.IntegerType: 4, T.FloatType: 4, T.BooleanType: 1}
    if isinstance(kind, T.ArrayType):
        return F.sum(F.size(column) * F.lit(widths.get(type(kind.elementType), 8)))
    return F.sum(F.octet_length(column)) if isinstance(kind, (T.StringType, T.BinaryType)) else F.sum(F.lit(widths.get(type(kind), 8)))


def flatten_dict(d: dict, sep: str = "/", parent: str = "") -> dict:
    """Nested keys joined by ``sep``."""
    out: dict = {}
    for k, v in d.items():
        name = f"{parent}{sep}{k}" if parent else str(k)
        out |= flatten_dict(v, sep, name) if isinstance(v, dict) else {name: v}
    return out


def unflatten_dict(d: dict, sep: str = "/") -> dict:
    """The inverse of ``flatten_dict``."""
    out: dict = {}
    for k, v in d.items():
        at = out
        *path, last = k.split(sep)
        for p in path:
            at = at.setdefault(p, {})
        at[last] = v
    return out


def append_to_dict(lists: dict[str, list], values: dict) -> None:
    """Append each value to the list of its key."""
    for k, v in values.items():
        lists.setdefault(k, []).append(v)


def check_group_sizes(train_batch: int, rollouts: int, mini_batch: int, estimator: str, micro_batch: int = 1, critic_mini_batch: int | None = None, critic_micro_batch: int = 1) -> None:
    """The configuration's divisibility rules, and at least two rollouts for group-relative estimators.

    A critic's rules hold only if it is used, that is if ``critic_mini_batch`` is given.
    """
    for name, mini, micro in (("actor", mini_batch, micro_batch), ("critic", critic_mini_batch, critic_micro_batch)):
        if mini is not None and train_batch % mini:
            raise ValueError(f"the rollout batch does not divide by the {name}'s mini-batch")
        if mini is not None and train_batch * rollouts % micro:
            raise ValueError(f"the rollouts do not divide by the {name}'s micro-batch for experience")
    if estimator in {"grpo", "grpo_latent", "grpo_step", "rloo"} and rollouts < 2:
        raise ValueError(f"{estimator} needs at least two rollouts of a prompt")

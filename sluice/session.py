"""Session factory and the folder in which intermediate tables are kept."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "sluice", cores: int | None = None, **conf: object) -> SparkSession:
    """A local session with the settings that the operators expect; a running session is reused."""
    n = cores or os.cpu_count() or 4
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(n),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k: str(v) for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).master(f"local[{n}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Python workers give freed blocks of 256 KB and more back at once, so that a stage does not keep what the one before took.
WORKER_ENV = {"MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


#: The temporary folder of a local master without ``spark.checkpoint.dir``, which cannot be set in a running session.
_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one of this process only where it is unset on a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        global _local_dir
        _local_dir = found = _local_dir or "file://" + tempfile.mkdtemp(prefix="sluice-shared-")
    return found.rstrip("/")


_KEPT: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is written there is deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _KEPT.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _KEPT:
        try:
            if spark.sparkContext._jsc is not None:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone: nothing can be deleted through it
            pass


def ship_path(spark: SparkSession) -> None:
    """Let Python workers find this library where the driver has it (on a cluster it is installed or sent along)."""
    for key, value in WORKER_ENV.items():
        spark.sparkContext.environment.setdefault(key, value)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over several tasks for each core, for work on narrow rows that costs far more than moving them.

    A small file is one task, however long each of its rows takes.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def in_groups(df: DataFrame, keys: list[str], order: list[str] = []) -> DataFrame:  # noqa: B006
    """The rows with equal keys one after the other in a task, sorted, for ``groups``: where groups are many and small, a call
    for each of them costs far more than the work."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys).sortWithinPartitions(*keys, *order)


def groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """The rows of each group in turn; the first ``n_keys`` columns are the keys."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:n_keys] != rows[0][:n_keys]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


#: Rows of an Arrow batch that ``batched`` makes.
BATCHED = 1000


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches."""
    rows = iter(rows)
    while held := list(islice(rows, BATCHED)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    ship_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

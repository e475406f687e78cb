"""What the operators share: Arrow batches of bounded size and intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import shared_dir, ship_path

#: Rows and bytes in an Arrow batch that goes to Python; both bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_KEPT: list[tuple[SparkSession, str]] = []


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a Python worker holds a few MB of text at a time."""
    ship_path(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose ``column`` holds about ``limit`` bytes; a longer row comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def map_texts(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, **columns: Column) -> DataFrame:
    """``f`` over Arrow batches of just the given columns; other columns of ``df`` never leave the JVM."""
    bounded_batches(df.sparkSession)
    return df.select(*(c.alias(k) for k, c in columns.items())).mapInArrow(f, schema)


class Scratch:
    """Intermediate tables in the shared folder. A written table survives the loss of executors.

    ``keep`` writes a table and reads it back, which also cuts lineage; ``drop`` deletes tables that
    no later step reads. What the result still reads is deleted when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        _KEPT.append((spark, self.root))

    def path(self) -> str:
        """A new path below the shared folder."""
        self.n += 1
        return f"{self.root}/{self.n}"

    def keep(self, df: DataFrame) -> DataFrame:
        path, schema = self.path(), df.schema
        df.write.parquet(path)
        # the shuffle files of the finished write go when the driver's JVM sees that nothing refers to them, Python's frames too
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._scratch_path)


#: Slots of the bit table with which a scan skips rows that no later join can need: 1 MB, whatever the data.
FILTER_SLOTS = 1 << 23


def slot(key: Column) -> Column:
    """The place of a key in the bit table."""
    return F.pmod(F.xxhash64(key), F.lit(FILTER_SLOTS))


def bit_table(keys: DataFrame, key: str) -> np.ndarray:
    """Bits of the slots that any key has: at most FILTER_SLOTS / 8 bytes reach the driver.

    A set bit may come from another key, so it only saves work; what it lets pass is joined exactly.
    """
    placed = keys.select((slot(F.col(key)) + 1).alias("p"))
    rows = placed.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(FILTER_SLOTS // 8, np.uint8)
    for r in rows:
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def has_slot(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots are set."""
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _KEPT:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session is gone: nothing can be deleted through it
            pass


def crc_mod5(id_col: Column) -> Column:
    """crc32 of the id written as text, modulo 5; rows with 0 are held out of all learning."""
    return F.crc32(id_col.cast("string")) % 5

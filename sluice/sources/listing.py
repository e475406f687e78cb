"""Resume from what is really stored: files as they are listed, with marks that say how long a complete file is.

Rows are stored in blocks of ids, ``data/run=R/block=B/*.parquet``. A run that has ended marks its files with their
names, lengths and least and greatest ids in ``marks/run=R``. A file counts as done only if the listing has it with the
length of its mark, so files of a run that was lost, and files that were cut or are still being written, do not count
and their rows are written again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.folders import Folder

FILES = "path string, length long, modified timestamp"
MARKS = "path string, length long, least long, most long, n long, ord long"


def list_files(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """path, length and modified of all files below ``paths`` (folders or globs); contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return found.select(_name(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified"))


def _name(path: Column) -> Column:
    """run=.../block=.../file of a path, however its file system is written."""
    return F.regexp_extract(F.url_decode(path), r"(run=[^/]+/block=[^/]+/[^/]+)$", 1)


class ResumableFolder:
    """Rows by a non-negative whole id, ``width`` ids a block; a null id is an error when it is written."""

    def __init__(self, spark: SparkSession, root: str, id_col: str, width: int = 100_000):
        if width < 1:
            raise ValueError("a block has at least one id")
        self.spark, self.root, self.id_col, self.width = spark, root.rstrip("/"), id_col, width
        self._data, self._marks = Folder(spark, f"{self.root}/data"), Folder(spark, f"{self.root}/marks")

    def _paths(self, low: int | None, high: int | None) -> list[str]:
        """Folders of blocks that overlap the ids from low to high."""
        out = []
        for run in self._data.names():
            blocks = Folder(self.spark, f"{self._data.path}/{run}").names()
            keep = [b for b in blocks if b.startswith("block=") and (low is None or (int(b[6:]) + 1) * self.width > low) and (high is None or int(b[6:]) * self.width <= high)]
            out += [f"{self._data.path}/{run}/{b}" for b in keep]
        return out

    def marks(self) -> DataFrame:
        runs = [f"{self._marks.path}/{r}" for r in self._marks.names() if self._marks.has(f"{r}/_SUCCESS")]
        return self.spark.read.schema(MARKS).parquet(*runs) if runs else self.spark.createDataFrame([], MARKS)

    def done_files(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """Marks of complete files that may hold ids from low to high; only folders of those blocks are listed."""
        paths = self._paths(low, high)
        if not paths:
            return self.marks().limit(0)
        overlap = F.lit(True) if low is None else F.col("most") >= low
        overlap &= F.lit(True) if high is None else F.col("least") <= high
        return self.marks().filter(overlap).join(list_files(self.spark, paths).select("path", "length"), ["path", "length"], "left_semi")

    def read(self, schema: str, low: int | None = None, high: int | None = None) -> DataFrame:
        """Rows of complete files with ids from low to high, with ``ord``, the number of the run that wrote them."""
        # one short row for each file of at most ``width`` ids, as Spark's own listing holds them too
        files = self.done_files(low, high).select("path", "ord").collect()
        out = None
        for ord_ in sorted({f.ord for f in files}):
            part = self.spark.read.schema(schema).parquet(*(f"{self._data.path}/{f.path}" for f in files if f.ord == ord_)).withColumn("ord", F.lit(ord_))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], f"{schema}, ord long")
        id_ = F.col(self.id_col)
        return out.filter((F.lit(True) if low is None else id_ >= low) & (F.lit(True) if high is None else id_ <= high))

    def write(self, rows: DataFrame) -> None:
        """Store rows as a run of its own and mark its files."""
        run, id_ = f"run={uuid.uuid4().hex}", F.col(self.id_col)
        path = f"{self._data.path}/{run}"
        block = F.when(id_ >= 0, F.floor(id_ / self.width)).otherwise(F.raise_error(F.lit("an id is null or negative")).cast("long"))
        # a block of many rows is several files: the second key spreads its ids
        blocked = rows.withColumn("block", block)
        blocked.repartition("block", F.pmod(F.xxhash64(id_), F.lit(8))).write.partitionBy("block").parquet(path)
        blocks = [b for b in Folder(self.spark, path).names() if b.startswith("block=")]
        if not blocks:
            return
        ord_ = len(self._marks.names()) + 1
        ranges = self.spark.read.option("recursiveFileLookup", "true").parquet(path).groupBy(_name(F.input_file_name()).alias("path"))
        ranges = ranges.agg(F.min(id_).alias("least"), F.max(id_).alias("most"), F.count(F.lit(1)).alias("n"))
        marks = list_files(self.spark, [path]).join(ranges, "path").select("path", "length", "least", "most", "n", F.lit(ord_).cast("long").alias("ord"))
        marks.coalesce(1).write.parquet(f"{self._marks.path}/{run}")

    def resume(self, rows: DataFrame, schema: str) -> None:
        """Store the rows whose ids are in no complete file yet."""
        done = self.read(schema).select(self.id_col)
        self.write(rows.join(done, self.id_col, "left_anti"))

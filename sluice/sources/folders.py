"""Folders of the shared file system, through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder that is listed and changed by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """Names of what is in the folder, sorted; none if it is missing."""
        if not self._fs.exists(self._path(self.path)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)))

    def has(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

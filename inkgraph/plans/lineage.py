"""Cutting lineage through the folder that driver and executors share.

Iterative operators and operators that read one intermediate result several
times write it once as Parquet.  The folder is ``spark.checkpoint.dir``; losing
an executor then costs a re-read, never a recomputation of the whole chain.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only on a local master."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="inkgraph-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return "file://" + _own


class Scratch:
    """Intermediate tables of one operator call, in one folder of the shared folder."""

    def __init__(self, spark: SparkSession, name: str, within: Scratch | None = None):
        self.spark = spark
        self.path = f"{within.path if within else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Write ``df`` and return a frame that reads it back."""
        out = f"{self.path}/{table}"
        df.write.parquet(out)
        return self.spark.read.schema(df.schema).parquet(out)

    def _at(self, table: str | None):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}" if table else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, table: str) -> bool:
        path, files = self._at(table)
        return files.exists(path)

    def drop(self, table: str | None = None) -> None:
        """Delete one table, or all of them, once nothing reads it any more."""
        path, files = self._at(table)
        files.delete(path, True)

    def keep(self, *tables: str) -> None:
        """Delete all but these tables, with the folders of operators that worked within this one."""
        path, files = self._at(None)
        for found in files.listStatus(path):
            if found.getPath().getName() not in tables:
                files.delete(found.getPath(), True)


class Grown:
    """A table that grows part by part and stays few tables: ``fan`` of one size are written as one of the next.

    So it is read from at most ``fan`` tables for each power of ``fan`` among its parts, and a row
    is written once for each.
    """

    def __init__(self, scratch: Scratch, name: str, fan: int = 8):
        self.scratch, self.name, self.fan = scratch, name, fan
        self.sizes: list[list[DataFrame]] = [[]]
        self.written = 0

    def add(self, part: DataFrame) -> None:
        self.sizes[0].append(part)
        for k in range(len(self.sizes)):
            if len(self.sizes[k]) < self.fan:
                return
            self.written += 1
            merged = self.scratch.write(reduce(DataFrame.unionByName, self.sizes[k]), f"{self.name}-{self.written}")
            self.sizes[k] = []
            if k + 1 == len(self.sizes):
                self.sizes.append([])
            self.sizes[k + 1].append(merged)

    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [x for size in self.sizes for x in size])

"""Tables written to the folder that all executors share, to cut the lineage of iterative plans.

What reads a written table reads files, not an executor's memory, so a lost executor takes nothing with it. The
tables of an application lie in one folder, which `clear` deletes when no result of it is needed any more.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in a local session, a folder of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.gettempdir()}/chronoweave-shared"
    return path.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/chronoweave-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any more, on any file system, and empties the list."""
    for path in paths:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
    paths.clear()


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has written. DataFrames made from them cannot be read afterwards."""
    remove(spark, [_folder(spark)])


_here = threading.local()


@contextmanager
def recording(paths: list[str]) -> Iterator[None]:
    """Within, in this thread, notes the tables that are written, for `remove`."""
    outer, _here.paths = getattr(_here, "paths", None), paths
    try:
        yield
    finally:
        _here.paths = outer


class Growing:
    """A table that grows by a part a round; reading it is one scan, however many rounds there were."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.rounds = spark, fresh_path(spark, name), 0

    def add(self, df: DataFrame) -> DataFrame:
        """Writes a part, and returns it as read from there."""
        part = f"{self.path}/round={self.rounds}"
        df.write.parquet(part)
        self.rounds += 1
        return self.spark.read.schema(df.schema).parquet(part)

    def all(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("round")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as files in the shared folder, and read from there."""
    path = fresh_path(df.sparkSession, name)
    if getattr(_here, "paths", None) is not None:
        _here.paths.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

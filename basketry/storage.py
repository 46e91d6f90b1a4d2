"""Tables that all executors share: in the folder of spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's checkpoint folder. Where that is unset, as in tests, a temporary folder is taken that goes with this process; only a master in one process has that choice."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _local:
            _local[sc.applicationId] = folder = tempfile.mkdtemp(prefix="basketry-tables-")
            atexit.register(shutil.rmtree, folder, True)
        found = f"file://{_local[sc.applicationId]}"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written there and read again, so that its lineage ends."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Rounds:
    """The tables of an iteration: each round's takes the place of the one before, which is deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def next(self, df: DataFrame, keep: int = 1) -> DataFrame:
        """df written and read again. The last `keep` tables stay."""
        path = shared_path(self.spark, self.name)
        df.write.parquet(path)
        self.paths.append(path)
        while len(self.paths) > keep:
            delete(self.spark, self.paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

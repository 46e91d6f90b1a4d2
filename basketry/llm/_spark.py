"""Where tables that all executors share are kept, and how workers find this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Rows up to which a table of a few numbers a row is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers of this session import the package from where the driver has it, and hold little memory.

    This bounds the session's Arrow batches by BATCH_BYTES, unless they are smaller already,
    and has workers give memory back that they have freed.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, environment.get("PYTHONPATH")) if x)
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_MMAP_THRESHOLD_", "262144"), ("MALLOC_TRIM_THRESHOLD_", "1048576"), ("MALLOC_ARENA_MAX", "2")):
        environment.setdefault(name, value)
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Unset, as in tests: a temporary one that goes with this process, for a master in one process alone."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _local:
            _local[sc.applicationId] = folder = tempfile.mkdtemp(prefix="basketry-")
            atexit.register(shutil.rmtree, folder, True)
        found = "file://" + _local[sc.applicationId]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str) -> DataFrame:
    """df written there and read again. Files of the shuffles that made it go when it is written."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and no lost executor takes rows with it."""
    return write(df, new_path(df.sparkSession, name))


class Scratch:
    """Tables of one run in the shared folder. A table saved under a name that is taken already supersedes the other, which is deleted."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        out = write(df, path)
        self.drop(name)
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more. Names that aren't taken are passed over."""
        for name in names:
            if path := self.paths.pop(name, None):
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table that was saved, marked for broadcast if it is counted to have so many rows at most."""
    return F.broadcast(df) if df.count() <= rows else df

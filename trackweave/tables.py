"""Tables between steps: written into the folder that driver and executors share, so a lost executor costs a retry."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast sides are checked against this many bytes; beyond it the operators shuffle instead.
BROADCAST_BYTES = 32 << 20
#: Bytes of a partition of a narrow table.
FILE_BYTES = 64 << 20

_own_dirs: dict[str, str] = {}
_made: list[str] = []  # folders that operators of this process have made and not removed


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a folder of our own under the local temporary one, if the session runs in this process alone
    (local mode); on a cluster other machines couldn't read it, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        folder = tempfile.mkdtemp(prefix="trackweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dirs[app] = "file://" + folder
    return _own_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/trackweave-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def few_files(df: DataFrame, most: int) -> DataFrame:
    """A table of at most so many bytes in partitions of FILE_BYTES, a partition a core at least, so that writing it
    doesn't make a file for each shuffle partition."""
    return df.coalesce(max(4, df.sparkSession.sparkContext.defaultParallelism, min(1_000_000, -(-most // FILE_BYTES))))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of df: for a scan, those of the files' columns that it reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def materialize(df: DataFrame, label: str, most: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts the lineage and survives lost executors.

    most: a bound on the bytes of a table that comes from a shuffle and has ids and digests only; it is written in few
    files. Tables with texts are written as they are partitioned.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    (df if most is None else few_files(df, most)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trackweave_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table that materialize() made and that nothing reads any more."""
    path = getattr(df, "_trackweave_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    if path in _made:
        _made.remove(path)


@contextmanager
def spent(spark: SparkSession):
    """Removes at its end what operators made in the meantime; yields a function that names tables to leave there.

    Results of operators read tables that these made, so they must have been written by then.
    """
    before, left = set(_made), set()
    yield lambda df: left.add(df._trackweave_path)
    for path in [p for p in _made if p not in before and p not in left]:
        remove(spark, path)


def small_side(df: DataFrame, rows: int, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted size is within the bound, else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= most else df

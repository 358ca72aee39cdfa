"""What several operators need: the shared folder, written tables, checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two or three short columns that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one serves local sessions (tests); a cluster must name one, as its machines don't see each other's disks."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("quire.shared.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("quire.shared.dir", found)
    return found.rstrip("/")


_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quire-{re.sub('[^a-z0-9]+', '-', name.lower())}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def delete_written(spark: SparkSession) -> int:
    """Deletes what this process has written to the shared folder; returns how many folders. For when all results that read from it are saved."""
    n = 0
    while _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (rows of a few short columns) to be broadcast if a count finds at most that many rows, and else never, not by Spark's own estimate either. df should be cheap to count (a written table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(col):
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_held: dict[tuple, Any] = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one operator's tables and caches at a time, as workers outlive stages."""
    if key not in _held:
        release()
        _held[key] = make()
        _trim()
    return _held[key]


def release() -> None:
    """Gives back what another operator left in this worker."""
    _held.clear()
    _trim()


def _trim() -> None:
    """Returns freed memory to the machine: Python's, Arrow's and the C library's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass

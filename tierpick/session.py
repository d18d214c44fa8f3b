"""Session helpers."""

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"tierpick-{application}-")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can read and write.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_dir(spark.sparkContext.applicationId)


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder name for one run, below the shared folder."""
    return f"{shared_dir(spark)}/tierpick/{name}-{uuid.uuid4().hex}"


# Folders staged in the innermost scope of this thread.
_folders: ContextVar[list[str] | None] = ContextVar("folders", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what was staged inside once the block ends, also if it fails.

    For jobs: their results have to be written before the block ends. Without
    it staged folders stay below the shared folder.
    """
    mine: list[str] = []
    outer = _folders.set(mine)
    try:
        yield
    finally:
        _folders.reset(outer)
        for folder in mine:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the plan where a result is used several times; the written table
    outlives lost executors.
    """
    path = run_dir(df.sparkSession, name)
    if (mine := _folders.get()) is not None:
        mine.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

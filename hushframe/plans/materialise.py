"""Writing a table once, so that it is read many times but computed one time.

A release that stays lazy would draw new noise in each action; a phase that depends on a release
must see the same numbers as the analyst. The table goes to the shared folder that the cluster
names in ``spark.checkpoint.dir``, so a lost executor cannot lose it.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: What a table is called that a user asked for; all others are intermediate.
RELEASE = "release"

_notes: ContextVar[list[str] | None] = ContextVar("intermediate paths", default=None)


@contextmanager
def noting_intermediates(paths: list[str]) -> Iterator[None]:
    """Add the path of each intermediate table that is written inside to ``paths``."""
    token = _notes.set(paths)
    try:
        yield
    finally:
        _notes.reset(token)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, wherever the shared folder lies."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="hushframe-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    notes = _notes.get()
    if notes is not None and name != RELEASE:
        notes.append(path)
    return path


def materialise(df: DataFrame, name: str = RELEASE) -> DataFrame:
    """Write the table once and return the written copy."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

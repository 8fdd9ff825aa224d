"""The result table of the error study: appended per run, read back, resumed by key."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from hushframe.operators.matching import null_safe_anti_join

PARTITIONS = ("mechanism", "query", "dataset_size")
#: Partition column of a run's rows.
RUN = "run_id"


def append_results(df: DataFrame, path: str, run: str | None = None) -> None:
    """Add a run's rows to a table that is partitioned the way results are looked up.

    A run is a folder of the table and replaces what a run of the same name left, so that a job which is tried again
    leaves its rows once, whether its first try stopped before, amid or after writing. Other runs stay as they are. Without a name each call is a run of its own.
    """
    run = uuid.uuid4().hex if run is None else run
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", run):
        raise ValueError(f"a run is named by letters, digits, _ and -, got {run!r}")
    rows = df.hint("rebalance", *PARTITIONS).write.mode("overwrite").option("partitionOverwriteMode", "static")
    rows.partitionBy(*PARTITIONS).parquet(f"{path}/{RUN}={run}")


def read_results(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all runs in the columns of the schema, which may name ``run_id``."""
    rows = spark.read.schema(schema).parquet(path)
    names = T.StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names
    return rows.select(*names)


def pending_trials(grid: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Settings of the grid that have no result yet, whichever of them were finished before."""
    return null_safe_anti_join(grid, results.select(*keys).distinct(), keys)

"""Name -> Spark query and, where SQL can say it, the checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name."""
    def add(run: Run) -> Run:
        if run.__name__ in REGISTRY:
            raise ValueError(f"two queries are called {run.__name__}")
        REGISTRY[run.__name__] = Entry(run, sql)
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")

"""Reading private tables: explicit schemas, whole folders in one job, text lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hushframe.functions.scalars import cast_or_default

# Fixed format of dataset names: size, scale and skew of a one-column table.
DATASET_NAME = r"data_(\d+)_(\d+)_(\d+)\.csv"


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A Parquet table, or a CSV table with a header and a given schema (no inference pass)."""
    if path.rstrip("/").endswith(".parquet"):
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    if schema is None:
        raise ValueError("a CSV table needs a schema")
    return spark.read.schema(schema).csv(path, header=True)


def parse_numeric_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Keep the text lines that parse as a number, which also drops a header."""
    parsed = F.trim(F.col(column)).try_cast("double")
    return lines.select(parsed.alias("value")).filter(F.col("value").isNotNull())


def read_numeric_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_numeric_lines(spark.read.text(path))


def split_lines(df: DataFrame, names: Sequence[str], sep: str = ",", column: str = "value") -> DataFrame:
    """Raw text split into named string columns; a short line gives NULL."""
    parts = F.split(F.col(column), f"\\Q{sep}\\E", -1)
    return df.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def select_cast(df: DataFrame, column: str, type_name: str, default: object) -> DataFrame:
    """One text column as numbers, a constant where it does not parse."""
    return df.select(cast_or_default(column, type_name, default).alias(column))


def read_dataset_dir(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """All CSV datasets under a folder as one table with a ``dataset`` column: one job, not one per file.

    A dataset is a file ``data_<size>_<scale>_<skew>.csv``, or a folder of part files of that name. The
    name is cut out of the path without a pattern match, which would cost more per row than parsing the row.
    """
    reader = spark.read.schema(schema).option("header", True)
    files = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    tail = F.substring_index(F.col("_metadata.file_path"), "data_", -1)
    name = F.concat(F.lit("data_"), F.substring_index(tail, ".csv", 1), F.lit(".csv"))
    return files.select("*", name.alias("dataset"))


def dataset_features(name: Column | str = "dataset") -> dict[str, Column]:
    """Size, scale and skew out of a dataset name, wherever the folder has underscores."""
    c = F.col(name) if isinstance(name, str) else name
    return {
        "dataset_size": F.regexp_extract(c, DATASET_NAME, 1).try_cast("bigint"),
        "dataset_scale": F.regexp_extract(c, DATASET_NAME, 2).try_cast("int"),
        "dataset_skew": F.regexp_extract(c, DATASET_NAME, 3).try_cast("int"),
    }


def write_dataset_dir(df: DataFrame, folder: str, dataset: str = "dataset") -> None:
    """One folder of CSV part files per dataset name, written in one job.

    Rebalancing gathers small datasets into few files and splits one that holds most of the rows.
    """
    spread = df.hint("rebalance", dataset)
    spread.write.mode("error").option("header", True).partitionBy(dataset).csv(folder)

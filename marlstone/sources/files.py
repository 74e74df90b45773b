"""Readers and writers of plain tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import UTC, datetime

from pyarrow.parquet import ParquetFile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, readers: int | None = None) -> DataFrame:
    """Only `.parquet` files below `path`; only `columns`; at most `readers` tasks
    read at once, for stores that limit requests."""
    df = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(path)
    df = df.select(*columns) if columns else df
    return df.coalesce(readers) if readers else df


def csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header and a declared schema; nothing is inferred."""
    return spark.read.csv(path, schema=schema, header=True)


def write_stamped(df: DataFrame, base: str, single: bool = False) -> str:
    """Write Parquet into a folder of `base` named by the time in UTC."""
    path = f"{base}/{datetime.now(UTC):%Y%m%dT%H%M%SZ}"
    (df.coalesce(1) if single else df).write.parquet(path)
    return path


def inspect(path: str) -> dict:
    """Rows, row groups, columns and bytes of one Parquet file."""
    meta = ParquetFile(path).metadata
    return {"rows": meta.num_rows, "row_groups": meta.num_row_groups, "columns": meta.num_columns, "bytes": os.path.getsize(path)}


def fetch_once(url: str, path: str, get: Callable[[str], bytes]) -> str:
    """Fetch a file on the driver unless it is there already."""
    if not os.path.exists(path):
        part = f"{path}.part"
        with open(part, "wb") as f:
            f.write(get(url))
        os.replace(part, path)
    return path


def prompts(spark: SparkSession, texts: list[str], n: int, seed: int) -> DataFrame:
    """n rows (id, prompt) drawn with replacement, the same for the same seed."""
    choice = F.get(F.array(*[F.lit(t) for t in texts]), F.floor(F.rand(seed) * len(texts)).cast("int"))
    return spark.range(0, n, 1, 1).select("id", choice.alias("prompt"))


def regression_rows(spark: SparkSession, n: int, dims: int, seed: int, noise: float = 0.1) -> DataFrame:
    """x (list of `dims` standard normals) and y = x . (0, 1, ...) + 0.5 + noise."""
    rows = spark.range(n).select(F.array(*[F.randn(seed + i) for i in range(dims)]).alias("x"), F.randn(seed + dims).alias("e"))
    dot = F.aggregate(F.transform("x", lambda v, i: v * i), F.lit(0.0), lambda acc, v: acc + v)
    return rows.select("x", (dot + 0.5 + noise * F.col("e")).alias("y"))

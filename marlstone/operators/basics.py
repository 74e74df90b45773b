"""Plain relational steps: describe, counts, ratios, filters, ordered limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import lookup_join


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, mean, stddev (sample), min, max: one pass, one row a column."""
    stats = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[f(c).cast("double").alias(f"{c}\u0001{n}") for c in columns for n, f in stats.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}\u0001{n}`").alias(n) for n in stats]) for c in columns])
    return one.select(F.inline(rows))


def ratio(a: str, b: str) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(F.col(a), F.col(b))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renamed by map; names that aren't in it stay."""
    return df.withColumnsRenamed(names)


def renamed_keys(keys: list[str], names: dict[str, str]) -> list[str]:
    """The keys as they are called after `rename`."""
    return [names.get(k, k) for k in keys]


def looked_up(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """`rows` with `value` of the row of `table` with the same `key` (keys are unique);
    null for a null key, an error for a key that isn't in the table."""
    known = table.select(F.col(key).alias("_key"), F.struct(value).alias("_hit")).where("_key is not null")
    named = known.withColumnRenamed("_key", key)
    hit = lookup_join(rows, named, [key], "left", known.count())
    lost = F.raise_error(F.concat(F.lit(f"unknown {key} "), F.col(key).cast("string")))
    found = F.when(F.col("_hit").isNotNull(), F.col(f"_hit.{value}")).when(F.col(key).isNotNull(), lost.cast(table.schema[value].dataType))
    return hit.withColumn(value, found).drop("_hit")


def pass_through(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns that are present, in their order."""
    return df.select(*[c for c in allowed if c in df.columns])


def rows_per_block(df: DataFrame, rows: int, total: int) -> DataFrame:
    """Repartitioned so that a block holds about `rows` of the `total` rows."""
    return df.repartition(max(1, -(-total // rows)))


def missing_or_changed(wanted: DataFrame, present: DataFrame, key: str, size: str) -> DataFrame:
    """Rows of `wanted` with no row of the same key and size in `present`."""
    return wanted.join(present.select(key, size), [key, size], "left_anti")

"""Joins on time and ranges: forward as-of and range overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import stored


def asof_forward(rows: DataFrame, frames: DataFrame, keys: list[str], target: str, time: str, slack: Column | float, take: list[str], buckets: Column | None = None) -> DataFrame:
    """`rows` with the columns `take` of the first frame of the same `keys` whose
    `time` is at or after `target` - `slack`; null where the frames run out.
    Frames without a time are skipped. Both sides are put in one order, cut into
    chunks by range, and the next frame is looked up with a window inside the
    chunk, then in the chunks after it (one row per chunk and key), so no pair is
    formed and a key of any size spreads over many tasks; keys should name the
    file, so a frame of another file is never carried over."""
    at = F.col(target) - (F.lit(slack) if not isinstance(slack, Column) else slack)
    names = [c for c in rows.columns if c not in keys]
    frame = F.struct(F.col(time).alias("ft"), F.struct(*take).alias("v"))
    left = rows.select(*keys, at.alias("_at"), F.lit(0).alias("_kind"), F.struct(*names).alias("_row"), F.lit(None).cast(frames.select(frame).schema[0].dataType).alias("_frame"))
    right = frames.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), frame.alias("_frame"))
    chunks = stored(left.unionByName(right).repartitionByRange(*keys, "_at").withColumn("_chunk", F.spark_partition_id()), "asof")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(F.desc("_at"), F.desc("_kind"), F.desc("_frame")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    first = chunks.groupBy(*keys, "_chunk").agg(F.min("_frame").alias("_first"))
    ahead = first.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_chunk").alias("_c"), F.last("_first", ignorenulls=True).over(later).alias("_ahead"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_chunk") == F.col("_c")]
    found = chunks.withColumn("_next", F.last("_frame", ignorenulls=True).over(inside)).where("_kind = 0").join(ahead, on).withColumn("_hit", F.coalesce("_next", "_ahead"))
    return found.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in names], F.col("_hit.ft").alias("frame_time"), *[F.col(f"_hit.v.{c}").alias(c) for c in take])


def range_overlap(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], width: int) -> DataFrame:
    """Pairs of half-open integer ranges of the same keys that overlap. Each range
    is listed under the cells of `width` it touches; a pair is kept only in the
    first cell both touch, so it comes out once and the join is an equi-join."""
    (af, at), (bf, bt) = a_range, b_range

    def cells(df: DataFrame, f: str, t: str) -> DataFrame:
        return df.where(F.col(t) > F.col(f)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(f) / width), F.floor((F.col(t) - 1) / width))))

    joined = cells(a, af, at).join(cells(b, bf, bt), [*keys, "_cell"])
    first = F.floor(F.greatest(af, bf) / width)
    return joined.where((F.col(af) < F.col(bt)) & (F.col(at) > F.col(bf)) & (F.col("_cell") == first)).drop("_cell")

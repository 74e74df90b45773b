"""Exact percentiles per group by bisection, from daily summaries.

A summary counts values per (day, group, metric, bucket) with each bucket's least
and greatest value; a bucket spans a ratio of 2^(1/64), so a percentile read from
summed summaries is known to within 1.1 % (of 1 + |value|), and its interval is
certain. Summaries of days or partitions add up.

Bisection starts from these intervals: each pass cuts every open interval
(group, metric, percentile) at 15 evenly spaced points (four halvings at once),
counts the rows in each part, and keeps the part that holds the target rank,
tightened to the values that occur in it. Its ends are values of the data, so
every pass removes at least one; it ends when a part holds one value. Groups and
their intervals stay distributed; only the number of open intervals is counted.

The rank of permille m among n values is ceil(m * n / 1000), at least 1 (the
least value with at least that share at or below it). Null and NaN are no values.

A null group is a group; a group without values, and an empty table, give no
rows; equal values and repeated rows count as often as they occur; infinities
are values at the ends; columns that aren't named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import lookup_join, stored

PARTS = 16
STEPS_PER_OCTAVE = 64


def long_values(df: DataFrame, keep: list[str], metrics: dict[str, str]) -> DataFrame:
    """`keep`, metric, value: one row per valid value; `metrics` maps a column to
    the SQL condition under which its value counts."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.when(F.expr(ok), F.col(m)).cast("double").alias("value")) for m, ok in metrics.items()])
    return df.select(*keep, F.inline(entries)).where("value is not null and not isnan(value)")


def summaries(values: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, bucket, n, lo, hi of (keys, value)."""
    v = F.col("value")
    size = F.floor(F.least(F.log2(F.lit(1.0) + F.abs(v)), F.lit(1025.0)) * STEPS_PER_OCTAVE).cast("int")  # infinity has a bucket of its own
    weight = F.col("n") if "n" in values.columns else F.lit(1)
    return values.withColumn("bucket", F.when(v < 0, -size - 1).otherwise(size)).groupBy(*keys, "bucket").agg(F.sum(weight).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def combined(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries added up over everything but `keys`."""
    return parts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def located(summary: DataFrame, keys: list[str], permilles: list[int]) -> DataFrame:
    """For each group and permille the bucket with the target rank: `keys`,
    permille, total, rank (inside the bucket), lo, hi."""
    w = Window.partitionBy(*keys)
    run = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    m = F.explode(F.array(*[F.lit(p) for p in permilles]))
    ranked = summary.withColumn("below", F.coalesce(F.sum("n").over(run), F.lit(0))).withColumn("total", F.sum("n").over(w)).withColumn("permille", m)
    rank = F.greatest(F.lit(1), F.expr("(permille * total + 999) div 1000"))
    return ranked.withColumn("r", rank).where("r > below and r <= below + n").select(*keys, "permille", "total", (F.col("r") - F.col("below")).alias("rank"), "lo", "hi")


def bisect(values: DataFrame, start: DataFrame, keys: list[str], max_passes: int = 200) -> DataFrame:
    """`keys`, permille, total, value: `values` (keys, value; n copies if there is such
    a column) narrowed from the intervals of `start` (as `located` gives them). Every
    pass reads the values where they are: the open intervals go to them, and only counts
    of the parts are shuffled."""
    weight = F.sum("n") if "n" in values.columns else F.count(F.lit(1))
    held = [*keys, "permille", "total", "rank"]
    state = stored(start, "intervals")
    ended = []
    for _ in range(max_passes):
        ended.append(state.where("lo = hi").select(*held, F.col("lo").alias("value")))
        todo = state.where("lo < hi")
        rows = todo.count()
        if not rows:
            break
        hits = lookup_join(values.withColumn("_v", F.col("value")), todo.withColumnsRenamed({k: f"_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_v").between(F.col("lo"), F.col("hi"))], "inner", rows)
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * PARTS).cast("int"))
        counted = hits.groupBy(*held, part.alias("bucket")).agg(weight.alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        run = Window.partitionBy(*held).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        state = stored(
            counted.withColumn("below", F.coalesce(F.sum("n").over(run), F.lit(0))).where("rank > below and rank <= below + n").select(*keys, "permille", "total", (F.col("rank") - F.col("below")).alias("rank"), "lo", "hi"), "intervals"
        )
    else:
        raise RuntimeError("bisection did not end")
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out.select(*keys, "permille", "total", "value")

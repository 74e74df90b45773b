"""Top N items within every group, for groups of any size.

1. A histogram of order-preserving score buckets per group (partial counts run
   before the shuffle) gives for each group the lowest bucket whose cumulative
   count from above reaches N: a bar that leaves at least N rows.
2. Rows below the bar are filtered out by a join on the group. Bars of the hot groups,
   those with a thousandth of all rows or more (so a thousand at most), are broadcast
   to the rows where they are; only rows of the other groups are shuffled.
3. The survivors are ranked exactly with the tie keys; Spark's window group
   limit keeps N rows per task before the shuffle, so a bucket full of ties
   can't fill one task.

Rows with a null or NaN score are not ranked; rows equal in score and all tie
keys are all candidates and row_number picks among them, so tie keys should be
unique in a group. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import stored

#: A group with this share of all rows is hot: there are HOT such groups at most.
HOT = 1000


def score_bucket(score: Column) -> Column:
    """Monotone coarse bucket of a double: sign(x) * floor(16 * log2(1 + |x|))."""
    mag = F.floor(F.least(F.log2(F.lit(1.0) + F.abs(score)), F.lit(1025.0)) * 16).cast("int")
    return F.when(score < 0, -mag).otherwise(mag)


def top_n(df: DataFrame, group: list[str], score: str, n: int, ties: list[tuple[str, bool]], rank: str = "rank") -> DataFrame:
    """The n rows of each group with the highest `score`; ties go by `ties`, pairs
    of column and whether its highest value wins (nulls last). All columns of `df`
    come back, whatever their names, with `rank` added (an input column of that name
    is replaced)."""
    groups, keys = [f"g{i}" for i in range(len(group))], [f"t{i}" for i in range(len(ties))]
    rows = df.select(
        *[F.col(c).alias(g) for c, g in zip(group, groups, strict=True)], F.col(score).cast("double").alias("s"), *[F.col(c).alias(t) for (c, _), t in zip(ties, keys, strict=True)], F.struct(*[F.col(f"`{c}`") for c in df.columns if c != rank]).alias("row"),
    )
    ranked = rows.where("s is not null and not isnan(s)").withColumn("bucket", score_bucket(F.col("s")))
    hist = ranked.groupBy(*groups, "bucket").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(*groups).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    bars = stored(
        hist.withColumn("above", F.coalesce(F.sum("n").over(down), F.lit(0)))
        .withColumn("rows", F.sum("n").over(Window.partitionBy(*groups)))
        .where(F.col("above") < n)
        .groupBy(*[F.col(g).alias(f"b{g}") for g in groups])
        .agg(F.min("bucket").alias("bar"), F.any_value("rows").alias("rows")),
        "bars",
    )
    on = [F.col(g).eqNullSafe(F.col(f"b{g}")) for g in groups]
    total = bars.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(bars.where(F.col("rows") * HOT >= total))  # HOT rows at most
    large = ranked.join(hot, on).where("bucket >= bar")
    small = ranked.join(hot, on, "left_anti").join(bars.where(F.col("rows") * HOT < total), on).where("bucket >= bar")
    kept = large.unionByName(small)
    order = Window.partitionBy(*groups).orderBy(F.desc("s"), *[F.desc_nulls_last(t) if high else F.asc_nulls_last(t) for t, (_, high) in zip(keys, ties, strict=True)])
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("row.*", F.col("place").alias(rank))

"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import stored


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """`node, component` for every node of an edge: the smallest node it is
    connected with. Large-star and small-star rounds alternate until the edges no
    longer change: O(log^2 n) rounds, each of two aggregations; every round is
    written to the shared folder, and only counts come to the driver. Self-loops
    and repeated edges are allowed, rows with a null end are ignored."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    cur = stored(e.where("u <> v").distinct(), "edges")
    known = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        cur = stored(small, "edges")
        sign = cur.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if sign == known:
            break
        known = sign
    else:
        raise RuntimeError("components did not converge")
    labels = cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return loops.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))

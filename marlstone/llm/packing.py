"""Filling containers of several permitted lengths with whole items.

Items are only told apart by size, so packing works on the histogram of sizes (at
most `capacity` entries, whatever the number of items): take the largest size
left, try every permitted container length that holds it, fill each with the
best-fitting sizes that remain, and open the length of least cost per token;
the pattern is repeated as often as the counts allow, which uses up a size each
time. At last each container is cut down to the shortest permitted length that
holds its contents. Items get their place by rank within their size; ranks come
from counts per (size, bucket), so a size shared by any number of items spreads
over many tasks.

An item longer than the capacity is split into full pieces and a rest, others
never. An item of size 0 (or null) needs no room and is in no container.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import stored

CAPACITY = 2048
LENGTHS = (256, 512, 1024, 2048)
#: Cost of a container besides its length, in tokens.
OPENING_COST = 8.0
BUCKET_ROWS = 200_000


def fill(counts: np.ndarray, first: int, length: int) -> list[int]:
    """Sizes in a container that starts with `first`: each time the largest size
    left that fits the gap."""
    used: dict[int, int] = {first: 1}
    out, gap = [first], length - first
    while gap > 0:
        s = gap
        while True:
            present = np.flatnonzero(counts[1 : s + 1])
            if not len(present):
                return out
            s = int(present[-1]) + 1
            if counts[s] > used.get(s, 0):
                break
            s -= 1
        more = min(gap // s, int(counts[s]) - used.get(s, 0))
        used[s] = used.get(s, 0) + more
        out += [s] * more
        gap -= s * more
    return out


def patterns(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, opening: float = OPENING_COST) -> list[tuple[int, list[int], int]]:
    """(container length, sizes, times): how to fill containers with the items."""
    lengths = tuple(sorted(lengths))
    counts = np.zeros(lengths[-1] + 1, np.int64)
    for s, n in histogram.items():
        counts[s] = n
    out = []
    top = lengths[-1]
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return out
        tried = [(length, fill(counts, top, length)) for length in lengths if length >= top]
        _, sizes = min(tried, key=lambda x: ((x[0] - sum(x[1]) + opening) / sum(x[1]), -x[0]))
        size, per = np.unique(sizes, return_counts=True)
        times = int((counts[size] // per).min())
        counts[size] -= per * times
        held = sum(sizes)
        out.append((next(x for x in lengths if x >= held), sizes, times))


def pieces(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """`key`, piece (from 0), pieces, tokens: items longer than `capacity` in parts."""
    n = F.ceil(F.col(size) / capacity).cast("int")
    parts = items.where(F.col(size) > 0).select(key, F.col(size).alias("_size"), n.alias("pieces"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return parts.select(key, "piece", "pieces", F.least(F.lit(capacity), F.col("_size") - F.col("piece") * capacity).cast("int").alias("tokens"))


def pack(items: DataFrame, key: str, size: str, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """`key`, piece, pieces, tokens, container, length, place (order inside)."""
    capacity = max(lengths)
    parts = stored(pieces(items, key, size, capacity), "pieces")
    total = parts.count()
    buckets = max(8, -(-total // BUCKET_ROWS))
    bucketed = parts.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)).cast("int"))
    counted = stored(bucketed.groupBy("tokens", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    before = Window.partitionBy("tokens").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("tokens", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    histogram = {r["tokens"]: r["n"] for r in counted.groupBy("tokens").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    ranges: dict[int, list[tuple]] = {s: [] for s in histogram}
    at, done = 0, dict.fromkeys(histogram, 0)
    for length, sizes, times in patterns(histogram, lengths):
        place = 0
        for s, per in zip(*np.unique(sizes, return_counts=True), strict=True):
            s, per = int(s), int(per)
            ranges[s].append((done[s], per, at, length, place))
            done[s] += per * times
            place += per
        at += times
    # one row per size (at most `capacity`), its ranges in order of rank: at most one a pattern
    slots = parts.sparkSession.createDataFrame(sorted(ranges.items()), "tokens int, _ranges array<struct<_from:bigint,_per:int,_at:bigint,length:int,_place:int>>")
    here = Window.partitionBy("tokens", "_bucket").orderBy(key, "piece")
    ranked = bucketed.join(F.broadcast(offsets) if buckets * len(histogram) <= 50_000 else offsets, ["tokens", "_bucket"]).withColumn("_rank", F.row_number().over(here) - 1 + F.col("_offset"))
    own = F.element_at("_ranges", F.size(F.filter("_ranges", lambda r: r["_from"] <= F.col("_rank"))))
    placed = ranked.join(F.broadcast(slots), "tokens").select(key, "piece", "pieces", "tokens", "_rank", own.alias("_r"))
    return placed.select(key, "piece", "pieces", "tokens", F.expr("_r._at + (_rank - _r._from) div _r._per").alias("container"), "_r.length", (F.col("_r._place") + F.expr("(_rank - _r._from) % _r._per")).cast("int").alias("place"))

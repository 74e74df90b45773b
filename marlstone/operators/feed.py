"""What a trainer is fed: tensor layout, casts, truncation, shards, schedules."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from marlstone.operators.prefix import Chunks


def hwc_to_chw(values: Column, height: int, width: int, channels: int, scale: float = 255.0) -> Column:
    """A flat height x width x channels list as channels x height x width, each
    value divided by `scale`, by index arithmetic."""
    plane = height * width
    return F.transform(F.sequence(F.lit(0), F.lit(plane * channels - 1)), lambda i: F.get(values, (i % plane) * channels + F.floor(i / plane).cast("int")).cast("double") / scale)


def tensor_to_chw(data: Column, shape: tuple[int, int, int], scale: float = 255.0) -> Column:
    """The same for a uint8 tensor held as binary, with NumPy."""

    @pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else (np.frombuffer(b, np.uint8).reshape(shape).transpose(2, 0, 1).reshape(-1) / scale).astype(np.float32))

    return run(data)


def collate_casts(df: DataFrame, keep: tuple[str, ...] = ("task",)) -> DataFrame:
    """Integers as bigint, booleans as they are, other numbers (and lists of them)
    as float; names in `keep` and strings unchanged."""

    def cast(f: T.StructField) -> Column:
        kind = f.dataType
        if f.name in keep:
            return F.col(f.name)
        if isinstance(kind, T.IntegralType):
            return F.col(f.name).cast("bigint")
        if isinstance(kind, T.FractionalType):
            return F.col(f.name).cast("float")
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FractionalType):
            return F.col(f.name).cast("array<float>")
        return F.col(f.name)

    return df.select(*[cast(f).alias(f.name) for f in df.schema])


def truncated(values: Column, length: int | None) -> Column:
    """The first `length` entries; a length of 0 or None leaves the list alone."""
    return F.slice(values, 1, length) if length else values


def aligned_to_shorter(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def shards(df: DataFrame, key: str, workers: int) -> DataFrame:
    """`df` with `shard`: disjoint, nearly equal, fixed by the key, no global sort."""
    return df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(workers)).cast("int"))


def learning_rate(step: Column, steps: int, warmup: int, peak: float, floor: float = 0.0) -> Column:
    """Linear warm-up to `peak`, then a cosine down to `floor` at `steps`."""
    done = (step - warmup) / max(1, steps - warmup)
    cosine = floor + (peak - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * F.least(done, F.lit(1.0))))
    return F.when(step < warmup, peak * (step + 1) / max(1, warmup)).otherwise(cosine)


def total_steps(rows_per_worker: int, batch: int, accumulate: int, epochs: int) -> int:
    return max(rows_per_worker // (batch * accumulate), 1) * epochs


def piecewise_linear(x: Column, points: list[tuple[float, float]]) -> Column:
    """Whole-numbered value on straight lines between the points; null outside."""
    out = F.when(F.lit(False), F.lit(0))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when((x >= x0) & (x < x1), F.floor(F.lit(y0) + (y1 - y0) * (x - x0) / (x1 - x0)).cast("int"))
    return out


def feature_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, dim, count, mean, std (population) of list columns, by dimension;
    nulls and NaN are left out."""
    out = None
    for name in features:
        one = df.select(F.posexplode(name).alias("dim", "_x")).where("_x is not null and not isnan(_x)").groupBy("dim").agg(F.count("_x").alias("count"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std")).withColumn("feature", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("feature", "dim", "count", "mean", "std")


def batches(df: DataFrame, size: int, collate: Callable[[pd.DataFrame], object] = lambda p: p) -> Iterator[object]:
    """Batches of `size` rows for one consumer, a partition at a time on the driver."""
    held: list[dict] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row.asDict())
        if len(held) == size:
            yield collate(pd.DataFrame(held))
            held = []
    if held:
        yield collate(pd.DataFrame(held))


def worker_batches(df: DataFrame, workers: int, key: str, size: int, consume: Callable[[int, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Each worker's shard, in batches of `size` rows, given to `consume(worker,
    batches)` inside the worker's own task: no row passes through the driver."""
    own = shards(df, key, workers)

    def local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def cut(first: pd.DataFrame, rest: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = first
            for pdf in rest:
                held = pd.concat([held, pdf], ignore_index=True)
                while len(held) >= size:
                    yield held.iloc[:size].drop(columns="shard")
                    held = held.iloc[size:].reset_index(drop=True)
            while len(held):
                yield held.iloc[:size].drop(columns="shard")
                held = held.iloc[size:].reset_index(drop=True)

        parts = (p for p in parts if len(p))
        first = next(parts, None)
        if first is not None:
            yield from consume(int(first["shard"].iloc[0]), cut(first, parts))

    return own.repartitionById(workers, "shard").mapInPandas(local, schema)


def device_rows(rows: int, devices: int) -> int:
    """Rows of a batch that each device gets; a batch that doesn't divide is an error."""
    if devices < 1 or rows % devices:
        raise ValueError(f"a batch of {rows} rows can't be split over {devices} devices")
    return rows // devices


def ordered_batches(df: DataFrame, key: str, size: int, run: Callable[[list], list], value: str, kind: str) -> DataFrame:
    """key, result: a batch function over the rows in lists of `size`, whose
    results keep their key."""
    schema = T.StructType([df.schema[key], T.StructField("result", T._parse_datatype_string(kind))])

    def local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out: list = []
            for i in range(0, len(pdf), size):
                out += run(pdf[value].iloc[i : i + size].tolist())
            yield pd.DataFrame({key: pdf[key], "result": out})

    return df.select(*dict.fromkeys([key, value])).mapInPandas(local, schema)


def evenly(df: DataFrame, order: list[str], groups: int) -> DataFrame:
    """`df` with `task` from 0: `groups` runs in order, sizes differing by one at
    most, larger ones first. Row numbers come from sums per chunk, not one task."""
    numbered = Chunks(df, [], order).sums(_at=F.lit(1)).rows()
    size, more = divmod(numbered.count(), groups)
    r, head = F.col("_at") - 1, more * (size + 1)
    task = F.when(r < head, F.floor(r / (size + 1))).otherwise(more + F.floor((r - head) / max(1, size)))
    return numbered.withColumn("task", task.cast("int")).drop("_at")

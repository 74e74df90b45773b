"""Shared column expressions of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leading or trailing white space of any kind.
OUTER_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def squeezed(c: Column | str) -> Column:
    """Outer white space of any kind removed, lower-cased."""
    return F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, OUTER_SPACE, ""))


def small(df: DataFrame, most: int) -> list:
    """The rows of a table that is small by its meaning; more than `most` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of at most {most} rows is expected here: {df.columns}")
    return rows


def bounded(batches: Iterator[pa.RecordBatch], column: int, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes of text, so that what a kernel
    builds from a slice stays small however long the texts are."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(total // size)) + 1 if len(total) else []
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(start), int(end) - int(start))


def current_clips(stages: DataFrame, *columns: str) -> DataFrame:
    """One row per clip (normalised `video_id`, `clip_index`): the values of
    `columns` in its row with the latest `landed_at` (ties: highest `clip_row`;
    a null `landed_at` loses). Partial maxima run before the shuffle, so a clip
    delivered many times costs one row per task. A row without video or index
    names no clip and is left out."""
    best = F.max(F.struct("landed_at", "clip_row", *columns)).alias("_b")
    keyed = stages.select(squeezed("video_id").alias("video_id"), "clip_index", "landed_at", "clip_row", *columns)
    return (
        keyed.where("video_id is not null and clip_index is not null")
        .groupBy("video_id", "clip_index")
        .agg(best)
        .select("video_id", "clip_index", F.col("_b.clip_row").alias("clip_row"), *[F.col(f"_b.{c}").alias(c) for c in columns])
    )

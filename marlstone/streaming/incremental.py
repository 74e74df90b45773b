"""Cleaning of files as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.functions import text as T
from marlstone.session import shared_dir, track


def stream_clean(spark: SparkSession, source: str, schema: StructType, key: str = "doc_id", text: str = "text", out: str | None = None, state: str | None = None) -> DataFrame:
    """Every file under `source` not yet read goes through cleaning and the length
    filter into the table `out`, whose progress is kept in `state`: a later call, or one
    after a failure, with the same two folders goes on where it stopped. Without them a
    table of the shared folder is made that goes with the driver. Returns the table."""
    if (out is None) != (state is None):
        raise ValueError("out and state belong together")
    if out is None:
        base = track(spark, f"{shared_dir(spark)}/marlstone-stream-{uuid.uuid4().hex}")
        out, state = f"{base}/data", f"{base}/state"
    arriving = spark.readStream.schema(schema).parquet(source)
    clean = arriving.select(key, T.normalize_whitespace(F.col(text)).alias(text)).where(T.length_between(F.col(text)))
    run = clean.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(clean.schema).parquet(out)


def first_seen(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose keys were not seen within `delay` before, by watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)

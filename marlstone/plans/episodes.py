"""Planning of frame reads over episodes, as DataFrame steps.

A root is one dataset (`dataset_index`); rows of a root are numbered by the
running sum of episode lengths in order of `episode_index`. An episode without a
length is unfinished and has no rows yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.components import components
from marlstone.operators.feed import evenly
from marlstone.operators.prefix import running_sum
from marlstone.session import stored

CAMERAS = ["top", "wrist"]


def file_key(camera: str) -> list[str]:
    return [f"videos_{camera}_chunk_index", f"videos_{camera}_file_index"]


FILES = [c for cam in CAMERAS for c in file_key(cam)]


def offsets(episodes: DataFrame) -> DataFrame:
    """Episodes (repeated rows once) with from_index and to_index."""
    once = episodes.distinct().withColumn("_rows", F.coalesce("length", F.lit(0)))
    summed = running_sum(once, ["dataset_index"], ["episode_index"], "_rows", "to_index")
    return summed.withColumn("from_index", F.col("to_index") - F.col("_rows")).drop("_rows")


def gaps(episodes: DataFrame) -> DataFrame:
    """dataset_index, episode_index, previous: episodes that don't follow their
    predecessor in the root."""
    w = Window.partitionBy("dataset_index").orderBy("episode_index")
    before = F.lag("episode_index").over(w)
    return episodes.select("dataset_index", "episode_index").distinct().withColumn("previous", before).where(F.col("episode_index") != F.coalesce(F.col("previous") + 1, F.lit(0)))


def boundaries(episodes: DataFrame, camera: str) -> DataFrame:
    """dataset_index, episode_index, opens: whether the camera's file changes."""
    w = Window.partitionBy("dataset_index").orderBy("episode_index")
    same = [F.col(c).eqNullSafe(F.lag(c).over(w)) for c in file_key(camera)]
    first = F.row_number().over(w) == 1
    return episodes.distinct().select("dataset_index", "episode_index", (first | ~(same[0] & same[1])).alias("opens"))


def sequential(off: DataFrame) -> DataFrame:
    return off.groupBy("dataset_index").agg(F.min("from_index").alias("start"), F.max("to_index").alias("end"))


def by_episode(off: DataFrame) -> DataFrame:
    return off.where("to_index > from_index").select("dataset_index", F.col("from_index").alias("start"), F.col("to_index").alias("end"))


def by_files(off: DataFrame) -> DataFrame:
    """One slice per set of files of all cameras; `adjacent` tells whether the
    episodes of the slice follow one another (a reader must refuse it if not)."""
    g = off.groupBy("dataset_index", *FILES).agg(F.min("from_index").alias("start"), F.max("to_index").alias("end"), F.sum(F.coalesce("length", F.lit(0))).alias("rows"))
    return g.withColumn("adjacent", F.col("end") - F.col("start") == F.col("rows"))


def by_chain(off: DataFrame) -> DataFrame:
    """One slice per component of episodes linked by a shared file of a camera."""
    ids = stored(off.withColumn("_id", F.concat_ws("/", F.lpad(F.col("dataset_index").cast("string"), 10, "0"), F.lpad(F.col("episode_index").cast("string"), 19, "0"))), "ids")
    cams = F.explode(F.array(*[F.struct(F.lit(c).alias("cam"), F.col(file_key(c)[0]).alias("chunk"), F.col(file_key(c)[1]).alias("file")) for c in CAMERAS])).alias("f")
    uses = ids.select("dataset_index", "_id", cams).select("dataset_index", "_id", "f.*").where("chunk is not null and file is not null")
    least = uses.groupBy("dataset_index", "cam", "chunk", "file").agg(F.min("_id").alias("src"))
    found = components(uses.join(least, ["dataset_index", "cam", "chunk", "file"]).select("src", F.col("_id").alias("dst")))
    chain = ids.join(found, ids["_id"] == found["node"], "left").withColumn("_c", F.coalesce("component", "_id"))
    g = chain.groupBy("dataset_index", "_c").agg(F.min("episode_index").alias("chain"), F.count(F.lit(1)).alias("episodes"), F.min("from_index").alias("start"), F.max("to_index").alias("end"), F.sum(F.coalesce("length", F.lit(0))).alias("rows"))
    return g.drop("_c")


def by_blocks(off: DataFrame, rows: int) -> DataFrame:
    total = off.groupBy("dataset_index").agg(F.max("to_index").alias("total")).where("total > 0")
    starts = total.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1, F.lit(rows).cast("bigint"))))
    return starts.select("dataset_index", "start", F.least(F.col("start") + rows, F.col("total")).alias("end"))


def tasks(slices: DataFrame, parallelism: int) -> DataFrame:
    """Slices with `task` from 0, in order, sizes by count differing by one."""
    return evenly(slices, ["dataset_index", "start", "end"], parallelism)


def totals(assigned: DataFrame, row_bytes: int) -> DataFrame:
    """task, slices, rows, bytes (estimated from the size of a row)."""
    rows = F.sum(F.col("end") - F.col("start"))
    return assigned.groupBy("task").agg(F.count(F.lit(1)).alias("slices"), rows.alias("rows"), (rows * row_bytes).alias("bytes"))


def merged(assigned: DataFrame) -> DataFrame:
    """task, dataset_index, start, end: slices of a task that abut become one."""
    w = Window.partitionBy("task", "dataset_index").orderBy("start", "end")
    opens: Column = F.coalesce(F.lag("end").over(w) != F.col("start"), F.lit(True)).cast("int")
    grouped = assigned.withColumn("_o", opens).withColumn("_g", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("task", "dataset_index", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")

"""Registry of the queries over sources, sinks, user functions and the feed, with
their SQL counterparts."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import basics, clips, feed
from marlstone.plans import pipeline
from marlstone.plans.catalog import SPECIAL_OF, SQL_CHAIN, query
from marlstone.session import shared_dir, table, track
from marlstone.sources import files
from marlstone.streaming.incremental import first_seen


def _folder(spark: SparkSession, label: str) -> str:
    return track(spark, f"{shared_dir(spark)}/marlstone-{label}-{uuid.uuid4().hex}")


# ---- sources and sinks ---------------------------------------------------


@query("SELECT event_id, value FROM events")
def parquet_scan(spark: SparkSession, d: str) -> DataFrame:
    """Only two columns reach the scan; at most two readers at once."""
    return files.parquet(spark, f"{d}/events.parquet", ["event_id", "value"], readers=2)


@query("SELECT event_id, user_id, event_type FROM events")
def own_output(spark: SparkSession, d: str) -> DataFrame:
    """Written into a folder named by the time and read again."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return spark.read.schema(rows.schema).parquet(files.write_stamped(rows, _folder(spark, "out")))


@query("SELECT n_nationkey, n_name, n_regionkey, 1 AS files FROM nation")
def single_file(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    back = spark.read.schema(rows.schema).parquet(files.write_stamped(rows, _folder(spark, "out"), single=True))
    return back.withColumn("files", F.lit(len(back.inputFiles())))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_with_schema(spark: SparkSession, d: str) -> DataFrame:
    rows, path = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), _folder(spark, "csv")
    rows.write.csv(path, header=True)
    return files.csv(spark, path, rows.schema)


@query("SELECT count(*) AS rows, (SELECT count(*) FROM (DESCRIBE region))::INTEGER AS columns FROM region")
def parquet_inspection(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/region.parquet"
    parts = [os.path.join(path, p) for p in sorted(os.listdir(path)) if p.endswith(".parquet")] if os.path.isdir(path) else [path]
    found = [files.inspect(p) for p in parts]
    return spark.createDataFrame([(sum(f["rows"] for f in found), found[0]["columns"])], "rows bigint, columns int")


@query("SELECT ceil(count(*) / 1000.0)::BIGINT AS blocks, count(*) AS rows FROM events")
def rows_per_block(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of about 1,000 rows: number of blocks, rows in them."""
    rows = table(spark, d, "events").select("event_id")
    blocks = basics.rows_per_block(rows, 1000, rows.count()).groupBy(F.spark_partition_id().alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("rows"))


@query("SELECT 'known' AS kind, 500::BIGINT AS prompts, 500::BIGINT AS ids")
def prompt_list(spark: SparkSession, d: str) -> DataFrame:
    texts = ["a harbour at dawn", "a workshop", "rain on a roof"]
    kind = F.when(F.col("prompt").isin(*texts), "known").otherwise("other").alias("kind")
    return files.prompts(spark, texts, 500, 7).groupBy(kind).agg(F.count(F.lit(1)).alias("prompts"), F.countDistinct("id").alias("ids"))


@query("SELECT 4::INTEGER AS dims, 2000::BIGINT AS rows, true AS near")
def regression_batch(spark: SparkSession, d: str) -> DataFrame:
    """Whether y is x . (0, 1, ...) + 0.5 up to its noise, in every row."""
    dot = F.aggregate(F.transform("x", lambda v, i: v * i), F.lit(0.0), lambda acc, v: acc + v)
    return files.regression_rows(spark, 2000, 4, 11).groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("rows"), (F.max(F.abs(F.col("y") - dot - 0.5)) < 0.8).alias("near"))


# ---- user functions ------------------------------------------------------


def _outcome(url: str) -> tuple[int, bytes]:
    kind = int(url[-1])
    if kind == 9:
        raise TimeoutError
    return (404, b"") if kind >= 7 else (200, url.encode())


SQL_FETCH = """
WITH u AS (SELECT event_id, 'http://host/' || event_id AS url, event_id % 10 AS k FROM events),
f AS (SELECT event_id, CASE WHEN k = 9 THEN 'error_TimeoutError' WHEN k >= 7 THEN 'http_404' ELSE 'success' END AS status, CASE WHEN k < 7 THEN length(url) END::INTEGER AS size FROM u)"""


def _fetched(spark: SparkSession, d: str) -> DataFrame:
    urls = table(spark, d, "events").select("event_id", F.concat(F.lit("http://host/"), F.col("event_id").cast("string")).alias("url"))
    return clips.fetch_urls(urls, "url", _outcome, 4)


@query(f"{SQL_FETCH} SELECT * FROM f")
def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Status and size per address; a stand-in answers."""
    return _fetched(spark, d).select("event_id", "status", F.length("bytes").alias("size"))


@query(f"{SQL_FETCH} SELECT event_id FROM f WHERE status = 'success' AND size IS NOT NULL")
def fetched_only(spark: SparkSession, d: str) -> DataFrame:
    return _fetched(spark, d).where("status = 'success' and bytes is not null").select("event_id")


def _picky(data: bytes) -> bytes:
    if data[:1] in b"01234":
        raise ValueError
    return data.upper()


@query("SELECT clip_row, CASE WHEN video_id <> '' AND substr(video_id, 1, 1) NOT IN ('0', '1', '2', '3', '4') THEN upper(video_id) END AS decoded FROM stages")
def error_to_null(spark: SparkSession, d: str) -> DataFrame:
    """What a codec refuses becomes null; a stand-in refuses some ids."""
    return table(spark, d, "stages").select("clip_row", clips.decode_images(F.col("video_id").cast("binary"), _picky).cast("string").alias("decoded"))


def _load():  # noqa: ANN202
    return lambda batch: [f"clip {x.strip().lower()}: {len(x)}" for x in batch]


@query("SELECT clip_row, 'clip ' || lower(s) || ': ' || length(s) AS caption FROM (SELECT clip_row, clip_row::VARCHAR AS s FROM stages)")
def caption_stage(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a model loaded once per worker; a stand-in answers."""
    return table(spark, d, "stages").select("clip_row", clips.describe_clips(F.col("clip_row").cast("string"), _load, 32).alias("caption"))


@query("SELECT clip_row, 2 AS turns, 'system' AS first_role, 'Describe the clip.' AS prompt, length(video_id)::INTEGER AS image_bytes, 0.1::DOUBLE AS temperature, 200 AS max_tokens FROM stages")
def model_request(spark: SparkSession, d: str) -> DataFrame:
    request = clips.reply_request("Answer in JSON.", "Describe the clip.", F.col("video_id").cast("binary"))
    made = table(spark, d, "stages").select("clip_row", request.alias("r"))
    turns = F.col("r.messages")
    return made.select("clip_row", F.size(turns).alias("turns"), turns[0]["role"].alias("first_role"), turns[1]["text"].alias("prompt"), F.length(turns[1]["image"]).alias("image_bytes"), "r.sampling.temperature", "r.sampling.max_tokens")


@query("SELECT event_id, 2 * value + 1 AS result FROM events")
def batch_map(spark: SparkSession, d: str) -> DataFrame:
    """A batch function over lists of values; results keep their key."""
    return feed.ordered_batches(table(spark, d, "events").select("event_id", "value"), "event_id", 100, lambda xs: [2 * x + 1 for x in xs], "value", "double")


@query("SELECT event_id, value * 3 + 2 AS scaled FROM events")
def map_with_arguments(spark: SparkSession, d: str) -> DataFrame:
    affine = lambda c, factor, offset: c * factor + offset
    return table(spark, d, "events").select("event_id", affine(F.col("value"), factor=3, offset=2).alias("scaled"))


@query('SELECT "index" FROM lerobot_datasource WHERE state IS NOT NULL')
def not_null(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lerobot_datasource").where("state is not null").select("index")


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events")
def date_stamp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"))


# ---- feed ----------------------------------------------------------------


@query("SELECT 4::BIGINT AS workers, count(*) AS rows, true AS even FROM events")
def shard_rows(spark: SparkSession, d: str) -> DataFrame:
    """Disjoint shards that cover all rows, none far from a fourth of them."""
    per = feed.shards(table(spark, d, "events").select("event_id"), "event_id", 4).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("workers"), F.sum("n").alias("rows"), (F.max("n") < F.sum("n") / 4 * 1.25).alias("even"))


def _count(worker: int, batches):  # noqa: ANN001, ANN202
    for b in batches:
        yield pd.DataFrame({"worker": [worker], "n": [len(b)], "total": [float(b["event_id"].sum())]})


@query("SELECT count(*) AS rows, sum(event_id)::DOUBLE AS total, 50::INTEGER AS largest FROM events")
def worker_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 50 rows that three workers consumed in their own tasks."""
    seen = feed.worker_batches(table(spark, d, "events").select("event_id"), 3, "event_id", 50, _count, "worker int, n int, total double")
    return seen.agg(F.sum("n").alias("rows"), F.sum("total").alias("total"), F.max("n").alias("largest"))


@query('SELECT "index", list_slice(state, 1, least(len(state), len(action))) AS state, list_slice(action, 1, least(len(state), len(action))) AS action FROM lerobot_datasource WHERE state IS NOT NULL AND action IS NOT NULL')
def mask_alignment(spark: SparkSession, d: str) -> DataFrame:
    a, b = feed.aligned_to_shorter(F.col("state"), F.col("action"))
    return table(spark, d, "lerobot_datasource").where("state is not null and action is not null").select("index", a.alias("state"), b.alias("action"))


@query("SELECT user_id % 5 AS epoch, round(avg(value), 9) AS mean FROM events GROUP BY 1")
def epoch_mean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("epoch")).agg(F.round(F.avg("value"), 9).alias("mean"))


@query("SELECT vec_id, list_transform(range(64), lambda i: round(greatest(0, least(255, floor(128 + 400 * embedding[(i % 16) * 4 + i // 16 + 1]::DOUBLE))) / 255, 5)) AS chw FROM embeddings")
def tensor_layout(spark: SparkSession, d: str) -> DataFrame:
    """A 4 x 4 x 4 tensor held as binary, channels first."""
    px = F.transform("embedding", lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * x.cast("double")))).cast("int")), 2, "0"))
    chw = feed.tensor_to_chw(F.unhex(F.array_join(px, "")), (4, 4, 4))
    return table(spark, d, "embeddings").select("vec_id", F.transform(chw, lambda v: F.round(v.cast("double"), 5)).alias("chw"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def first_seen_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys not seen before in a stream, by watermark."""
    schema, out = table(spark, d, "events").schema, _folder(spark, "seen")
    arriving = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    seen = first_seen(arriving, ["user_id", "event_type"], "ts", "36500 days").select("user_id", "event_type")
    run = seen.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(seen.schema).parquet(f"{out}/data")


# ---- text ----------------------------------------------------------------


@query(f"{SQL_CHAIN} SELECT doc_id, t AS text FROM chain WHERE length(t) BETWEEN 50 AND 10000 AND {SPECIAL_OF('t')} <= 0.25")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    """The mappers of the default pipeline and two of its filters."""
    steps = [{n: {}} for n in ("clean_html", "clean_links", "clean_email", "normalize_whitespace", "fix_unicode", "text_length", "special_characters")]
    return pipeline.run(table(spark, d, "documents").select("doc_id", "text"), steps)

"""Registry of the core queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import basics, clips, feed, temporal
from marlstone.operators.dedup import duplicate_classes
from marlstone.plans import episodes as E
from marlstone.plans import pipeline
from marlstone.session import spread, stored, table
from marlstone.streaming.incremental import stream_clean

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- text ----------------------------------------------------------------


def _sql_html(c: str) -> str:
    out = f"regexp_replace({c}, '{T.HTML}', '', 'g')"
    for entity, char in T.ENTITIES.items():
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return out


SQL_SPACE = f"trim(regexp_replace(text, '{T.SPACES}', ' ', 'g'))"


def _sql_ratio(c: str, pattern: str) -> str:
    return f"length(regexp_replace({c}, '{pattern}', '', 'g')) / nullif(length({c}), 0)"


ALNUM, SPECIAL = _sql_ratio("text", T.NOT_ALNUM), _sql_ratio("text", T.ORDINARY)


def SPECIAL_OF(c: str) -> str:  # noqa: N802
    return _sql_ratio(c, T.ORDINARY)


SQL_CHAIN = f"""
WITH a AS (SELECT doc_id, {_sql_html("text")} AS t FROM documents), b AS (SELECT doc_id, regexp_replace(t, '{T.LINKS}', '', 'g') AS t FROM a), c AS (SELECT doc_id, regexp_replace(t, '{T.EMAILS}', '', 'g') AS t FROM b),
chain AS (SELECT doc_id, nfc_normalize(trim(regexp_replace(t, '{T.SPACES}', ' ', 'g'))) AS t FROM c)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"""
WITH clean AS (SELECT lang, {SQL_SPACE} AS t FROM documents),
kept AS (SELECT lang, length(t) AS n, {_sql_ratio("t", T.NOT_ALNUM)} AS a FROM clean WHERE length(t) BETWEEN 50 AND 10000)
SELECT lang, count(*) AS docs, round(avg(n), 6) AS avg_chars, round(avg(a), 6) AS avg_alnum FROM kept WHERE a BETWEEN 0.6 AND 0.95 GROUP BY lang""")
def text_profile(spark: SparkSession, d: str) -> DataFrame:
    clean = _docs(spark, d).select("lang", T.normalize_whitespace(F.col("text")).alias("t"))
    kept = clean.where(T.length_between(F.col("t"))).withColumn("a", T.alnum_ratio(F.col("t"))).where(F.col("a").between(0.6, 0.95))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg(F.length("t")), 6).alias("avg_chars"), F.round(F.avg("a"), 6).alias("avg_alnum"))


def _mapper(name: str, sql: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return _docs(spark, d).select("doc_id", pipeline.MAPPERS[name](F.col("text")).alias("text"))

    QUERIES[name] = f
    ORACLES[name] = f"SELECT doc_id, {sql} AS text FROM documents"


_mapper("clean_html", _sql_html("text"))
_mapper("clean_links", f"regexp_replace(text, '{T.LINKS}', '', 'g')")
_mapper("clean_email", f"regexp_replace(text, '{T.EMAILS}', '', 'g')")
_mapper("normalize_whitespace", SQL_SPACE)
_mapper("fix_unicode", "nfc_normalize(text)")


@query()
def fix_mojibake(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.fix_mojibake(F.col("text")).alias("text"))


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 50 AND 10000")
def text_length(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(T.length_between(F.col("text"))).select("doc_id")


@query(f"SELECT doc_id, round({ALNUM}, 9) AS ratio FROM documents WHERE {ALNUM} BETWEEN 0.6 AND 0.95")
def alnum_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.alnum_ratio(F.col("text")).alias("r")).where(F.col("r").between(0.6, 0.95)).select("doc_id", F.round("r", 9).alias("ratio"))


@query(f"SELECT doc_id, round({SPECIAL}, 9) AS ratio FROM documents WHERE {SPECIAL} <= 0.25")
def special_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.special_ratio(F.col("text")).alias("r")).where("r <= 0.25").select("doc_id", F.round("r", 9).alias("ratio"))


@query("""
WITH chars AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents WHERE text IS NOT NULL),
grams AS (SELECT doc_id, array_to_string(c[i:i + 9], '') AS g FROM (SELECT doc_id, c, unnest(range(1, len(c) - 8)) AS i FROM chars WHERE len(c) >= 10)),
counted AS (SELECT doc_id, g, count(*) AS n FROM grams GROUP BY ALL),
ranked AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r, count(*) OVER (PARTITION BY doc_id) AS kinds,
  count(*) FILTER (n = 1) OVER (PARTITION BY doc_id) AS single, sum(n) OVER (PARTITION BY doc_id) AS total FROM counted)
SELECT doc_id, round(coalesce(r.ratio, 0), 9) AS ratio FROM chars LEFT JOIN
  (SELECT doc_id, sum(CASE WHEN r <= least(floor(sqrt(kinds)), kinds - single) THEN n ELSE 0 END) / any_value(total) AS ratio FROM ranked GROUP BY doc_id) r USING (doc_id)""")
def char_repetition(spark: SparkSession, d: str) -> DataFrame:
    return spread(_docs(spark, d)).where("text is not null").select("doc_id", F.round(T.char_repetition(F.col("text"), 10), 9).alias("ratio"))


@query()
def minhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a text and the least id of its class."""
    return duplicate_classes(_docs(spark, d), "doc_id", "text")


@query()
def text_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Cleaning, filters and near-duplicate removal in their default order."""
    return pipeline.run(_docs(spark, d).select("doc_id", "lang", "source", "text"), pipeline.DEFAULT)


@query(f"SELECT doc_id, {SQL_SPACE} AS text FROM documents WHERE length({SQL_SPACE}) BETWEEN 50 AND 10000")
def stream_text(spark: SparkSession, d: str) -> DataFrame:
    """Incremental cleaning of arriving files with Structured Streaming."""
    return stream_clean(spark, f"{d}/documents.parquet*", table(spark, d, "documents").schema)


# ---- relational basics ---------------------------------------------------


@query("""
SELECT 'l_quantity' AS "column", count(l_quantity)::DOUBLE AS count, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS stddev, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(l_extendedprice)::DOUBLE, round(avg(l_extendedprice), 6), round(stddev_samp(l_extendedprice), 6), min(l_extendedprice), max(l_extendedprice) FROM lineitem""")
def describe_numeric(spark: SparkSession, d: str) -> DataFrame:
    out = basics.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").count()


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS unit_price FROM lineitem")
def ratio_column(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", basics.ratio("l_extendedprice", "l_quantity").alias("unit_price"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 35")
def filter_gt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_quantity > 35").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT event_id, ts, value FROM events ORDER BY event_id LIMIT 100")
def limit_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 events by id: the limit is the operator."""
    return table(spark, d, "events").orderBy("event_id").limit(100).select("event_id", "ts", "value")


@query("SELECT event_id AS id, user_id AS actor, value FROM events")
def rename_drop(spark: SparkSession, d: str) -> DataFrame:
    return basics.rename(table(spark, d, "events"), {"event_id": "id", "user_id": "actor", "absent": "x"}).drop("props", "ts", "event_type")


@query("SELECT i AS id, i * i AS square FROM range(100) t(i)")
def square_map(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(100).select("id", (F.col("id") * F.col("id")).alias("square"))


@query("SELECT DISTINCT event_type, user_id FROM events")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type", "user_id").distinct()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(big, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS orders
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02 00:00:00'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("orders"))


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# ---- episodes ------------------------------------------------------------

SQL_EPS = """
WITH eps AS (SELECT DISTINCT * FROM episodes),
off AS (SELECT *, (t - coalesce(length, 0))::BIGINT AS from_index, t AS to_index FROM (SELECT *, sum(coalesce(length, 0)) OVER (PARTITION BY dataset_index ORDER BY episode_index)::BIGINT AS t FROM eps))"""
SQL_SLICES = SQL_EPS + """,
slices AS (SELECT dataset_index, from_index AS start, to_index AS "end" FROM off WHERE to_index > from_index),
assigned AS (SELECT *, (ntile(8) OVER (ORDER BY dataset_index, start, "end") - 1)::INTEGER AS task FROM slices)"""


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    return E.offsets(table(spark, d, "episodes"))


@query(f"{SQL_EPS} SELECT dataset_index, episode_index, from_index, to_index FROM off")
def episode_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _offsets(spark, d).select("dataset_index", "episode_index", "from_index", "to_index")


@query("""
WITH eps AS (SELECT DISTINCT dataset_index, episode_index FROM episodes), p AS (SELECT *, lag(episode_index) OVER (PARTITION BY dataset_index ORDER BY episode_index) AS previous FROM eps)
SELECT * FROM p WHERE episode_index <> coalesce(previous + 1, 0)""")
def contiguity(spark: SparkSession, d: str) -> DataFrame:
    return E.gaps(table(spark, d, "episodes"))


@query("""
WITH eps AS (SELECT DISTINCT * FROM episodes)
SELECT dataset_index, episode_index, coalesce(videos_top_chunk_index IS DISTINCT FROM lag(videos_top_chunk_index) OVER w OR videos_top_file_index IS DISTINCT FROM lag(videos_top_file_index) OVER w, true) OR row_number() OVER w = 1 AS opens
FROM eps WINDOW w AS (PARTITION BY dataset_index ORDER BY episode_index)""")
def segment_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return E.boundaries(table(spark, d, "episodes"), "top")


@query(f'{SQL_EPS} SELECT dataset_index, min(from_index) AS start, max(to_index) AS "end" FROM off GROUP BY 1')
def part_sequential(spark: SparkSession, d: str) -> DataFrame:
    return E.sequential(_offsets(spark, d))


@query(f'{SQL_SLICES} SELECT * FROM slices')
def part_episode(spark: SparkSession, d: str) -> DataFrame:
    return E.by_episode(_offsets(spark, d))


@query(f"""{SQL_EPS}, g AS (SELECT dataset_index, videos_top_chunk_index, videos_top_file_index, videos_wrist_chunk_index, videos_wrist_file_index,
  min(from_index) AS start, max(to_index) AS "end", sum(coalesce(length, 0))::BIGINT AS rows FROM off GROUP BY ALL) SELECT *, "end" - start = rows AS adjacent FROM g""")
def part_file_group(spark: SparkSession, d: str) -> DataFrame:
    return E.by_files(_offsets(spark, d))


@query(f"""{SQL_EPS.replace("WITH", "WITH RECURSIVE")},
uses AS (SELECT dataset_index AS ds, episode_index AS e, 'top' AS cam, videos_top_chunk_index AS c, videos_top_file_index AS f FROM eps UNION ALL SELECT dataset_index, episode_index, 'wrist', videos_wrist_chunk_index, videos_wrist_file_index FROM eps),
links AS (SELECT DISTINCT a.ds, a.e AS x, b.e AS y FROM uses a JOIN uses b ON a.ds = b.ds AND a.cam = b.cam AND a.c = b.c AND a.f = b.f),
reach AS (SELECT ds, x, x AS y FROM links UNION SELECT r.ds, r.x, l.y FROM reach r JOIN links l ON r.ds = l.ds AND r.y = l.x),
label AS (SELECT ds, x, min(y) AS chain FROM reach GROUP BY ALL)
SELECT dataset_index, chain, count(*) AS episodes, min(from_index) AS start, max(to_index) AS "end", sum(coalesce(length, 0))::BIGINT AS rows FROM off JOIN label ON ds = dataset_index AND x = episode_index GROUP BY 1, 2""")
def part_chain(spark: SparkSession, d: str) -> DataFrame:
    return E.by_chain(_offsets(spark, d))


@query(f"""{SQL_EPS}, total AS (SELECT dataset_index, max(to_index) AS total FROM off GROUP BY 1)
SELECT dataset_index, start, least(start + 1000, total)::BIGINT AS "end" FROM (SELECT dataset_index, total, unnest(range(0, total, 1000)) AS start FROM total WHERE total > 0)""")
def part_row_block(spark: SparkSession, d: str) -> DataFrame:
    return E.by_blocks(_offsets(spark, d), 1000)


@query(f'{SQL_SLICES} SELECT task, count(*) AS slices, sum("end" - start)::BIGINT AS rows, sum("end" - start)::BIGINT * 64 AS bytes FROM assigned GROUP BY task')
def plan_ntile(spark: SparkSession, d: str) -> DataFrame:
    """Slices, rows and estimated bytes of each task; a row of these tables has 64."""
    return E.totals(E.tasks(E.by_episode(_offsets(spark, d)), 8), 64)


@query(f"""{SQL_SLICES}, marked AS (SELECT *, CASE WHEN lag("end") OVER w = start THEN 0 ELSE 1 END AS o FROM assigned WINDOW w AS (PARTITION BY task, dataset_index ORDER BY start, "end")),
grouped AS (SELECT *, sum(o) OVER (PARTITION BY task, dataset_index ORDER BY start, "end") AS g FROM marked)
SELECT task, dataset_index, min(start) AS start, max("end") AS "end" FROM grouped GROUP BY task, dataset_index, g""")
def merge_segments(spark: SparkSession, d: str) -> DataFrame:
    return E.merged(E.tasks(E.by_episode(_offsets(spark, d)), 8))


@query("SELECT root, episode_index, length FROM (SELECT 0 AS root, * FROM (SELECT DISTINCT * FROM episodes) UNION ALL SELECT 1, * FROM (SELECT DISTINCT * FROM episodes))")
def multi_root_union(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "episodes").distinct()
    return one.withColumn("root", F.lit(0)).unionByName(one.withColumn("root", F.lit(1))).select("root", "episode_index", "length")


@query('SELECT "index", episode_index, frame_index, l.task_index, task FROM lerobot_datasource l LEFT JOIN tasks t ON l.task_index = t.task_index')
def task_join(spark: SparkSession, d: str) -> DataFrame:
    """Lookup of the task text: an index that isn't in the table is an error."""
    rows = table(spark, d, "lerobot_datasource").select("index", "episode_index", "frame_index", "task_index")
    return basics.looked_up(rows, table(spark, d, "tasks"), "task_index", "task")


@query(f"""{SQL_EPS}, total AS (SELECT dataset_index, max(to_index) AS total FROM off GROUP BY 1),
blocks AS (SELECT dataset_index, start, least(start + 1000, total)::BIGINT AS "end" FROM (SELECT dataset_index, total, unnest(range(0, total, 1000)) AS start FROM total WHERE total > 0))
SELECT b.dataset_index, start, "end", episode_index FROM blocks b JOIN off o ON b.dataset_index = o.dataset_index AND from_index < "end" AND to_index > start WHERE to_index > from_index""")
def range_overlap(spark: SparkSession, d: str) -> DataFrame:
    off = _offsets(spark, d).select("dataset_index", "episode_index", "from_index", "to_index")
    return temporal.range_overlap(E.by_blocks(off, 1000), off, ["dataset_index"], ("start", "end"), ("from_index", "to_index"), 1000).select("dataset_index", "start", "end", "episode_index")


@query("""
WITH want AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type <> 'purchase'),
frames AS (SELECT user_id, epoch_us(ts) / 1e6 AS ft, event_id AS frame_id FROM events WHERE event_type = 'purchase')
SELECT event_id, w.user_id, round(ft, 6) AS frame_time, frame_id FROM want w ASOF LEFT JOIN frames f ON w.user_id = f.user_id AND w.t - 0.5 <= f.ft""")
def asof_frame(spark: SparkSession, d: str) -> DataFrame:
    """For each event the user's next purchase, half a second of slack allowed."""
    t = table(spark, d, "events").select("event_id", "user_id", "event_type", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6).alias("t"))
    frames = t.where("event_type = 'purchase'").select("user_id", F.col("t").alias("ft"), F.col("event_id").alias("frame_id"))
    out = temporal.asof_forward(t.where("event_type <> 'purchase'").drop("event_type"), frames, ["user_id"], "t", "ft", 0.5, ["frame_id"])
    return out.select("event_id", "user_id", F.round("frame_time", 6).alias("frame_time"), "frame_id")


@query("""
WITH x AS (SELECT 'state' AS feature, i - 1 AS dim, state[i]::DOUBLE AS v FROM lerobot_datasource, range(1, 5) r(i) UNION ALL SELECT 'action', i - 1, action[i]::DOUBLE FROM lerobot_datasource, range(1, 3) r(i))
SELECT feature, dim::INTEGER AS dim, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM x WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL""")
def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lerobot_datasource").select(F.col("state").cast("array<double>").alias("state"), F.col("action").cast("array<double>").alias("action"))
    return feed.feature_stats(rows, ["state", "action"]).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


# ---- clips ---------------------------------------------------------------


@query("""
WITH n AS (SELECT user_id, row_number() OVER w - 1 AS n, coalesce(abs(value - lag(value) OVER w) > 60, true)::INT AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY n) - 1 AS clip_index FROM n)
SELECT user_id, clip_index::BIGINT AS clip_index, min(n) AS start_frame, max(n) + 1 AS end_frame, max(n) + 1 - min(n) AS clip_num_frames FROM s GROUP BY user_id, clip_index HAVING max(n) + 1 - min(n) >= 5""")
def scene_clips(spark: SparkSession, d: str) -> DataFrame:
    return clips.scene_clips(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value", 60.0, 5)


@query("""
SELECT clip_row, CASE WHEN k <= 1 THEN [start_frame] ELSE list_transform(range(k), lambda i: floor(start_frame + i * ((end_frame - 1 - start_frame) / (k - 1)))::BIGINT) END AS frames
FROM (SELECT *, least(3, greatest(clip_num_frames, 1)) AS k FROM stages)""")
def keyframe_indices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stages").select("clip_row", clips.keyframes(F.col("start_frame"), F.col("end_frame"), F.col("end_frame"), 3).alias("frames"))


@query("""
SELECT clip_row, coalesce(nullif(fps, 0), 30.0) AS rate, least((start_frame + end_frame) // 2, end_frame - 1)::BIGINT AS mid, round(start_frame / coalesce(nullif(fps, 0), 30.0), 6) AS start_at,
  substr(sha1(video_id), 1, 12) AS own_id, list_sort(list_distinct([start_frame, least((start_frame + end_frame) // 2, end_frame - 1), end_frame - 1])) AS needed FROM stages""")
def clip_times(spark: SparkSession, d: str) -> DataFrame:
    """Rate, middle frame, start in seconds, id from content and frames to fetch."""
    start, end, rate = F.col("start_frame"), F.col("end_frame"), clips.frame_rate(F.col("fps"))
    mid = clips.mid_frame(start, end, end)
    return table(spark, d, "stages").select("clip_row", rate.alias("rate"), mid.alias("mid"), F.round(start / rate, 6).alias("start_at"), clips.video_id(F.col("video_id").cast("binary")).alias("own_id"), clips.fetch_list(F.array(start, mid), F.array(end - 1)).alias("needed"))


@query('SELECT "index", episode_index, frame_index FROM lerobot_datasource WHERE frame_index % 20 = 0')
def frame_sampling(spark: SparkSession, d: str) -> DataFrame:
    """Every 20th frame of an episode: the stride is the operator."""
    return table(spark, d, "lerobot_datasource").where(clips.sampled(F.col("frame_index"))).select("index", "episode_index", "frame_index")


@query("""
WITH h AS (SELECT label, vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS h FROM embeddings),
w AS (SELECT *, lag(h) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM h)
SELECT label, vec_id, b IS NULL OR coalesce(sqrt(greatest(0, 1 - list_sum(list_transform(list_zip(b, h), lambda z: sqrt(z[1] * z[2]))) / sqrt(list_sum(b) * list_sum(h)))) > 0.35, false) AS opens FROM w""")
def histogram_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Scene cuts by histogram distance; magnitudes of embeddings stand in."""
    frames = table(spark, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("h"))
    return clips.histogram_clips(frames, "label", ["vec_id"], "h", 0.35)


@query("""
SELECT o_orderkey AS key, o_totalprice AS size FROM orders WHERE NOT EXISTS (SELECT 1 FROM (SELECT l_orderkey, max(l_extendedprice) AS p FROM lineitem GROUP BY 1) WHERE l_orderkey = o_orderkey AND p = o_totalprice)""")
def missing_or_changed(spark: SparkSession, d: str) -> DataFrame:
    """Listing difference by key and size."""
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("size"))
    present = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_extendedprice").alias("size"))
    return basics.missing_or_changed(wanted, present, "key", "size")


@query("SELECT clip_row, video_id, clip_index, fps, width, height FROM stages")
def pass_through(spark: SparkSession, d: str) -> DataFrame:
    return basics.pass_through(table(spark, d, "stages"), ["clip_row", "video_id", "absent", "clip_index", "fps", "width", "height"])


@query("SELECT user_id, event_type FROM events WHERE value > 50 EXCEPT SELECT user_id, event_type FROM events WHERE value < 10")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where("value > 50").select("user_id", "event_type").subtract(e.where("value < 10").select("user_id", "event_type"))


@query("""
SELECT clip_row FROM stages WHERE clip_duration_sec >= 1.0 AND brightness BETWEEN 30 AND 240 AND contrast >= 20 AND sharpness >= 50 AND motion_score >= 0.5
  AND NOT isnan(clip_duration_sec) AND NOT isnan(brightness) AND NOT isnan(contrast) AND NOT isnan(sharpness) AND NOT isnan(motion_score)""")
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stages").where(clips.good_quality()).select("clip_row")


@query("SELECT * FROM (SELECT clip_row, video_id, clip_index, category FROM stages WHERE is_safe)")
def safe_clips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stages").where("is_safe").select("clip_row", "video_id", "clip_index", "category")


SQL_OUTER = r"'^[\s\p{Z}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{1c}-\x{1f}\x{85}]+$', '', 'g'"


@query(f"""
WITH given AS (SELECT clip_row, coalesce(vlm_description, '') AS g FROM stages UNION ALL
  SELECT -clip_row, '```json' || chr(10) || '{{"category": "news", "description": "a ``` fence in row ' || clip_row || '", "is_safe": false}}' || chr(10) || '``` ' FROM stages),
b AS (SELECT *, regexp_replace(g, {SQL_OUTER}) AS t FROM given),
opened AS (SELECT *, CASE WHEN starts_with(t, '```') THEN regexp_replace(t, '^```[^\n{{ ]*[\n ]?', '') END AS o FROM b),
bare AS (SELECT clip_row, g, CASE WHEN o IS NULL THEN t WHEN contains(o, '```') THEN regexp_replace(substr(o, 1, length(o) - strpos(reverse(o), '```') - 2), {SQL_OUTER}) ELSE regexp_replace(o, {SQL_OUTER}) END AS t FROM opened),
parsed AS (SELECT clip_row, g, CASE WHEN starts_with(t, '{{') AND json_valid(t) THEN t::JSON END AS j FROM bare)
SELECT clip_row, coalesce(CASE WHEN j IS NOT NULL THEN j ->> 'category' END, 'other') AS category,
  coalesce(CASE WHEN lower(j ->> 'is_safe') IN ('true', 'false') THEN lower(j ->> 'is_safe') = 'true' END, true) AS is_safe,
  CASE WHEN j IS NOT NULL THEN coalesce(j ->> 'description', '') ELSE substr(g, 1, 200) END AS description, coalesce(j ->> 'visual_quality', 'medium') AS quality
FROM parsed""")
def vlm_parse(spark: SparkSession, d: str) -> DataFrame:
    """Replies as stored, and one with a fence inside its description per row."""
    rows = table(spark, d, "stages").select("clip_row", "vlm_description")
    fenced = F.concat(F.lit('```json\n{"category": "news", "description": "a ``` fence in row '), F.col("clip_row").cast("string"), F.lit('", "is_safe": false}\n``` '))
    every = rows.unionByName(rows.select((-F.col("clip_row")).alias("clip_row"), fenced.alias("vlm_description")))
    return every.select("clip_row", clips.parsed_reply(F.col("vlm_description")).alias("r")).select("clip_row", "r.*")


@query(f"""
WITH c AS (SELECT clip_row, lower(regexp_replace(category, {SQL_OUTER})) AS c FROM stages)
SELECT clip_row, CASE WHEN c IN ({", ".join(f"'{x}'" for x in clips.CATEGORIES)}) THEN c ELSE 'other' END AS category FROM c""")
def category_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stages").select("clip_row", clips.known_category(F.col("category")).alias("category"))


@query("""
WITH u AS (SELECT label, i, embedding[i]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS v FROM embeddings, range(1, 65) r(i) WHERE embedding IS NOT NULL),
m AS (SELECT label, i, round(avg(v), 6) AS v FROM u WHERE v IS NOT NULL GROUP BY ALL)
SELECT label, list(v ORDER BY i) AS embedding FROM m GROUP BY label UNION ALL SELECT -1, list_transform(range(64), lambda i: 0.0::DOUBLE)""")
def embed_pool(spark: SparkSession, d: str) -> DataFrame:
    """Mean unit vectors by label; label -1 is a clip without keyframes."""
    rows = table(spark, d, "embeddings").select("label", "embedding")
    empty = rows.limit(1).select(F.lit(-1).cast(rows.schema["label"].dataType).alias("label"), F.lit(None).cast(rows.schema["embedding"].dataType).alias("embedding"))
    return clips.pooled_embedding(rows.unionByName(empty), "label", "embedding", 64, 6)


# 64 numbers of an embedding stand in for a gray picture of 8 x 8 pixels


def _mirrored(i: int, n: int = 8) -> int:
    return -i if i < 0 else 2 * n - 2 - i if i >= n else i


def _neighbour(dy: int, dx: int) -> str:
    return str([_mirrored(p // 8 + dy) * 8 + _mirrored(p % 8 + dx) + 1 for p in range(64)])


SQL_FRAMES = """
frames AS (SELECT label AS video, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: greatest(0, least(255, floor(128 + 400 * x::DOUBLE)))) AS px FROM embeddings),
hist AS (SELECT video, frame, px, list_transform(range(0, 256, 32), lambda b: len(list_filter(px, lambda p: p >= b AND p < b + 32)) / 64) AS h FROM frames)"""
SQL_SIGNALS = f"""
signals AS (SELECT video, frame, px, list_avg(px) AS brightness, list_stddev_pop(px) AS contrast,
  list_var_pop(list_transform(range(1, 65), lambda i: px[({_neighbour(-1, 0)})[i]] + px[({_neighbour(1, 0)})[i]] + px[({_neighbour(0, -1)})[i]] + px[({_neighbour(0, 1)})[i]] - 4 * px[i])) AS sharpness FROM frames)"""
SQL_CLIPS = f"""
WITH {SQL_FRAMES}, {SQL_SIGNALS},
looked AS (SELECT video, frame, h, lag(h) OVER (PARTITION BY video ORDER BY frame) AS b FROM hist WHERE frame % 3 = 0),
cuts AS (SELECT video, frame, (b IS NULL OR coalesce(sqrt(greatest(0, 1 - list_sum(list_transform(list_zip(b, h), lambda z: sqrt(z[1] * z[2]))) / sqrt(list_sum(b) * list_sum(h)))) > 0.3, false))::INT AS o FROM looked),
scenes AS (SELECT video, s - 1 AS clip_index, min(frame) AS start_frame FROM (SELECT *, sum(o) OVER (PARTITION BY video ORDER BY frame) AS s FROM cuts) GROUP BY ALL),
total AS (SELECT video, max(frame) + 1 AS total FROM frames GROUP BY 1),
bounded AS (SELECT video, total, clip_index, start_frame, coalesce(lead(start_frame) OVER (PARTITION BY video ORDER BY clip_index), total) AS end_frame FROM scenes JOIN total USING (video)),
clip AS (SELECT *, end_frame - start_frame AS n FROM bounded WHERE end_frame - start_frame >= 4),
picked AS (SELECT video, clip_index, unnest(CASE WHEN n <= 1 THEN [start_frame] ELSE list_transform(range(least(5, n)), lambda i: floor(start_frame + i * ((least(end_frame, total) - 1 - start_frame) / (least(5, n) - 1)))::BIGINT) END) AS frame FROM clip),
seen AS (SELECT p.video, p.clip_index, s.*  EXCLUDE (video), lag(px) OVER (PARTITION BY p.video, p.clip_index ORDER BY p.frame) AS b FROM picked p JOIN signals s ON p.video = s.video AND p.frame = s.frame),
quality AS (SELECT video, clip_index, avg(brightness) AS br, avg(contrast) AS co, avg(sharpness) AS sh, coalesce(avg(list_avg(list_transform(list_zip(b, px), lambda z: abs(z[1] - z[2])))), 0.0) AS mo FROM seen GROUP BY ALL)"""


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """video, frame, image (binary), histogram of all rows of `embeddings`."""
    from marlstone.operators.prefix import running_sum

    px = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * x.cast("double")))).cast("int"))
    rows = table(spark, d, "embeddings").select(F.col("label").alias("video"), "vec_id", px.alias("px"), F.lit(1).alias("one"))
    image = F.unhex(F.array_join(F.transform("px", lambda p: F.lpad(F.hex(p), 2, "0")), ""))
    share = lambda b: F.size(F.filter("px", lambda p: (p >= b) & (p < b + 32))) / 64
    histogram = F.array(*[share(b) for b in range(0, 256, 32)])
    return running_sum(rows, ["video"], ["vec_id"], "one", "n").select("video", (F.col("n") - 1).alias("frame"), image.alias("image"), histogram.alias("histogram"), "px")


def _mean_difference(before: Column, here: Column) -> Column:
    pairs = F.zip_with(before, here, lambda a, b: F.abs(a - b).cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / 64


@query(SQL_CLIPS + """ SELECT video, clip_index::BIGINT AS clip_index, start_frame, end_frame, n AS clip_num_frames, round_even(br::DECIMAL(24, 8), 2)::DOUBLE AS brightness, round_even(co::DECIMAL(24, 8), 2)::DOUBLE AS contrast, round_even(sh::DECIMAL(24, 8), 2)::DOUBLE AS sharpness, round_even(mo::DECIMAL(24, 8), 2)::DOUBLE AS motion_score FROM clip JOIN quality USING (video, clip_index)""")
def clip_quality(spark: SparkSession, d: str) -> DataFrame:
    """Signals of every clip cut from the frames."""
    frames = stored(_frames(spark, d), "frames")
    cut = clips.cut_intervals(frames, "video", "frame", "histogram", 3, 0.3, 4)
    out = clips.clip_signals(frames, cut, "video", "frame", clips.image_signals(F.col("image"), 8, 8), _mean_difference, "px")
    return out.drop("total_frames")


@query(SQL_CLIPS + """, kept AS (SELECT *, n / 30.0 AS seconds FROM clip JOIN quality USING (video, clip_index)
  WHERE n / 30.0 >= 1.0 AND round_even(br, 2) BETWEEN 30 AND 240 AND round_even(co, 2) >= 20 AND round_even(sh, 2) >= 50 AND round_even(mo, 2) >= 0.5)
SELECT video, clip_index::BIGINT AS clip_index, start_frame, end_frame, n AS clip_num_frames, round(start_frame / 30.0, 3) AS start_sec, round(end_frame / 30.0, 3) AS end_sec, round(seconds, 3) AS clip_duration_sec, 30.0::DOUBLE AS fps,
  least((start_frame + end_frame) // 2, total - 1)::BIGINT AS mid_frame, list_transform(range(3), lambda i: floor(start_frame + i * ((end_frame - 1 - start_frame) / 2))::BIGINT) AS keyframes,
  list_sort(list_distinct(list_append(keyframes, mid_frame))) AS needed, list_transform(keyframes, lambda f: list_position(needed, f)::BIGINT - 1) AS keyframe_positions FROM kept""")
def video_clips(spark: SparkSession, d: str) -> DataFrame:
    """From frames to the rows of the clips of good quality."""
    frames = stored(_frames(spark, d), "frames")
    out = clips.video_clips(frames, "video", "frame", "histogram", clips.image_signals(F.col("image"), 8, 8), "px", _mean_difference, stride=3, threshold=0.3, minimum=4)
    return out.drop("brightness", "contrast", "sharpness", "motion_score")


# ---- training feed -------------------------------------------------------


@query("SELECT vec_id, list_transform(range(64), lambda i: round(embedding[(i % 16) * 4 + i // 16 + 1]::DOUBLE / 255, 9)) AS chw FROM embeddings")
def chw_transpose(spark: SparkSession, d: str) -> DataFrame:
    chw = feed.hwc_to_chw(F.col("embedding"), 4, 4, 4)
    return table(spark, d, "embeddings").select("vec_id", F.transform(chw, lambda x: F.round(x, 9)).alias("chw"))


@query("SELECT i::BIGINT AS step, round(CASE WHEN i < 100 THEN 0.001 * (i + 1) / 100 ELSE 0.001 * 0.5 * (1 + cos(pi() * least((i - 100) / 900, 1.0))) END, 12) AS lr FROM range(1001) t(i)")
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1001).select(F.col("id").alias("step"), F.round(feed.learning_rate(F.col("id"), 1000, 100, 0.001), 12).alias("lr"))


@query("""
SELECT i::BIGINT AS second, CASE WHEN i < 120 THEN floor(10 + 40.0 * i / 120) WHEN i < 360 THEN 50 WHEN i < 480 THEN floor(50 - 40.0 * (i - 360) / 120) WHEN i < 720 THEN 10 WHEN i < 840 THEN floor(10 + 40.0 * (i - 720) / 120) END::INTEGER AS users FROM range(840) t(i)""")
def traffic_shape(spark: SparkSession, d: str) -> DataFrame:
    shape = [(0.0, 10.0), (120.0, 50.0), (360.0, 50.0), (480.0, 10.0), (720.0, 10.0), (840.0, 50.0)]
    return spark.range(840).select(F.col("id").alias("second"), feed.piecewise_linear(F.col("id"), shape).alias("users"))


@query('SELECT "index", episode_index, frame_index, "timestamp"::FLOAT AS "timestamp", task_index::BIGINT AS task_index, list_slice(state, 1, 3) AS state FROM lerobot_datasource')
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lerobot_datasource").select("index", "episode_index", "frame_index", "timestamp", "task_index", feed.truncated(F.col("state"), 3).alias("state"))
    return feed.collate_casts(rows)

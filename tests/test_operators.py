import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import basics, clips, feed
from marlstone.operators.prefix import running_sum
from marlstone.operators.temporal import asof_forward, range_overlap
from marlstone.streaming.incremental import first_seen, stream_clean


def test_running_sum_over_chunks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randint(0, 9)) for i in range(500)]
    got = running_sum(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], ["i"], "v", "s").collect()
    sums, want = {}, {}
    for g, i, v in rows:
        sums[g] = sums.get(g, 0) + v
        want[i] = sums[g]
    assert {r["i"]: r["s"] for r in got} == want


def test_asof_does_not_cross_files(spark):
    frames = spark.createDataFrame([("f0", 0.0, "a"), ("f0", 0.1, "b"), ("f0", 0.2, "c"), ("f1", 0.0, "d"), ("f1", None, "x")], "file string, ft double, frame string")
    rows = spark.createDataFrame([(1, "f0", 0.1), (2, "f1", 0.02), (3, "f1", 0.3), (4, "f0", 0.16), (5, "f2", 0.0)], "id int, file string, t double")
    got = {r["id"]: r["frame"] for r in asof_forward(rows, frames, ["file"], "t", "ft", 0.05, ["frame"]).collect()}
    assert got == {1: "b", 2: "d", 3: None, 4: "c", 5: None}


def test_range_overlap_equals_brute_force(spark):
    rng = random.Random(2)
    make = lambda: [(k, i, s := rng.randint(0, 500), s + rng.randint(0, 120)) for i, k in enumerate(rng.choices("xy", k=40))]  # noqa: E731, F841
    a, b = make(), make()
    got = range_overlap(spark.createDataFrame(a, "k string, i int, af int, at int"), spark.createDataFrame(b, "k string, j int, bf int, bt int"), ["k"], ("af", "at"), ("bf", "bt"), 64)
    want = {(i, j) for k, i, s, e in a for m, j, t, u in b if k == m and s < u and e > t and e > s and u > t}
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted(want)


def test_keyframes(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (5, 8), (0, 30)], "s long, e long")
    got = [r["k"] for r in df.select(clips.keyframes(F.col("s"), F.col("e"), F.col("e"), 3).alias("k")).collect()]
    want = [[int(x) for x in np.linspace(s, e - 1, min(3, e - s))] for s, e in ((0, 1), (0, 2), (5, 8), (0, 30))]
    assert got == want


def test_quality_bounds_are_inclusive(spark):
    good = (1.0, 30.0, 20.0, 50.0, 0.5)
    rows = [good, (1.0, 240.0, 20.0, 50.0, 0.5), (0.99, *good[1:]), (1.0, 29.9, *good[2:]), (1.0, 240.1, *good[2:]), (*good[:4], None), (*good[:3], float("nan"), 0.5)]
    df = spark.createDataFrame(rows, "clip_duration_sec double, brightness double, contrast double, sharpness double, motion_score double")
    assert df.where(clips.good_quality()).count() == 2


def test_replies(spark):
    texts = ['{"category": "news", "is_safe": "false", "description": "d", "visual_quality": "low"}', '```json\n{"description": "x"}\n```', "z" * 300, "[1, 2]", '{"is_safe": "maybe"}', None, "{'category': 'news'}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [tuple(r["r"]) for r in df.select("i", clips.parsed_reply(F.col("t")).alias("r")).orderBy("i").collect()]
    nested = '\u3000```json\n{"category": "news", "description": "a ``` b"}\n```\n'
    r = spark.createDataFrame([(nested,), ('```\n{"category": "news"',)], "t string").select(clips.parsed_reply(F.col("t")).alias("r")).collect()
    assert tuple(r[0]["r"]) == ("news", True, "a ``` b", "medium") and r[1]["r"]["description"] == '```\n{"category": "news"'
    assert got == [("news", False, "d", "low"), ("other", True, "x", "medium"), ("other", True, "z" * 200, "medium"), ("other", True, "[1, 2]", "medium"), ("other", True, "", "medium"), ("other", True, "", "medium"), ("other", True, "{'category': 'news'}", "medium")]


def test_video_id(spark):
    import hashlib

    data = bytes(range(256)) * 20
    df = spark.createDataFrame([(bytearray(data), None), (bytearray(data), ""), (bytearray(data), "own")], "mp4 binary, video_id string")
    sha = hashlib.sha1(data[:4096]).hexdigest()[:12]
    assert [r["v"] for r in df.select(clips.video_id(F.col("mp4"), F.col("video_id")).alias("v")).collect()] == [sha, sha, "own"]


def test_pooled_embedding(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(20, 8))
    df = spark.createDataFrame([(i % 2, [float(x) for x in r]) for i, r in enumerate(v)] + [(0, None), (2, None), (3, [])], "label int, e array<double>")
    got = {r["label"]: r["embedding"] for r in clips.pooled_embedding(df, "label", "e", 8).collect()}
    assert got[2] == got[3] == [0.0] * 8
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert all(np.allclose(got[k], unit[k::2].mean(axis=0)) for k in (0, 1))


def test_fetch_and_decode_never_fail_the_job(spark):
    def get(url):
        if "down" in url:
            raise TimeoutError
        return (404, b"") if "gone" in url else (200, b"img")

    def codec(data):
        return data.upper() if data != b"bad" else 1 / 0

    df = spark.createDataFrame([("http://ok",), ("http://gone",), ("http://down",)], "url string")
    got = {r["url"]: (r["status"], r["bytes"]) for r in clips.fetch_urls(df, "url", get, 4).collect()}
    assert got == {"http://ok": ("success", b"img"), "http://gone": ("http_404", None), "http://down": ("error_TimeoutError", None)}
    images = spark.createDataFrame([(bytearray(b"img"),), (bytearray(b"bad"),), (None,)], "b binary").select(clips.decode_images(F.col("b"), codec).alias("b"))
    assert [r["b"] for r in images.collect()] == [b"IMG", None, None]


def test_model_is_loaded_once_and_requests_are_built(spark):
    def load():
        return lambda batch: [json.loads(x)["p"] + "!" for x in batch]

    df = spark.range(200).select(F.to_json(F.struct(F.col("id").cast("string").alias("p"))).alias("q"))
    got = [r["a"] for r in df.select(clips.describe_clips(F.col("q"), load, 7).alias("a")).collect()]
    assert sorted(got) == sorted(f"{i}!" for i in range(200))
    req = spark.createDataFrame([(bytearray(b"x"),)], "b binary").select(clips.reply_request("s", "p", F.col("b")).alias("r")).first()["r"]
    assert [m["role"] for m in req["messages"]] == ["system", "user"] and req["sampling"]["max_tokens"] == 200


def test_chw_by_index_and_by_tensor(spark):
    x = np.random.default_rng(1).integers(0, 256, (4, 5, 3), dtype=np.uint8)
    want = (x.transpose(2, 0, 1).reshape(-1) / 255).astype(np.float32)
    df = spark.createDataFrame([([int(v) for v in x.reshape(-1)], bytearray(x.tobytes()))], "v array<int>, b binary")
    r = df.select(feed.hwc_to_chw(F.col("v"), 4, 5, 3).alias("a"), feed.tensor_to_chw(F.col("b"), (4, 5, 3)).alias("c")).first()
    assert np.allclose(r["a"], want) and np.allclose(r["c"], want)


def test_feed_helpers(spark):
    df = spark.createDataFrame([(1, 2.5, True, "t", [1.5])], "i int, d double, b boolean, task string, v array<double>")
    assert dict(feed.collate_casts(df).dtypes) == {"i": "bigint", "d": "float", "b": "boolean", "task": "string", "v": "array<float>"}
    rows = list(feed.batches(spark.range(10).orderBy("id"), 4, lambda p: p["id"].tolist()))
    assert [len(b) for b in rows] == [4, 4, 2]
    assert feed.total_steps(10, 4, 2, 3) == 3
    parts = feed.shards(spark.range(1000), "id", 4).groupBy("shard").count().collect()
    assert len(parts) == 4 and sum(r["count"] for r in parts) == 1000
    done = feed.ordered_batches(spark.range(50), "id", 20, lambda xs: [x * 2 for x in xs], "id", "bigint")
    assert {r["id"]: r["result"] for r in done.collect()} == {i: 2 * i for i in range(50)}
    a, b = feed.aligned_to_shorter(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)))
    assert tuple(spark.range(1).select(a, b).first()) == ([1], [3])


def test_basics(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "path string, size int")
    assert [r["path"] for r in basics.missing_or_changed(a, a.where("size < 3").replace(2, 9), "path", "size").orderBy("path").collect()] == ["y", "z"]
    assert basics.pass_through(a, ["size", "none"]).columns == ["size"]
    assert basics.rows_per_block(a, 2, 3).rdd.getNumPartitions() == 2
    assert spark.range(1).select(F.lit(1).alias("a"), F.lit(0).alias("b")).select(basics.ratio("a", "b")).first()[0] is None


def test_stream_reads_each_file_once(spark, tmp_path):
    long = "word " * 30
    pd.DataFrame({"doc_id": [1, 2], "text": [long, "short"]}).to_parquet(tmp_path / "a.parquet")
    pd.DataFrame({"doc_id": [3], "text": ["　" + long]}).to_parquet(tmp_path / "b.parquet")
    schema = spark.read.parquet(str(tmp_path)).schema
    out = stream_clean(spark, str(tmp_path), schema)
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, long.strip()), (3, long.strip())]


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    pd.DataFrame({"doc_id": [1], "text": ["word " * 30]}).to_parquet(source / "a.parquet")
    schema = spark.read.parquet(str(source)).schema
    assert stream_clean(spark, str(source), schema, out=out, state=state).count() == 1
    pd.DataFrame({"doc_id": [2], "text": ["more " * 30]}).to_parquet(source / "b.parquet")
    assert sorted(r["doc_id"] for r in stream_clean(spark, str(source), schema, out=out, state=state).collect()) == [1, 2]
    assert stream_clean(spark, str(source), schema, out=out, state=state).count() == 2
    with pytest.raises(ValueError):
        stream_clean(spark, str(source), schema, out=out)


def test_first_seen_drops_repeats_within_the_delay(spark, tmp_path):
    at = pd.Timestamp("2025-01-01")
    for i, (key, minutes) in enumerate([("a", 0), ("a", 1), ("b", 2), ("a", 3)]):
        pd.DataFrame({"k": [key], "t": [at + pd.Timedelta(minutes=minutes)]}).astype({"t": "datetime64[us]"}).to_parquet(tmp_path / f"{i}.parquet")
    stream = first_seen(spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path)), ["k"], "t", "1 hour")
    run = stream.writeStream.format("memory").queryName("first_seen_rows").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["k"] for r in spark.table("first_seen_rows").collect()) == ["a", "b"]


def test_feed_of_workers_and_devices(spark):
    def consume(worker, batches):
        for b in batches:
            yield pd.DataFrame({"worker": [worker], "n": [len(b)], "total": [int(b["id"].sum())]})

    got = feed.worker_batches(spark.range(1000), 3, "id", 64, consume, "worker int, n int, total long").collect()
    assert sum(r["total"] for r in got) == 999 * 500 and max(r["n"] for r in got) == 64 and {r["worker"] for r in got} == {0, 1, 2}
    assert sum(r["n"] < 64 for r in got) <= 3
    assert feed.device_rows(32, 8) == 4
    with pytest.raises(ValueError):
        feed.device_rows(30, 8)


def test_even_groups_without_a_global_window(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(x,) for x in rng.sample(range(10_000), 103)], "v long")
    got = [(r["v"], r["task"]) for r in feed.evenly(df, ["v"], 8).collect()]
    assert [t for _, t in sorted(got)] == sorted(t for _, t in got)
    assert [sum(t == k for _, t in got) for k in range(8)] == [13] * 7 + [12]
    assert sorted(r["task"] for r in feed.evenly(df.limit(3), ["v"], 8).collect()) == [0, 1, 2]


def test_lookup_raises_on_an_unknown_key(spark):
    tasks = spark.createDataFrame([(0, "pick"), (1, None)], "task_index int, task string")
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "i int, task_index int")
    assert {r["i"]: r["task"] for r in basics.looked_up(rows, tasks, "task_index", "task").collect()} == {1: "pick", 2: None, 3: None}
    with pytest.raises(Exception, match="unknown task_index 7"):
        basics.looked_up(spark.createDataFrame([(1, 7)], "i int, task_index int"), tasks, "task_index", "task").collect()
    assert basics.renamed_keys(["a", "b"], {"a": "x"}) == ["x", "b"]


def test_motion_follows_a_shift(spark):
    y, x = np.mgrid[:32, :32]
    image = lambda d: bytearray(np.clip(128 + 60 * np.sin((x - d) / 4) + 50 * np.cos(y / 5), 0, 255).astype(np.uint8).tobytes())
    df = spark.createDataFrame([(0, image(0), image(0)), (1, image(0), image(1)), (2, image(0), None)], "i int, a binary, b binary")
    got = {r["i"]: r["m"] for r in df.select("i", clips.flow_magnitude(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got[0] == 0 and 0.6 < got[1] < 1.4 and got[2] is None


def test_clips_from_frames(spark):
    def picture(scene, i):
        p = np.full((16, 16), 60 + 120 * scene, np.int64) + ((np.arange(256).reshape(16, 16) * 7 + i * 3) % 50)
        return bytearray(p.astype(np.uint8).tobytes())

    rows = [("v", f, picture(f // 40 % 2, f), [1.0, 0.0] if f // 40 % 2 else [0.0, 1.0]) for f in range(130)]
    rows += [("one", 0, picture(0, 0), [1.0, 0.0])]
    df = spark.createDataFrame(rows, "video string, frame long, image binary, h array<double>").repartition(5)
    got = clips.cut_intervals(df, "video", "frame", "h", 20, 0.5, 30)
    assert sorted((r["clip_index"], r["start_frame"], r["end_frame"]) for r in got.collect()) == [(0, 0, 40), (1, 40, 80), (2, 80, 120)]
    out = clips.video_clips(df, "video", "frame", "h", clips.image_signals(F.col("image"), 16, 16), "image", fps=F.lit(25.0)).collect()
    assert all(r["fps"] == 25.0 and r["clip_duration_sec"] == 1.6 and r["mid_frame"] == r["start_frame"] + 20 and r["keyframes"][-1] == r["end_frame"] - 1 for r in out)
    single = clips.clip_signals(df, clips.cut_intervals(df, "video", "frame", "h", 20, 0.5, 1).where("video = 'one'"), "video", "frame", clips.image_signals(F.col("image"), 16, 16), clips.flow_magnitude, "image").first()
    assert single["motion_score"] == 0.0 and single["brightness"] > 0


def test_a_cluster_must_name_its_folder():
    from types import SimpleNamespace

    from marlstone.session import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(master="spark://m:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def test_previous_over_chunks_with_clashing_names(spark):
    from marlstone.operators.prefix import with_previous

    rows = [("a" if i % 3 else "b", i, None if i % 7 == 0 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, own int, carried int")
    got = {r["own"]: r["row"] for r in with_previous(df, ["g"], ["own"], "carried", "row").collect()}
    last, want = {}, {}
    for g, i, v in rows:
        want[i] = last.get(g)
        last[g] = v
    assert got == want


def test_image_signals_and_histograms(spark):
    rng = np.random.default_rng(3)
    gray = rng.integers(0, 256, (6, 8), dtype=np.uint8)
    rgb = np.zeros((4, 4, 3), np.uint8)
    rgb[:2, :, 0] = 200
    rgb[2:, :, 1] = 100
    df = spark.createDataFrame([(bytearray(gray.tobytes()), bytearray(rgb.tobytes())), (None, None)], "g binary, c binary")
    got = df.select(clips.image_signals(F.col("g"), 6, 8).alias("s"), clips.color_histogram(F.col("c"), 4, 4).alias("h")).collect()
    assert got[0]["s"]["brightness"] == pytest.approx(gray.mean()) and got[0]["s"]["contrast"] == pytest.approx(gray.astype(float).std())
    flat = np.full((6, 8), 9, np.uint8)
    assert spark.createDataFrame([(bytearray(flat.tobytes()),)], "g binary").select(clips.image_signals(F.col("g"), 6, 8).alias("s")).first()["s"]["sharpness"] == 0
    h = np.array(got[0]["h"]).reshape(50, 60)
    assert h.sum() == pytest.approx(1) and h[0, 59] == pytest.approx(0.5) and h[16, 59] == pytest.approx(0.5)
    assert got[1]["h"] is None and got[1]["s"]["brightness"] is None
    pairs = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "p array<double>, q array<double>")
    assert [r[0] for r in pairs.select(clips.histogram_distance(F.col("p"), F.col("q"))).collect()] == [pytest.approx(0), 1.0, None]


def test_intermediate_tables_go_on_release(spark):
    import os

    from marlstone.session import release, stored

    df = stored(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    release()
    assert not os.path.exists(path)


def test_positions_sizing_and_placement(spark):
    r = spark.range(1).select(clips.positions(F.array(F.lit(3), F.lit(5), F.lit(9)), F.array(F.lit(9), F.lit(3), F.lit(4))).alias("p")).first()
    assert r["p"] == [2, 0, None]
    assert clips.runs_eager(19) and not clips.runs_eager(20) and clips.replicas(2) == 8 and clips.replicas(6) == 12
    profile = clips.placed_on(2, gpu=1)
    assert profile.taskResources["cpus"].amount == 2.0 and profile.executorResources["gpu"].amount == 1

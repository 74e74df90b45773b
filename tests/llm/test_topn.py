import random

from pyspark.sql import functions as F

from marlstone.llm.common import current_clips
from marlstone.llm.topn import top_n

SCHEMA = "g string, s double, t double, k int, rank string, salt int, bucket string"


def expect(rows, n):
    groups = {}
    for r in rows:
        if r[1] is not None and r[1] == r[1]:
            groups.setdefault(r[0], []).append(r)
    out = set()
    for g, own in groups.items():
        own.sort(key=lambda r: (-r[1], r[2] is None, -(r[2] or 0), r[3]))
        out |= {(g, r[3], i + 1) for i, r in enumerate(own[:n])}
    return out


def test_hot_group_ties_nulls_and_clashing_names(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, float("nan"), float("inf"), 5.0, 5.0, rng.random() * 1000, -rng.random()]), rng.choice([None, 1.0, 2.0]), i, "mine", 4, "b") for i in range(2000)]
    got = top_n(spark.createDataFrame(rows, SCHEMA), ["g"], "s", 3, [("t", True), ("k", False)])
    assert {(r["g"], r["k"], r["rank"]) for r in got.collect()} == expect(rows, 3)
    assert set(got.columns) == {"g", "s", "t", "k", "rank", "salt", "bucket"}


def test_hot_and_thousands_of_small_groups(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", f"g{rng.randint(0, 3000)}", f"g{rng.randint(0, 3000)}"]), float(rng.randint(0, 50)), None, i, "", 0, "") for i in range(9000)]
    got = top_n(spark.createDataFrame(rows, SCHEMA), ["g"], "s", 2, [("k", False)])
    assert {(r["g"], r["k"], r["rank"]) for r in got.collect()} == expect(rows, 2)


def test_all_equal_and_repeated_rows(spark):
    rows = [("x", 1.0, None, 7, "", 0, "")] * 10
    assert top_n(spark.createDataFrame(rows, SCHEMA), ["g"], "s", 3, [("k", False)]).count() == 3


def test_empty(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), ["g"], "s", 3, [("k", False)]).count() == 0


def test_current_clip_is_the_latest_row(spark):
    rows = [(1, " AB ", 0, "2025-01-01 00:00:00", 1.0), (2, "ab", 0, "2025-01-02 00:00:00", 2.0), (3, "ab　", 0, "2025-01-02 00:00:00", 3.0), (4, "ab", 1, None, 4.0), (5, None, 1, None, 5.0), (6, "ab", None, None, 6.0)]
    df = spark.createDataFrame(rows, "clip_row long, video_id string, clip_index int, landed string, s double").withColumn("landed_at", F.to_timestamp("landed"))
    assert sorted((r["video_id"], r["clip_index"], r["s"]) for r in current_clips(df, "s").collect()) == [("ab", 0, 3.0), ("ab", 1, 4.0)]


def test_bounded_slices_keep_all_rows():
    import pyarrow as pa

    from marlstone.llm.common import bounded

    texts = ["x" * 30, None, "", "é" * 100, "y", "z" * 500, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    parts = list(bounded(iter([batch, batch.slice(0, 0)]), 1, 100))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts and len(parts) > 3

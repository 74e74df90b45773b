import random

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import splits
from marlstone.llm.splits import assign_splits, balance_bucket, entity_groups, split_name, torn_entities

TARGETS = [("test", 120), ("train", 800), ("validation", 80)]


def test_differencing_gives_nearly_equal_bins():
    rng = np.random.default_rng(2)
    w = np.floor(rng.pareto(1.5, 5000) * 10 + 1)
    w = np.minimum(w, 500)
    slot, sums = balance_bucket(w, 20)
    assert np.allclose(np.bincount(slot, w, 20), sums) and sums.max() - sums.min() <= 2


def test_shares_and_whole_entities(spark):
    rng = random.Random(1)
    rows = [("video", f"v{i}", rng.randint(1, 40)) for i in range(3000)] + [("video", "hot", 6000)] + [("episode", str(i), 10) for i in range(500)]
    df = spark.createDataFrame(rows, "kind string, component string, weight long")
    for buckets in (500_000, 700):
        got = assign_splits(df, TARGETS, bucket_entities=buckets).collect()
        assert sorted((r["kind"], r["component"]) for r in got) == sorted((k, c) for k, c, _ in rows)
        for kind in ("video", "episode"):
            total = sum(r["weight"] for r in got if r["kind"] == kind)
            for name, permille in TARGETS:
                share = sum(r["weight"] for r in got if r["kind"] == kind and r["split"] == name) * 1000 / total
                assert abs(share - permille) < 8, (kind, name, share)


def test_buckets_are_combined_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(splits, "MERGED", 4)
    df = spark.range(4000).selectExpr("'v' as kind", "cast(id as string) as component", "1 + id % 37 as weight")
    got = assign_splits(df, TARGETS, bins=50, bucket_entities=150).collect()
    total = sum(r["weight"] for r in got)
    assert len(got) == 4000 and len({r["bin"] for r in got}) == 50
    for name, permille in TARGETS:
        assert abs(sum(r["weight"] for r in got if r["split"] == name) * 1000 / total - permille) < 12


def test_records_with_several_entities_tie_them(spark):
    links = spark.createDataFrame([("v", 1, "a"), ("v", 1, "b"), ("v", 2, "b"), ("v", 2, "c"), ("v", 3, "d"), ("w", 1, "a"), ("v", None, "e"), ("v", 4, None), (None, 1, "z"), ("v", 3, "d")], "kind string, record long, entity string")
    got = {(r["kind"], r["entity"]): r["component"] for r in entity_groups(links).collect()}
    assert got == {("v", "a"): "a", ("v", "b"): "a", ("v", "c"): "a", ("v", "d"): "d", ("w", "a"): "a", ("v", "e"): "e"}
    named = links.withColumn("split", F.when(F.col("record") == 1, "train").when(F.col("record") == 2, "test"))
    torn = {(r["kind"], r["entity"]) for r in torn_entities(named, entity_groups(links)).collect()}
    assert torn == {("v", "a"), ("v", "b"), ("v", "c")}


def test_spellings_of_a_split(spark):
    names = ["train", "validation", "test"]
    raw = ["TRAIN", " Training ", "val", "valid", "Validation\n", "testing", "t", "", None, "holdout", "  "]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, s string")
    got = [r["n"] for r in df.select("i", split_name(F.col("s"), names).alias("n")).orderBy("i").collect()]
    assert got == ["train", "train", "validation", "validation", "validation", "test", "t", None, None, "holdout", None]


def test_empty(spark):
    assert assign_splits(spark.createDataFrame([], "kind string, component string, weight long"), TARGETS).count() == 0

import random

from pyspark.sql import functions as F

from marlstone.llm import queries
from marlstone.llm.packing import pack, patterns, pieces


def test_patterns_use_every_item_once_and_fit():
    rng = random.Random(4)
    hist = {s: rng.randint(1, 50) for s in rng.sample(range(1, 2049), 700)}
    left = dict(hist)
    for length, sizes, times in patterns(hist):
        assert sum(sizes) <= length
        for s in sizes:
            left[s] -= times
    assert set(left.values()) == {0}
    used = sum(length * t for length, _, t in patterns(hist))
    assert sum(s * n for s, n in hist.items()) / used > 0.97


def check(spark, sizes):
    df = spark.createDataFrame([(i, s, 1, 2) for i, s in enumerate(sizes)], "doc_id long, tokens long, container int, length int")
    rows = pack(df, "doc_id", "tokens").collect()
    want = {}
    for i, s in enumerate(sizes):
        k = 0
        while s and s > 0:
            want[i, k] = min(2048, s)
            s, k = s - 2048, k + 1
    assert {(r["doc_id"], r["piece"]): r["tokens"] for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault((r["container"], r["length"]), []).append(r)
    assert len({c for c, _ in bins}) == len(bins)
    for (_, length), own in bins.items():
        assert sum(r["tokens"] for r in own) <= length
        assert len({r["place"] for r in own}) == len(own)
    return sum(r["tokens"] for r in rows), sum(length for _, length in bins)


def test_ties_zero_null_and_long_items(spark):
    used, room = check(spark, [0, None, 2048, 2049, 10_000, 1, 1, 1, *([700] * 500), *([648] * 300), *range(1, 900, 7)])
    assert used / room > 0.9


def test_random_items_fill_well(spark):
    rng = random.Random(0)
    used, room = check(spark, [min(9000, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(6000)])
    assert used / room > 0.99


def test_empty(spark):
    assert check(spark, []) == (0, 0)


def test_only_longer_items_are_split(spark):
    df = spark.createDataFrame([(1, 2048), (2, 2049), (3, 0), (4, None)], "doc_id long, tokens long")
    assert sorted((r["doc_id"], r["piece"], r["tokens"]) for r in pieces(df, "doc_id", "tokens").collect()) == [(1, 0, 2048), (2, 0, 2048), (2, 1, 1)]


def test_split_documents_come_from_the_containers(spark, tmp_path, monkeypatch):
    texts = [(1, "word " * 2048), (2, "word " * 9000), (3, "word " * 3000), (4, "short"), (5, None), (6, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {r["doc_id"]: r["tokens"] for r in queries._token_counts(spark, str(tmp_path)).collect()}
    found = sorted(r["doc_id"] for r in queries.p8_found(spark, str(tmp_path)).collect())
    assert found == sorted(i for i, n in counts.items() if n > 2048) and {2, 3} <= set(found)
    monkeypatch.setattr(queries, "pack", lambda *a: pack(*a).withColumn("container", F.lit(0)))
    assert not queries.p8_found(spark, str(tmp_path)).collect()

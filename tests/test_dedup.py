import os
import random
from collections import Counter, defaultdict
from math import ceil

import pytest

from marlstone.operators.components import components
from marlstone.operators.dedup import band_shape, duplicate_classes, minhash_dedup


def test_band_shape_of_the_published_setting():
    assert band_shape(0.7, 256) == (25, 10)


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1080)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5)]
    df = spark.createDataFrame(edges + [(None, 3)], "src long, dst long")
    assert {r["node"]: r["component"] for r in components(df).collect()} == union_find(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def shingles(t):
    return {t.lower()[i : i + 5] for i in range(max(1, len(t) - 4))}


def test_classes_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(40)]
    near = [t[:-4] + "zzzz" for t in texts[:15]] + [t.upper() for t in texts[:5]] + [texts[0]] * 20
    rows = [(i, t) for i, t in enumerate(texts + near + ["", "", "ab", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class"] for r in duplicate_classes(df, "doc_id", "text").collect()}
    edges = [(i, i) for i, t in rows if t is not None]
    for i, a in rows:
        for j, b in rows[:i]:
            if a is not None and b is not None and len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) >= 0.9:
                edges.append((j, i))
    assert got == union_find(edges)
    kept = {r["doc_id"] for r in minhash_dedup(df, "doc_id", "text").collect()}
    assert kept == {c for c in got.values()} | {i for i, t in rows if t is None}
    again = minhash_dedup(minhash_dedup(df, "doc_id", "text"), "doc_id", "text")
    assert {r["doc_id"] for r in again.collect()} == kept


def test_classes_of_alike_texts_hold_no_false_link(spark):
    """Texts made of shared sentences, much alike but mostly below the threshold."""
    rng = random.Random(4)
    pool = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(12)) + "." for _ in range(30)]
    rows = [(i, " ".join(rng.sample(pool, 9))) for i in range(400)]
    rows += [(1000 + i, rows[i][1][: int(len(rows[i][1]) * 0.85)]) for i in range(60)] + [(2000 + i, rows[i][1].replace("a", "z", 3)) for i in range(60)]
    got = {r["doc_id"]: r["class"] for r in duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    sets = {i: shingles(t) for i, t in rows}
    edges = [(j, i) for i in sets for j in sets if j < i and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])]
    true = union_find(edges + [(i, i) for i in sets])
    assert all(true[i] == true[c] for i, c in got.items())
    assert sum(got[i] == got[j] for j, i in edges) >= 0.9 * len(edges)


def test_many_members_of_one_bucket(spark):
    rows = [(i, "the same long beginning of every text that is stored in this table, whatever comes then, number " + "abcdefghij"[i % 10]) for i in range(2000)]
    got = {r["class"] for r in duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {0}


def exact_pairs(sets, threshold):
    """All pairs of at least the threshold: a pair shares one of the rarest windows of either."""
    count = Counter(g for s in sets.values() for g in s)
    index, pairs = defaultdict(list), []
    for i in sorted(sets):
        own = sets[i]
        rare = sorted(own, key=lambda g: (count[g], g))[: len(own) - ceil(threshold * len(own)) + 1]
        for j in {j for g in rare for j in index[g]}:
            shared = len(own & sets[j])
            if shared >= threshold * (len(own) + len(sets[j]) - shared):
                pairs.append((j, i))
        for g in rare:
            index[g].append(i)
    return pairs


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_documents_against_all_exact_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text is not null")
    got = {r["doc_id"]: r["class"] for r in duplicate_classes(docs, "doc_id", "text").collect()}
    first = {}
    for r in docs.orderBy("doc_id").collect():
        first.setdefault(r["text"].lower(), r["doc_id"])
    sets = {i: shingles(t) for t, i in first.items() if t}
    pairs = exact_pairs(sets, 0.7)
    true = union_find(pairs + [(i, i) for i in sets])
    assert all(true[i] == true[got[i]] for i in sets)  # no class holds texts that true pairs don't connect
    assert sum(got[i] == got[j] for j, i in pairs) >= 0.9 * len(pairs)

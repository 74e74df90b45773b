import numpy as np
import pytest

from marlstone.llm import sampling
from marlstone.llm.sampling import duels, margin_report, pivotal_sample, reachable, strata_report, tilt


def test_totals_keep_floors_and_counts_and_add_up():
    counts = np.array([1000, 1000, 30, 5])
    t = counts * reachable(counts, np.array([0.5, 0.2, 0.2, 0.1]), np.array([10, 10, 10, 10]), 300)
    assert t.sum() == pytest.approx(300) and (t <= counts + 1e-9).all() and (t >= np.minimum(10, counts) - 1e-9).all()
    assert t[2] == pytest.approx(30) and t[3] == pytest.approx(5)
    assert t[0] / t[1] == pytest.approx(2.5)


@pytest.mark.parametrize("seed", range(30))
def test_totals_equal_bisection(seed):
    rng = np.random.default_rng(seed)
    counts, shares, floors = rng.integers(0, 5000, 22), rng.dirichlet(np.full(22, 0.4)), rng.integers(0, 40, 22)
    size = int(counts.sum() * rng.choice([0.1, 0.4, 0.9]))
    low, high = np.minimum(floors, counts).astype(float), counts.astype(float)
    lo, hi = 0.0, 1e9
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(mid * shares, low, high).sum() < size else (lo, mid)
    want = np.clip(hi * shares, low, high)
    got = counts * reachable(counts, shares, floors, size)
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


def test_newton_meets_moments_of_overlapping_features():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (12, 4)).astype(float)
    counts = rng.integers(50, 500, 12).astype(float)
    target = x.T @ (counts * 0.1 * np.exp(x @ np.array([0.5, -0.3, 0.2, 0.1])))
    p = tilt(x, counts, 0.1, target)
    assert np.allclose(x.T @ (counts * p), target, rtol=1e-6)


def test_margins_are_met_and_the_joint_answer_is_no_division(spark):
    joint = {("a", True): 5000, ("a", False): 500, ("b", True): 800, ("b", False): 2200, ("c", True): 90, ("c", False): 1410}
    cells = spark.createDataFrame([(c, s, n) for (c, s), n in joint.items()] + [("x", True, 50), (None, True, 9)], "c string, s boolean, n long")
    report, margins = margin_report(cells, {"c": {"a": 0.3, "b": 0.3, "c": 0.4}, "s": {True: 0.65, False: 0.35}})
    assert all(abs(m["gap"]) < 1e-3 for m in margins)
    p = {(r["c"], r["s"]): r["p"] for r in report}
    assert p["c", True] == 1.0  # capped: the other cells make up for it
    assert p["c", False] * 1410 == pytest.approx(400 - 90, abs=0.1)
    assert p["a", True] < 1 and p["b", True] < 1
    odds = (p["a", True] / p["a", False]) / (p["b", True] / p["b", False])
    assert odds == pytest.approx(1, rel=1e-6) and not np.isclose(p["a", True] * 5000, 1000 * 0.3 * 0.65)
    _, margins = margin_report(cells, {"c": {"a": 0.0, "b": 0.0, "c": 1.0}, "s": {True: 0.5, False: 0.5}})
    assert sum(abs(m["gap"]) for m in margins) > 100  # 90 rows can't make up 500


def test_duels_keep_the_expected_number_and_each_probability():
    rng = np.random.default_rng(0)
    ids, probs = np.arange(10_000), np.full(10_000, 0.123)
    strata = np.sort(rng.integers(0, 7, 10_000))
    p = probs.copy()
    taken, rest = duels(ids, strata, p, 3)
    assert len(taken) + p[rest].sum() == pytest.approx(1230, abs=1e-6) and len(set(taken)) == len(taken) and len(rest) <= 7
    for s in range(7):
        assert abs((strata[taken] == s).sum() - 0.123 * (strata == s).sum()) <= 1
    mixed = np.tile([0.1, 0.5, 0.9, 0.3], 3)
    hits = np.zeros(12)
    for seed in range(4000):
        t, r = duels(np.arange(12), np.zeros(12, int), q := mixed.copy(), seed)
        hits[t] += 1
        hits[r] += q[r]
    assert np.abs(hits / 4000 - mixed).max() < 0.04


def test_sample_has_each_strata_total(spark):
    rows = [(i, i % 3, [0.5, 0.01, 1.0][i % 3]) for i in range(30_000)]
    df = spark.createDataFrame(rows, "id long, stratum int, p double")
    ids = [r["id"] for r in pivotal_sample(df, 30_000).collect()]
    assert len(ids) == len(set(ids)) == 5000 + 100 + 10_000
    assert abs(sum(i % 3 == 0 for i in ids) - 5000) <= 1 and abs(sum(i % 3 == 1 for i in ids) - 100) <= 1
    half = sum(1 for i in ids if i % 3 == 0 and i < 15_000)
    assert 2200 < half < 2800
    assert sorted(ids) == sorted(r["id"] for r in pivotal_sample(df.repartition(7), 30_000).collect())


def test_many_strata_never_meet_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CHUNK_ROWS", 20_000)
    rows = spark.range(400_000).selectExpr("id", "cast(id % 200000 as int) as stratum", "0.3D as p")
    ids = [r["id"] for r in pivotal_sample(rows, 400_000).collect()]
    assert len(ids) == len(set(ids)) == 120_000
    per = np.bincount(np.array(ids) % 200_000, minlength=200_000)
    assert per.max() <= 1 or (per <= 1).mean() > 0.999


def test_report_of_short_and_empty_strata(spark):
    df = spark.createDataFrame([("a", True)] * 90 + [("b", True)] * 3 + [("a", None)], "c string, s boolean")
    targets = [{"c": "a", "s": True, "target_permille": 500, "min_rows": 5}, {"c": "b", "s": True, "target_permille": 300, "min_rows": 4}, {"c": "c", "s": True, "target_permille": 200, "min_rows": 0}]
    r = strata_report(df, ["c", "s"], targets)
    assert [x["eligible"] for x in r] == [90, 3, 0] and [x["short"] for x in r] == [False, True, True] and r[0]["sample_size"] == 9
    empty = strata_report(df.limit(0), ["c", "s"], targets)
    assert all(x["p"] == 0 for x in empty)


def test_empty_sample(spark):
    assert pivotal_sample(spark.createDataFrame([], "id long, stratum int, p double"), 0).count() == 0

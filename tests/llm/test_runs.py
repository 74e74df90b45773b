import random

import pytest

from marlstone.llm.runs import ENCODED, collapse_runs, merged_edges

SCHEMA = "ep bigint, fr bigint, t double, v array<float>, w array<float>, ver int, g string, first int, chunk string"
COLS = ("ep", "fr", "t", ["v", "w"], "ver")


def brute(rows, tol=0.002, least=2):
    best = {}
    for r in rows:
        if r[0] is None or r[1] is None:
            continue
        old = best.get((r[0], r[1]))
        if old is None or (-1 if r[5] is None else r[5]) > (-1 if old[5] is None else old[5]):
            best[r[0], r[1]] = r

    def like(a, b):
        for x, y in ((a[3], b[3]), (a[4], b[4])):
            if x is None or y is None or len(x) != len(y) or any(p is None or q is None or not abs(p - q) <= tol for p, q in zip(x, y)):
                return False
        return True

    runs, last = [], None
    for k in sorted(best):
        r = best[k]
        if last is not None and last[0] == r[0] and like(last, r):
            runs[-1].append(r)
        else:
            runs.append([r])
        last = r
    out = []
    for run in runs:
        if len(run) >= least:
            ts = [r[2] for r in run if r[2] is not None]
            out.append((run[0][0], run[0][1], run[-1][1], len(run), round(ts[-1] - ts[0], 6) if len(ts) > 1 else None, sum(b < a for a, b in zip(ts, ts[1:]))))
    return sorted(out)


def result(df, least=2):
    return sorted((r["ep"], r["first"], r["last"], r["n"], None if r["duration"] is None else round(r["duration"], 6), r["clock_steps_back"]) for r in collapse_runs(df, *COLS, least=least).collect())


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("least", [1, 2])
def test_random_sequences_equal_brute_force(spark, seed, least):
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        ep = rng.choice([0, 0, 0, 0, 1, 2, None]) if seed else 0
        base = rng.choice([0.0, 0.0, 0.0, 1.0])
        v = rng.choice([[base, base + 0.0009 * rng.randint(0, 4)]] * 8 + [None, [float("nan"), 0.0], [base], []])
        rows.append((ep, rng.choice([rng.randint(0, 400), None]) if rng.random() < 0.05 else rng.randint(0, 400), rng.choice([None, rng.randint(0, 50) / 10]), v, rng.choice([[base]] * 9 + [None]), None, "x", 1, "y"))
    seen, unique = set(), []
    for r in rows:  # versions that differ are tested below
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            unique.append(r)
    df = spark.createDataFrame(unique + unique[:50], SCHEMA).repartition(3)
    assert result(df, least) == brute(unique, least=least)


def test_one_run_over_all_chunks(spark):
    rows = [(7, i, i / 10, [1.0], [2.0], 1, "", 0, "") for i in range(5000)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == [(7, 0, 4999, 5000, 499.9, 0)]


def test_latest_version_counts_and_null_version_loses(spark):
    rows = [(1, 0, 0.0, [0.0], [0.0], 1, "", 0, ""), (1, 1, 0.1, [9.0], [0.0], None, "", 0, ""), (1, 1, 0.1, [0.0], [0.0], 5, "", 0, ""), (1, 1, 0.1, [7.0], [0.0], 2, "", 0, "")]
    assert result(spark.createDataFrame(rows, SCHEMA)) == [(1, 0, 1, 2, 0.1, 0)]


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_one_episode_over_many_chunks(spark):
    """10,000 chunks of one episode, each with one or two runs: runs join over any number of chunks."""
    rng = random.Random(8)
    rows, frames, value, at = [], [], 0.0, 0
    for chunk in range(10_000):
        own = []
        for k in range(rng.choice([1, 1, 1, 2])):
            if k or rng.random() < 0.2:
                value += 1.0
            own.append((at, at + 2, value))
            at += 3
        for k, (first, last, v) in enumerate(own):
            edge = (1 if k == 0 else 0) | (2 if k == len(own) - 1 else 0)
            frames += [(f, v) for f in range(first, last + 1)]
            rows.append((7, first, last, 3, first / 10, last / 10, 3, 0, chunk, edge, [[v]], [[v]]))
    got = sorted((r["first"], r["last"], r["n"], round(r["t_first"], 6), round(r["t_last"], 6), r["back"]) for r in merged_edges(spark.createDataFrame(rows, ENCODED).repartition(5), 0.002).collect())
    want, start = [], 0
    for i in range(1, len(frames) + 1):
        if i == len(frames) or frames[i][1] != frames[i - 1][1]:
            want.append((frames[start][0], frames[i - 1][0], i - start, round(frames[start][0] / 10, 6), round(frames[i - 1][0] / 10, 6), 0))
            start = i
    assert got == want

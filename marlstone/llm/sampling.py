"""A sample with given shares of categories.

Cells (strata) are counted once. Their probabilities minimise the relative entropy
to base probabilities under given moments and bounds: p = base * exp(features @
dual), kept between the cell's floor and 1, where the dual is found by damped
Newton steps whose gradient and Hessian need only the aggregated counts. With
targets for joint strata the base is proportional to the targets and the one moment
is the sample size, so what floors take and exhausted strata leave is shared among
the rest in proportion; with targets for margins each margin is a moment
(`margin_report`). Moments that the counts don't allow are missed by as little as a
quadratic penalty allows, and the gaps are reported.

The pivotal method then draws rows with exactly these probabilities: rounds of duels
between neighbours inside chunks, then across chunks of a stratum, then across
strata, so each stratum gets its total to within one row and the sample its size
exactly. A round leaves one undecided row per chunk and stratum, later one per
stratum, then one per chunk, until they fit one task.

A stratum of share 0 gets its floor only; strata of the targets without any row are
reported with 0. Rows whose stratum value is null or not in the targets are not
eligible; an empty table gives a sample of size 0 and probabilities of 0; a null
permille or floor counts as 0; equal rows are different rows as long as their ids
differ (ids must be unique: the draw and its random numbers depend on the id alone,
so it doesn't change with the order or partitioning of the rows); other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import small
from marlstone.session import stored

CHUNK_ROWS = 100_000


def tilt(features: np.ndarray, counts: np.ndarray, base: np.ndarray, totals: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None, steps: int = 300) -> np.ndarray:
    """Probability of a row of each cell: base * exp(features @ dual) kept in [low,
    high], with the moments sum(counts * p * features) as near to `totals` as they
    can be, by damped Newton steps on the (convex) dual."""
    base = np.broadcast_to(np.asarray(base, float), counts.shape)
    low = np.zeros(len(counts)) if low is None else low
    high = np.full(len(counts), np.inf) if high is None else high
    dual, scale = np.zeros(features.shape[1]), max(1.0, float(np.abs(totals).max(initial=0)))
    penalty = 1e-14 * scale  # a quadratic penalty on the dual: infeasible moments are missed, not chased for ever
    with np.errstate(divide="ignore"):
        at_low, at_high = np.log(low) - np.log(base), np.log(high) - np.log(base)

    def parts(d: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = np.clip(features @ d, -500, 500)
        raw = base * np.exp(eta)
        below, above = raw <= low, raw >= high
        p = np.where(below, low, np.where(above, high, raw))
        with np.errstate(invalid="ignore"):
            psi = np.where(below, np.where(low > 0, low * (1 + eta - at_low), 0), np.where(above, high * (1 + eta - at_high), raw))
        return float((counts * np.where(base > 0, psi, 0)).sum() - d @ totals + penalty / 2 * d @ d), p, ~(below | above)

    value, p, inside = parts(dual)
    for _ in range(steps):
        grad = features.T @ (counts * p) - totals + penalty * dual
        if np.abs(grad).max(initial=0) < 1e-13 * scale:
            break
        hess = (features * (counts * p * inside)[:, None]).T @ features
        step = np.linalg.solve(hess + (penalty + 1e-9 * max(np.trace(hess), 1e-3 * scale)) * np.eye(len(dual)), grad)
        step *= min(1.0, 20.0 / max(1e-300, float(np.abs(step).max())))
        size = 1.0
        while size > 1e-9:
            tried = parts(dual - size * step)
            if tried[0] <= value - 1e-4 * size * float(step @ grad):
                break
            size /= 2
        else:
            break
        dual, (value, p, inside) = dual - size * step, tried
    return p


def reachable(counts: np.ndarray, shares: np.ndarray, floors: np.ndarray, size: int) -> np.ndarray:
    """Probabilities of the cells whose totals are in proportion to `shares` where
    floors and counts allow it, and add up to `size` where they can."""
    p, low = np.zeros(len(counts)), np.minimum(1.0, floors / np.maximum(1, counts))
    some = counts > 0
    p[some] = low[some]
    on = some & (shares > 0)
    left = size - float((counts * low)[some & ~on].sum())
    if on.any() and left > 0:
        most = float(counts[on].sum())
        if left >= most:
            p[on] = 1.0
        elif left > float((counts * low)[on].sum()):
            p[on] = tilt(np.ones((int(on.sum()), 1)), counts[on].astype(float), shares[on] * left / shares[on].sum() / counts[on], np.array([left]), low[on], np.ones(int(on.sum())))
    return p


def duels(ids: np.ndarray, strata: np.ndarray, probs: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivotal method as rounds of duels between neighbours of a stratum: positions
    taken, and the undecided ones (one per stratum at most) with `probs` changed in
    place. Rows should be in order of stratum."""
    taken = [np.flatnonzero(probs >= 1 - 1e-9)]
    open_ = np.flatnonzero((probs < 1 - 1e-9) & (probs > 1e-12))
    number = 0
    while True:
        number += 1
        s = strata[open_]
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        place = np.arange(len(s)) - np.repeat(start, np.diff(np.r_[start, len(s)]))
        first = np.flatnonzero((place[:-1] % 2 == 0) & (s[1:] == s[:-1])) if len(s) > 1 else np.zeros(0, np.int64)
        if not len(first):
            return np.concatenate(taken), open_
        a, b = open_[first], open_[first + 1]
        p, q, u = probs[a], probs[b], _uniform(ids[a] ^ np.int64(number << 56), seed)
        total = p + q
        few = total < 1
        wins = np.where(few, u < p / total, u < (1 - q) / np.maximum(1e-300, 2 - total))  # a stays (few) or is taken
        stay, go = np.where(few == wins, a, b), np.where(few == wins, b, a)
        probs[go] = np.where(few, 0.0, 1.0)
        probs[stay] = np.where(few, total, total - 1)
        taken.append(go[~few])
        done = np.where(few & (total >= 1 - 1e-9), stay, -1)
        taken.append(done[done >= 0])
        open_ = open_[(probs[open_] < 1 - 1e-9) & (probs[open_] > 1e-9)]


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 2654435761 % 2**63)
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def pivotal_sample(rows: DataFrame, total_rows: int, seed: int = 17) -> DataFrame:
    """`id` of the sampled rows of `rows` (id bigint unique, stratum int, p double)."""
    out = "id bigint, stratum int, p double, taken boolean"

    def played(within: bool, last: bool, seed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pdf = pd.concat([pd.DataFrame({"id": [], "stratum": [], "p": []}), *batches]).sort_values(["stratum", "id"])
            ids, strata, probs = pdf["id"].to_numpy(np.int64), pdf["stratum"].to_numpy(np.int64), pdf["p"].to_numpy(np.float64, copy=True)
            taken, rest = duels(ids, strata if within else np.zeros(len(ids), np.int64), probs, seed)
            if last:  # what is left over is a rounding error of the probabilities
                taken, rest = np.r_[taken, rest[probs[rest] > 0.5]], rest[:0]
            at = np.r_[taken, rest]
            yield pd.DataFrame({"id": ids[at], "stratum": strata[at].astype(np.int32), "p": probs[at], "taken": np.r_[np.ones(len(taken), bool), np.zeros(len(rest), bool)]})

        return local

    cur, n, taken, step = rows.select("id", "stratum", "p"), total_rows, [], 0

    def over(key: str | None, within: bool) -> None:
        nonlocal cur, n, step
        chunks = max(1, -(-n // CHUNK_ROWS))
        spread = cur.repartition(chunks, F.xxhash64("id" if key is None else key))
        decided = stored(spread.mapInPandas(played(within, chunks == 1 and not within, seed + step), out), "duels")
        taken.append(decided.where("taken").select("id"))
        cur, step = decided.where("not taken").drop("taken"), step + 1
        n = cur.count()

    while n > CHUNK_ROWS:  # a row per chunk and stratum is left, so any stratum spreads over the chunks
        before = n
        over(None, True)
        if 2 * n > before:
            break
    over("stratum", True)  # a row per stratum is left
    while n > CHUNK_ROWS:  # a row per chunk is left
        over(None, False)
    over(None, False)
    result = taken[0]
    for part in taken[1:]:
        result = result.unionByName(part)
    return result


def strata_report(rows: DataFrame, strata: list[str], targets: list[dict], one_in: int = 10) -> list[dict]:
    """For each target stratum (bounded by the targets table): eligible rows,
    wanted and reachable totals, probability, and whether it falls short of its
    floor or of permille/1000 of the sample size (not rounded)."""
    named = rows.sparkSession.createDataFrame([tuple(t[s] for s in strata) for t in targets], rows.select(*strata).schema)
    wanted = rows.select(*strata).join(F.broadcast(named), strata, "left_semi")  # as many strata as targets at most
    found = {tuple(r[s] for s in strata): r["n"] for r in wanted.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.array([found.get(tuple(t[s] for s in strata), 0) for t in targets], np.int64)
    size = int(counts.sum()) // one_in
    permille = np.array([t["target_permille"] or 0 for t in targets], np.int64)
    floors = np.array([t["min_rows"] or 0 for t in targets], np.int64)
    p = reachable(counts, permille / 1000, floors, size) if size else np.zeros(len(targets))
    totals = p * counts
    return [
        {**t, "stratum": i, "eligible": int(n), "sample_size": size, "wanted": float(permille[i] * size / 1000), "reachable": float(totals[i]), "p": float(p[i]), "short": bool(n < floors[i] or n * 1000 < permille[i] * size)}
        for i, (t, n) in enumerate(zip(targets, counts.tolist(), strict=True))
    ]


def margin_report(cells: DataFrame, margins: dict[str, dict[object, float]], one_in: int = 10) -> tuple[list[dict], list[dict]]:
    """Probabilities of the cells when targets are given for each column alone, and
    the margins with their gaps. `cells` has a row per combination of the columns of
    `margins` and its count `n` (as many as the product of the target values at most;
    others are not eligible); `margins` maps a column to the share of each value."""
    for c, values in margins.items():
        cells = cells.where(F.col(c).isin(*values))
    known = [r.asDict() for r in small(cells, int(np.prod([len(v) for v in margins.values()])))]
    wanted = [(c, v, share) for c, values in margins.items() for v, share in values.items()]
    counts = np.array([r["n"] for r in known], float)
    size = int(counts.sum()) // one_in
    features = np.array([[float(r[c] == v) for c, v, _ in wanted] for r in known]).reshape(len(known), len(wanted))
    totals = np.array([share * size for *_, share in wanted])
    p = tilt(features, counts, np.full(len(known), size / max(1.0, counts.sum())), totals, high=np.ones(len(known))) if size else np.zeros(len(known))
    got = features.T @ (counts * p)
    return [{**r, "p": float(x)} for r, x in zip(known, p, strict=True)], [{"column": c, "value": v, "wanted": float(t), "reached": float(g), "gap": float(t - g)} for (c, v, _), t, g in zip(wanted, totals, got, strict=True)]

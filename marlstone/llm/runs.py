"""Runs of near-identical consecutive events, one row per run.

Rows are range-partitioned and sorted by (group, order), so every task holds a
contiguous chunk of the global order however many rows one group has. A chunk is
encoded into runs with NumPy over Arrow batches (state carried from batch to
batch); runs inside a chunk are final. The first and last run of each chunk are its
summary, at most two rows with their edge vectors. Summaries of neighbouring chunks
are merged in parallel, a block of them at a time, joined where the right edge of one
is like the left edge of the next; runs that no longer touch the edge of their block
are final, and the blocks are merged in the same way, in as many rounds as the
logarithm of the chunks. The merge is associative, so the result doesn't depend on
where chunks and blocks were cut.

Defined results: rows without group or order value are in no sequence; of rows
with equal group and order the latest `version` stands (null loses); a null
vector or one with a NaN is like nothing; an empty table gives no runs; columns
of other names are ignored. Duration is the last minus the first non-null time
of the run (null with fewer than two), `clock_steps_back` counts decreases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import stored

#: Chunks whose summaries one task merges.
FAN = 64
VECS = pa.list_(pa.list_(pa.float64()))
ENCODED = "g bigint, first bigint, last bigint, n bigint, t_first double, t_last double, n_time bigint, back bigint, chunk int, edge int, head array<array<double>>, tail array<array<double>>"
NAMES = ["g", "first", "last", "n", "t_first", "t_last", "n_time", "back", "chunk", "edge", "head", "tail"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), VECS, VECS]


def like_previous(column: pa.Array, tolerance: float) -> np.ndarray:
    """For each list value, whether it and the one before it have equal lengths
    and no component differs by more than `tolerance`. False for row 0."""
    n = len(column)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    valid = np.asarray(column.is_valid())
    offsets = np.asarray(column.offsets, dtype=np.int64)
    length = np.diff(offsets) * valid
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(n), length)
    here = np.arange(len(flat))
    same = np.zeros(n, bool)
    same[1:] = valid[1:] & valid[:-1] & (length[1:] == length[:-1])
    take = same[row]
    at, of = here[take], row[take]
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(flat[at] - flat[at - length[of]]) <= tolerance)
    return same & (np.bincount(of[bad], minlength=n) == 0)


def encode_runs(batches: Iterator[pa.RecordBatch], vectors: int, tolerance: float, chunk: int, least: int) -> Iterator[pa.RecordBatch]:
    """Runs of one sorted chunk. Columns: g, o, t, then the vectors. Edges: bit 1
    marks the first run of the chunk, bit 2 the last; others shorter than
    `least` are left out, as nothing can lengthen them."""
    held: pa.Table | None = None  # last kept row, to compare with
    open_run: list | None = None  # g, first, last, n, t_first, t_last, n_time, back, head
    left = True  # the chunk's first run has not been given out

    def vecs(t: pa.Table, i: int) -> list:
        return [t.column(3 + k)[i].as_py() for k in range(vectors)]

    def record(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
        if not t.num_rows:
            continue
        g, o = t.column(0).to_numpy(), t.column(1).to_numpy()
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
        if not keep.all():
            t = t.filter(pa.array(keep)).combine_chunks()
            g, o = g[keep], o[keep]
        skip = int(held is not None)  # row 0 already counts in open_run
        if len(g) == skip:
            continue
        alike = np.r_[False, g[1:] == g[:-1]]
        for k in range(vectors):
            alike &= like_previous(t.column(3 + k).chunk(0), tolerance)
        time = t.column(2).to_numpy().astype(np.float64)
        ok = ~np.isnan(time)
        ok[:skip] = False
        at = np.flatnonzero(~alike)
        bounds = np.unique(np.r_[skip, at[at >= skip], len(g)])
        a, b = bounds[:-1], bounds[1:]
        index = np.arange(len(g))
        run_of = np.searchsorted(bounds, index, "right") - 1
        n_ok = np.add.reduceat(ok, a, dtype=np.int64)
        first_ok = np.minimum.reduceat(np.where(ok, index, len(g) - 1), a)
        last_ok = np.maximum.reduceat(np.where(ok, index, 0), a)
        before = np.r_[0, np.maximum.accumulate(np.where(ok, index, 0))[:-1]]
        back = ok & ok[before] & (run_of == run_of[before]) & (time < time[before])
        n_back = np.add.reduceat(back, a, dtype=np.int64)
        t_first, t_last = (np.where(n_ok > 0, time[i], np.nan) for i in (first_ok, last_ok))
        first, n, head0 = o[a].copy(), b - a, None
        if open_run is not None and alike[skip]:  # its last run goes on in this batch
            if n_ok[0] and open_run[6] and t_first[0] < open_run[5]:
                n_back[0] += 1
            first[0], n[0], head0 = open_run[1], n[0] + open_run[3], open_run[8]
            t_first[0] = open_run[4] if open_run[6] else t_first[0]
            t_last[0] = t_last[0] if n_ok[0] else open_run[5]
            n_ok[0], n_back[0] = n_ok[0] + open_run[6], n_back[0] + open_run[7]
            open_run = None
        if open_run is not None:  # ended with the row before this batch
            if left or open_run[3] >= least:
                yield record([[x] for x in (*open_run[:8], chunk, int(left), open_run[8] if left else None, vecs(t, 0) if left else None)])
            left = False
        m = len(a) - 1
        done = (n[:m] >= least) | (left & (np.arange(m) == 0))
        if done.any():
            i = np.flatnonzero(done)
            edge = (left & (i == 0)).astype(np.int32)
            head = [(head0 or vecs(t, int(a[0]))) if e else None for e in edge]
            tail = [vecs(t, int(b[0]) - 1) if e else None for e in edge]
            yield record([g[a[i]], first[i], o[b[i] - 1], n[i], t_first[i], t_last[i], n_ok[i], n_back[i], np.full(len(i), chunk, np.int32), edge, head, tail])
        left &= m == 0
        z = int(a[m])
        open_run = [int(g[z]), int(first[m]), int(o[-1]), int(n[m]), float(t_first[m]), float(t_last[m]), int(n_ok[m]), int(n_back[m]), head0 if m == 0 and head0 is not None else vecs(t, z)]
        held = t.slice(len(g) - 1, 1)
    if open_run is not None:
        yield record([[x] for x in (*open_run[:8], chunk, 3 if left else 2, open_run[8], vecs(held, 0))])


def alike(a: list | None, b: list | None, tolerance: float) -> bool:
    """Whether the vectors of two edges are all alike."""
    if a is None or b is None:
        return False
    for x, y in zip(a, b, strict=True):
        if x is None or y is None or len(x) != len(y) or any(p is None or q is None or not abs(p - q) <= tolerance for p, q in zip(x, y, strict=True)):
            return False
    return True


def joined(x: dict, y: dict) -> dict:
    """One run of two that follow each other."""
    back = x["back"] + y["back"] + int(bool(x["n_time"] and y["n_time"]) and y["t_first"] < x["t_last"])
    return x | {
        "last": y["last"], "n": x["n"] + y["n"], "n_time": x["n_time"] + y["n_time"], "back": back, "t_first": x["t_first"] if x["n_time"] else y["t_first"], "t_last": y["t_last"] if y["n_time"] else x["t_last"],
        "edge": x["edge"] & 1 | y["edge"] & 2, "tail": y["tail"],
    }


def merge_chunks(edges: list[dict], tolerance: float) -> list[dict]:
    """Runs of a block from the edge rows of its chunks, in order of chunk and place.
    Bits of `edge`: 1 the run begins its block, 2 it ends it; others are final."""
    out: list[dict] = []
    for row in edges:
        if out and row["edge"] & 1 and out[-1]["edge"] & 2 and out[-1]["g"] == row["g"] and alike(out[-1]["tail"], row["head"], tolerance):
            out[-1] = joined(out[-1], row)
        else:
            out.append(row | {"edge": row["edge"] & 2 if out else row["edge"]})
    for row in out[:-1]:
        row["edge"] &= 1
    return out


def merged_edges(edges: DataFrame, tolerance: float, fan: int = FAN) -> DataFrame:
    """The final runs of the edge rows of all chunks, merged `fan` chunks at a time."""
    done, cur = None, edges
    while True:
        most = cur.agg(F.max("chunk")).first()[0]
        if most is None:
            break

        def local(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["chunk", "edge_at"])
            rows = merge_chunks(pdf.to_dict("records"), tolerance)
            return pd.DataFrame([r | {"chunk": int(key[0]), "edge_at": i} for i, r in enumerate(rows)], columns=pdf.columns)

        block = cur if "edge_at" in cur.columns else cur.withColumn("edge_at", F.when(F.col("edge") == 2, 1).otherwise(0))
        merged = stored(block.groupBy(F.floor(F.col("chunk") / fan)).applyInPandas(local, block.schema), "merged")
        ended = merged.where("edge = 0") if most >= fan else merged
        done = ended if done is None else done.unionByName(ended)
        if most < fan:
            break
        cur = merged.where("edge > 0")
    return (edges.limit(0) if done is None else done).select("g", "first", "last", "n", "t_first", "t_last", "n_time", "back")


def collapse_runs(df: DataFrame, group: str, order: str, time: str, vectors: list[str], version: str, tolerance: float = 0.002, least: int = 2) -> DataFrame:
    """`group, first, last, n, duration, clock_steps_back` of each maximal run of
    at least `least` rows whose `vectors` are each like those of the row before."""
    frames = df.select(
        F.col(group).cast("bigint").alias("g"), F.col(order).cast("bigint").alias("o"), F.col(time).cast("double").alias("t"), *[F.col(v).cast("array<float>").alias(f"v{i}") for i, v in enumerate(vectors)], F.col(version).alias("_ver")
    ).where("g is not null and o is not null")
    chunks = frames.repartitionByRange("g", "o").sortWithinPartitions("g", "o", F.col("_ver").desc_nulls_last()).drop("_ver")
    k = len(vectors)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from encode_runs(batches, k, tolerance, TaskContext.get().partitionId(), least)

    encoded = stored(chunks.mapInArrow(local, ENCODED), "runs")
    inner = encoded.where("edge = 0").select("g", "first", "last", "n", "t_first", "t_last", "n_time", "back")
    edges = merged_edges(encoded.where("edge > 0"), tolerance).where(F.col("n") >= least)
    return inner.unionByName(edges).select(
        F.col("g").alias(group), "first", "last", "n", F.when(F.col("n_time") > 1, F.col("t_last") - F.col("t_first")).alias("duration"), F.col("back").alias("clock_steps_back")
    )

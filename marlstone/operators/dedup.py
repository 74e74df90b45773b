"""Near-duplicate removal by min-hash banding, verification and components.

Equal texts are one class from the start, so a group of copies costs one set of
bands per task. Every other text gets the minima of `permutations` hash functions
over its distinct character windows, cut into bands. In every bucket of a band the
least id is the representative; the others are compared with it (a star, never all
pairs) and linked where the Jaccard similarity of the exact window sets reaches the
threshold. Those that fail stay in the bucket and get new representatives among
themselves, two, then four, and so on, until no bucket has two texts left. Components of the
verified links are the classes and the least id of each class survives. Null texts
are kept as they are.

No class holds a link below the threshold; what banding doesn't bring together and
what is only like a text that already found another representative may be missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import window_hashes
from marlstone.operators.components import components
from marlstone.session import spread, stored

#: Texts a task remembers, so that copies are signed once.
REMEMBERED = 200_000


def band_shape(threshold: float, permutations: int) -> tuple[int, int]:
    """(bands, rows) with the least sum of false positive and false negative area
    around the threshold."""
    t = np.linspace(0, 1, 1001)
    best = (np.inf, 1, 1)
    for rows in range(1, permutations + 1):
        for bands in range(1, permutations // rows + 1):
            hit = 1 - (1 - t**rows) ** bands
            area = np.trapezoid(hit[t <= threshold], t[t <= threshold]) + np.trapezoid(1 - hit[t >= threshold], t[t >= threshold])
            if area < best[0] - 1e-12:
                best = (area, bands, rows)
    return best[1], best[2]


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of the 32-bit hash functions a * x + b over the low halves."""
    low = hashes.astype(np.uint32)
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(low), 512):
        out = np.minimum(out, (a[:, None] * low[None, start : start + 512] + b[:, None]).min(axis=1))
    return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = minima.reshape(bands, rows).astype(np.uint64)
    acc = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        acc = (acc ^ parts[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(31)
    return acc.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of distinct values."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def verified_links(buckets: DataFrame, texts: DataFrame, window: int, threshold: float) -> DataFrame:
    """`src, dst` of texts (id, t) that share a bucket of `buckets` (band, id), were
    compared as representative and member, and are as similar as the threshold."""
    def shared(e: DataFrame) -> DataFrame:
        return e.join(e.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band"), "band", "left_semi")

    entries = stored(shared(buckets), "entries")
    known = stored(texts.join(entries.select("id").distinct(), "id", "left_semi"), "linked")
    kind = texts.schema["id"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[object, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for src, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if held[0] != src:
                    held = (src, np.unique(window_hashes(a.lower(), window)))
                keep.append(jaccard(held[1], np.unique(window_hashes(b.lower(), window))) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    links, reps = None, 1
    while entries.take(1):
        first = Window.partitionBy("band").orderBy("id")
        stars = entries.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= reps).select("band", F.col("id").alias("src"))
        met = entries.join(stars, "band").where("id > src")
        pairs = met.select("src", F.col("id").alias("dst")).distinct()
        pairs = pairs.join(known.select(F.col("id").alias("src"), F.col("t").alias("a")), "src").join(known.select(F.col("id").alias("dst"), F.col("t").alias("b")), "dst")
        good = stored(pairs.select("src", "dst", "a", "b").sortWithinPartitions("src").mapInArrow(check, f"src {kind}, dst {kind}"), "good")
        links = good if links is None else links.unionByName(good)
        served = met.join(good.select("src", F.col("dst").alias("id")), ["src", "id"], "left_semi").select("band", "id").unionByName(stars.withColumnRenamed("src", "id"))
        left = entries.join(served, ["band", "id"], "left_anti")
        entries = stored(shared(left), "entries")
        reps *= 2
    return links if links is not None else entries.select(F.col("id").alias("src"), F.col("id").alias("dst"))


def duplicate_classes(df: DataFrame, key: str, text: str, window: int = 5, threshold: float = 0.7, permutations: int = 256, seed: int = 7) -> DataFrame:
    """`key`, class of every row with a text: the least key of its class."""
    bands, rows = band_shape(threshold, permutations)
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, copies = [], []
            for t in batch.column(1).to_pylist():
                t = t.lower()
                own = hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()
                copies.append(own)
                if t and own not in seen:
                    keys.append(band_keys(signature(window_hashes(t, window), a, b), bands, rows))
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(own)
                else:
                    keys.append(np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            values = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(copies, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(values))], names=["id", "h", "bands"])

    kind = texts.schema["id"].dataType.simpleString()
    signed = stored(spread(texts).mapInArrow(sign, f"id {kind}, h binary, bands array<bigint>"), "signed")
    leaders = signed.groupBy("h").agg(F.min("id").alias("leader"))
    banded = signed.where(F.size("bands") > 0).join(leaders, "h").select(F.col("leader").alias("id"), F.explode("bands").alias("band")).distinct()
    found = components(verified_links(stored(banded, "bands"), texts, window, threshold))
    classes = leaders.join(found, leaders["leader"] == found["node"], "left").select("h", F.coalesce("component", "leader").alias("class"))
    return signed.join(classes, "h").select(F.col("id").alias(key), "class")


def minhash_dedup(df: DataFrame, key: str, text: str, **params: object) -> DataFrame:
    """The rows of `df` that are the least of their class, and those without text."""
    df = stored(df, "texts")
    kept = duplicate_classes(df, key, text, **params).where(F.col("class") == F.col(key)).select(key)
    return df.join(kept, key, "left_semi").unionByName(df.where(F.col(text).isNull()))

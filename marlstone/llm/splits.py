"""Splits that keep related records together.

Records naming several entities tie these entities together (components); an
entity's weight is its number of records. Weights are balanced by largest
differencing: inside each bucket of entities, sorted weights are laid out as
tuples over `bins` slots, and the two tuples of widest spread are combined,
largest slot onto smallest, until one tuple is left; the buckets' tuples are
combined in the same way, up to 64 in a task, in rounds until one is left. The resulting nearly equal bins are given whole to the
splits, heaviest first, each to the split furthest below its target.

Only the `bins` sums of the last tuple of each kind reach the driver.
Rows without an entity or kind are in no split, an entity without weight weighs 0,
repeated links change nothing, an empty table gives no rows, and columns that
aren't named are ignored. Equal weights go by name. An entity heavier than a bin fills one
by itself, so a split may exceed its target by at most the heaviest entity.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import squeezed
from marlstone.operators.components import components
from marlstone.session import lookup_join, stored

BINS = 500
BUCKET_ENTITIES = 500_000
#: Buckets whose tuples one task combines.
MERGED = 64


def difference(tuples: list[tuple[np.ndarray, list[list]]]) -> tuple[np.ndarray, list[list]]:
    """Largest differencing over tuples (sums by slot, members by slot)."""
    heap = []
    for i, (sums, members) in enumerate(tuples):
        order = np.argsort(-sums, kind="stable")
        heap.append((float(sums[order[-1]] - sums[order[0]]), i, sums[order], [members[j] for j in order]))
    heapq.heapify(heap)
    i = len(heap)
    while len(heap) > 1:
        _, _, sa, ma = heapq.heappop(heap)
        _, _, sb, mb = heapq.heappop(heap)
        sums, members = sa + sb[::-1], []
        for x, y in zip(ma, reversed(mb), strict=True):
            x, y = (x, y) if len(x) >= len(y) else (y, x)
            x.extend(y)
            members.append(x)
        order = np.argsort(-sums, kind="stable")
        heapq.heappush(heap, (float(sums[order[-1]] - sums[order[0]]), i, sums[order], [members[j] for j in order]))
        i += 1
    return heap[0][2], heap[0][3]


def balance_bucket(weights: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each weight, and the sums by slot."""
    order = np.argsort(-weights, kind="stable")
    tuples = []
    for start in range(0, len(order), bins):
        block = order[start : start + bins]
        sums = np.zeros(bins)
        sums[: len(block)] = weights[block]
        tuples.append((sums, [[int(j)] for j in block] + [[] for _ in range(bins - len(block))]))
    sums, members = difference(tuples)
    slot = np.empty(len(weights), np.int32)
    for s, m in enumerate(members):
        slot[m] = s
    return slot, sums


def entity_groups(links: DataFrame) -> DataFrame:
    """`kind, entity, component` of `links` (kind, record, entity): entities that
    one record names together share a component, named by its smallest entity."""
    clean = links.where("kind is not null and entity is not null")
    per = clean.where("record is not null").groupBy("kind", "record").agg(F.min("entity").alias("a"), F.max("entity").alias("b"))
    tied = per.where("a <> b").select("kind", "record", "a")
    key = lambda k, e: F.concat(k, F.lit("\u0001"), e)
    ties = stored(clean.join(tied, ["kind", "record"]).select(key(F.col("kind"), F.col("a")).alias("src"), key(F.col("kind"), F.col("entity")).alias("dst")).distinct(), "ties")
    entities = clean.select("kind", "entity").distinct()
    if not ties.take(1):  # every record has one entity: each is its own component
        return entities.withColumn("component", F.col("entity"))
    found = components(ties).select(F.col("node").alias("_node"), F.substring_index("component", "\u0001", -1).alias("_component"))
    return entities.join(found, key(F.col("kind"), F.col("entity")) == F.col("_node"), "left").select("kind", "entity", F.coalesce("_component", "entity").alias("component"))


def assign_splits(weights: DataFrame, targets: list[tuple[str, int]], bins: int = BINS, bucket_entities: int = BUCKET_ENTITIES) -> DataFrame:
    """`kind, component, weight, bin, split` of `weights` (kind, component, weight)."""
    w = stored(weights.select("kind", "component", F.col("weight").cast("bigint").alias("weight")), "weights")
    buckets = max(1, -(-w.count() // bucket_entities))
    slots = "kind string, component string, weight bigint, bucket int, slot int"

    def local(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "component"], ascending=[False, True], ignore_index=True)
        pdf["slot"] = balance_bucket(pdf["weight"].to_numpy(float), bins)[0]
        return pdf[["kind", "component", "weight", "bucket", "slot"]]

    bucketed = w.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)).cast("int"))
    placed = stored(bucketed.groupBy("kind", "bucket").applyInPandas(local, slots), "slots")
    schema = "kind string, bucket int, slot int, w bigint, up int, upslot int"

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tuples = []
        for bucket, own in pdf.groupby("bucket"):
            total = np.zeros(bins)
            total[own["slot"]] = own["w"]
            tuples.append((total, [[(int(bucket), s)] for s in range(bins)]))
        to = {pair: slot for slot, pairs in enumerate(difference(tuples)[1]) for pair in pairs}
        return pdf.assign(up=int(key[1]), upslot=[to[b, s] for b, s in zip(pdf["bucket"], pdf["slot"], strict=True)])

    while buckets > 1:
        sums = placed.groupBy("kind", "bucket", "slot").agg(F.sum("weight").alias("w"))
        moved = stored(sums.groupBy("kind", F.floor(F.col("bucket") / MERGED)).applyInPandas(merge, schema), "merged")
        placed = lookup_join(placed, moved.drop("w"), ["kind", "bucket", "slot"], "inner", moved.count()).select("kind", "component", "weight", F.col("up").alias("bucket"), F.col("upslot").alias("slot"))
        buckets = -(-buckets // MERGED)
    rows = []
    sums = placed.groupBy("kind", "slot").agg(F.sum("weight").alias("w")).toPandas()  # at most `bins` of each kind
    for kind, part in sums.groupby("kind"):
        share = sum(p for _, p in targets)
        short = {name: part["w"].sum() * p / share for name, p in targets}
        for b, (slot, weight) in enumerate(sorted(zip(part["slot"], part["w"], strict=True), key=lambda x: (-x[1], x[0]))):
            name = max(short, key=lambda s: short[s])
            short[name] -= weight
            rows.append((kind, int(slot), b, name))
    where = w.sparkSession.createDataFrame(rows, "kind string, slot int, bin int, split string")
    return lookup_join(placed, where, ["kind", "slot"], "inner", len(rows)).select("kind", "component", "weight", "bin", "split")


def split_name(raw: Column, names: list[str]) -> Column:
    """The target split a spelling names: the only one of which it is a
    beginning or which is a beginning of it; another label stands for itself;
    null and blank name none."""
    x = F.regexp_replace(squeezed(raw), r"[^\p{L}\p{N}]+", "")
    hit = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: x.startswith(n) | n.startswith(x))
    return F.when(F.length(x) > 0, F.when(F.size(hit) == 1, hit[0]).otherwise(x))


def torn_entities(records: DataFrame, groups: DataFrame) -> DataFrame:
    """`kind, entity` of the entities whose component's records (kind, entity,
    split) name more than one split. Least and greatest name are aggregated, so a
    hot entity combines before the shuffle."""
    named = records.where("split is not null").groupBy("kind", "entity").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    by_group = named.join(groups, ["kind", "entity"]).groupBy("kind", "component").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    torn = by_group.where("lo <> hi").select("kind", "component")
    return groups.join(torn, ["kind", "component"]).select("kind", "entity")

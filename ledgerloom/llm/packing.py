"""Filling fixed-capacity containers with documents.

Method: harmonic packing. A length in (C/(k+1), C/k] belongs to class k, of which exactly k fit in a container; classes
are filled independently in every shard, so no global order is needed. Before a class opens its own containers, its
items are offered the room left over in containers of the longer classes (best fit), which is where plain harmonic
packing loses most. Lengths up to C/classes form the last class: it tops up what is left, then fills by next fit.

Defined results: a document of more than C tokens is split into full containers of its own and one remainder, which is
packed like a document; nothing else is split. An empty or null text has length 0 and is packed like any short item.
A shard holds about `per_shard` items, so its memory is bounded and its unfilled containers (at most one per class) are
few against those it fills. Repeated documents are packed once. Ties go by the document's id. Containers of whole parts
have numbers below zero, the others from zero on; no two containers share one.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.durable import durable


def pack_shard(items: list[tuple[int, int, int]], capacity: int, classes: int) -> list[tuple[int, int, int, int]]:
    """(doc, part, size) to (doc, part, bin, offset); bins are numbered from 0, sizes are at most the capacity."""
    by_class: dict[int, list[tuple[int, int, int]]] = {}
    for doc, part, size in items:
        by_class.setdefault(min(classes, capacity // size) if size else classes, []).append((size, doc, part))
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    bins, out = 0, []
    for k in sorted(by_class):
        own, free = 0, 0  # the open container of this class: items it still takes, room it has
        at = -1
        for size, doc, part in sorted(by_class[k], key=lambda x: (-x[0], x[1], x[2])):
            i = bisect_left(room, (size, -1))
            if i < len(room):
                left, b = room.pop(i)
                out.append((doc, part, b, capacity - left))
                if left > size:
                    insort(room, (left - size, b))
                continue
            if not own or size > free:
                if at >= 0 and free:
                    insort(room, (free, at))
                at, own, free, bins = bins, (k if k < classes else 1 << 60), capacity, bins + 1
            out.append((doc, part, at, capacity - free))
            own, free = own - 1, free - size
        if at >= 0 and free:
            insort(room, (free, at))
    return out


def pack(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "tokens", classes: int = 24, per_shard: int = 50_000) -> DataFrame:
    """(key, part, container BIGINT, start_at BIGINT, tokens BIGINT): where each document, or part of one, lies."""
    if capacity < 1 or classes < 1:
        raise ValueError("capacity and classes must be at least 1")
    # Sizes may cost far more than the packing (they are a tokenizer's): they are computed once, then counted and packed.
    items = durable(sizes.select(F.col(key).cast("bigint").alias("doc"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("n")).groupBy("doc").agg(F.max("n").alias("n")))
    shards = max(1, -(-items.count() // per_shard))
    full = F.when(F.col("n") > capacity, F.floor((F.col("n") - 1) / capacity)).otherwise(0).cast("bigint")
    items = items.withColumn("full", full).withColumn("rest", F.col("n") - F.col("full") * capacity).withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(shards)))
    small = items.select("doc", F.col("full").alias("part"), F.col("rest").alias("size"), "shard")
    # Full containers hold one part each; a shard numbers its own one after the other.
    before = F.sum("full").over(Window.partitionBy("shard").orderBy("doc")) - F.col("full")
    whole = items.where("full > 0").withColumn("before", before).select("doc", "shard", "before", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("part"))
    filled = whole.select("doc", "part", (-1 - ((F.col("before") + F.col("part")) * shards + F.col("shard"))).alias("container"), F.lit(0).cast("bigint").alias("start_at"), F.lit(capacity).cast("bigint").alias("tokens"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        sizes_of = {(d, p): s for d, p, s in zip(rows["doc"].tolist(), rows["part"].tolist(), rows["size"].tolist())}
        placed = pack_shard([(d, p, s) for (d, p), s in sizes_of.items()], capacity, classes)
        return pd.DataFrame([(d, p, b * shards + shard, at, sizes_of[d, p]) for d, p, b, at in placed], columns=["doc", "part", "container", "start_at", "tokens"]).astype("int64")

    packed = small.groupBy("shard").applyInPandas(run, "doc bigint, part bigint, container bigint, start_at bigint, tokens bigint")
    return packed.unionByName(filled).withColumnRenamed("doc", key)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, tokens, unused_share): one row."""
    bins = packed.groupBy("container").agg(F.sum("tokens").alias("used"))
    return bins.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), (1 - F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("unused_share"))

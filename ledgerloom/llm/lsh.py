"""MinHash banding, verified links of all pairs that share a bucket, connected components and star clusters.

Shared by the operators on names and addresses. Everything stays distributed; loops cut their lineage with durable
tables, and only counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.durable import drop, durable
from ledgerloom.sources.tables import spread

#: A bucket of more members is worked in blocks.
HOT = 128


def collision(similarity: float, rows: int, bands: int) -> float:
    """The chance that two sets of a Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The fewest bands whose collision curve reaches the recall at the similarity."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


class MinHasher:
    """Band keys of sets of strings; the permutations follow from the seed."""

    def __init__(self, rows: int, bands: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.rows, self.bands = rows, bands
        self.a = draw.integers(0, 1 << 63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, rows * bands, dtype=np.uint64)

    def keys(self, shingles: Iterable[str]) -> list[int]:
        """One signed 64-bit key a band; none for an empty set."""
        x = np.fromiter((xxhash.xxh64_intdigest(s) for s in set(shingles)), dtype=np.uint64)
        if not len(x):
            return []
        # Multiplication by odd numbers permutes the 64-bit keys.
        least = (self.a[:, None] * x[None, :] + self.b[:, None]).min(axis=1).reshape(self.bands, self.rows)
        return [xxhash.xxh64_intdigest(np.append(band, np.uint64(i)).tobytes()) - (1 << 63) for i, band in enumerate(least)]


def qgrams(text: str, q: int = 3, pad: str = "#") -> set[str]:
    padded = pad * (q - 1) + text + pad * (q - 1)
    return {padded[i : i + q] for i in range(len(padded) - q + 1)} if text else set()


def links(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    hot: int = HOT,
    rounds: int | None = None,
    early: Callable[[DataFrame], DataFrame] | None = None,
    slices: int = 1,
) -> DataFrame:
    """The verified links of all buckets. members: (bucket, id BIGINT, ...); verify: (a, b) -> links with at least (a, b).

    Every pair of a bucket is verified, once however many buckets it shares: likeness isn't transitive, so no member can
    stand for another. A bucket of more than `hot` members is dealt into blocks of about that many, and each pair of
    blocks is a task's key of its own. rounds is without effect.

    early: drops pairs that can't be links, where they meet and before they are moved; it gets the further columns of the
    members as <name>_a and <name>_b. With slices > 1, members have a column slice (0 to slices - 1): one slice after the
    other is worked, so that the disk holds the buckets and pairs of one only. A pair that shares buckets of several
    slices comes to verify in each of them, with its slice: verify keeps it in the least slice that it shares.
    """
    more = [c for c in members.columns if c not in ("bucket", "id", "rank", "slice")]
    found = None
    for s in range(slices):
        part = members.where(F.col("slice") == s) if slices > 1 else members
        met = _met(part.select("bucket", "id", *more))
        pairs = _pairs(met, more, hot, early)
        now = durable(verify(pairs.withColumn("slice", F.lit(s)) if slices > 1 else pairs))
        drop(met)
        found = now if found is None else found.unionByName(now)
    return found


def _met(members: DataFrame) -> DataFrame:
    """The members of buckets that hold pairs of their own, with n, the size of the bucket."""
    # One exchange by bucket serves the counts and the join; most buckets hold one member and go before anything else.
    members = members.repartition("bucket")
    # A bucket with the very same members as another adds nothing; most buckets of clear duplicates repeat.
    sized = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"), F.min("id").alias("first")).where("n > 1")
    kept = sized.groupBy("n", "sum", "first").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    return durable(members.join(kept.hint("merge"), "bucket"))


def _pairs(members: DataFrame, more: list[str], hot: int, early: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(a, b), a < b: the members of one bucket, once a pair."""
    dealt = members.withColumn("k", F.ceil(F.col("n") / hot).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct(F.least(i, F.col("block")).alias("i"), F.greatest(i, F.col("block")).alias("j")))
    # Comparing costs far more than the bytes of a member tell: spread by row, not by size.
    celled = spread(dealt.select("bucket", "id", "block", *more, F.inline(cells)), None, "bucket", "i", "j")
    side = lambda s: celled.select("bucket", "i", "j", *[F.col(c).alias(f"{c}_{s}") for c in ("block", *more)], F.col("id").alias(s))
    # Two members of one block share the cells of that block with all others, but are a pair of its own cell only.
    pairs = side("a").join(side("b").hint("merge"), ["bucket", "i", "j"]).where("a < b AND i = least(block_a, block_b) AND j = greatest(block_a, block_b)")
    # By a alone: so the same exchange serves the join that follows.
    return spread((early(pairs) if early else pairs).select("a", "b"), None, "a").distinct()


def matched(pairs: DataFrame, features: DataFrame, keep: Column | None = None) -> DataFrame:
    """Pairs with the features (id, ...) of both as <name>_a and <name>_b, spread over all cores by b; keep: which to keep."""
    side = lambda s: spread(features.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in features.columns if c != "id"]), None, s)
    both = pairs.join(side("a").hint("merge"), "a")
    both = spread(both, None, "b").join(side("b").hint("merge"), "b")
    return both if keep is None else both.where(keep)


#: How many members of buckets are worked at a time, and the most slices.
SLICE, MOST_SLICES = 2_000_000, 128


def slices_for(members: int) -> int:
    return max(1, min(MOST_SLICES, math.ceil(members / SLICE)))


def slice_of(evidence: Column, slices: int) -> Column:
    """The slice of a piece of evidence."""
    return F.pmod(F.xxhash64(evidence), F.lit(slices)).cast("int")


def least_slice(a: Column, b: Column, slices: int) -> Column:
    """The least slice of what evidence two nodes share: arrays of strings."""
    return F.array_min(F.transform(F.array_intersect(a, b), lambda e: slice_of(e, slices)))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of each node's component, by alternating large and small stars."""
    now = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        past, now = now, durable(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        drop(past)
    roots = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("id")).distinct().join(roots.select("id"), "id", "left_anti").withColumn("root", F.col("id")))


def star_clusters(edges: DataFrame) -> DataFrame:
    """(id, center) of every node with an edge (a, b, weight): stars around nodes of greatest degree.

    In each round a free node that no free neighbour outranks (by degree, then lesser id) becomes a center; its free
    neighbours become satellites of the center they are most similar to, until no node is free.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight").unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), "weight"))
    degree = both.groupBy("x").agg(F.count(F.lit(1)).alias("d"))
    both = durable(both.join(degree.select(F.col("x").alias("y"), F.struct("d", (-F.col("x")).alias("i")).alias("ry")).hint("merge"), "y"))
    free = durable(degree.select("x", F.struct("d", (-F.col("x")).alias("i")).alias("rx")))
    done = []
    while not free.isEmpty():
        # A free node meets its free neighbours only.
        alive = both.join(free.hint("merge"), "x").join(free.select(F.col("x").alias("y")).hint("merge"), "y", "left_semi")
        top = free.join(alive.groupBy("x").agg(F.max("ry").alias("top")), "x", "left")
        centers = top.where("top IS NULL OR rx > top").select(F.col("x").alias("c"))
        near = alive.join(centers.select(F.col("c").alias("y")).hint("merge"), "y", "left_semi").groupBy("x").agg(F.max_by("y", F.struct("weight", "ry")).alias("center"))
        new = durable(centers.select(F.col("c").alias("id"), F.col("c").alias("center")).unionByName(near.select(F.col("x").alias("id"), "center")))
        done.append(new)
        past, free = free, durable(free.join(new.select(F.col("id").alias("x")).hint("merge"), "x", "left_anti"))
        drop(past)
    out = done[0] if done else free.select(F.col("x").alias("id"), F.col("x").alias("center"))
    for more in done[1:]:
        out = out.unionByName(more)
    return out

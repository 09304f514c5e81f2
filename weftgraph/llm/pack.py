"""Filling containers of fixed capacity with items.

The lengths of all items form one histogram, which has at most as many entries as the capacity.
Dynamic programming over it chooses the upper bounds of length buckets so that rounding every item
up to its bucket's bound wastes least. Batches are then planned on the bounds alone: a container
takes as many items of one bucket as its token budget allows, largest bucket first, and is topped
up from smaller buckets. The plan is a list of at most a few hundred patterns with multiplicities,
so the driver handles no item; each item finds its container from its rank in its bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 128
SHARE = 500_000  # items of a bucket that one task ranks, about


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, k: int = BUCKETS) -> np.ndarray:
    """Upper bounds, among ``lengths`` (ascending), of at most k buckets with the least total padding.

    The cost of a bucket is concave in the sense of Monge, so the best last cut moves only upwards
    and each layer is solved by divide and conquer.
    """
    n = len(lengths)
    if n <= k:
        return lengths.copy()
    c = np.concatenate(([0], np.cumsum(counts, dtype=np.float64)))
    w = np.concatenate(([0], np.cumsum(counts * lengths, dtype=np.float64)))
    ends = np.arange(1, n + 1)
    best = lengths[ends - 1] * c[ends] - w[ends]  # one bucket for the first i lengths
    best = np.concatenate(([0.0], best))
    choice = np.zeros((k, n + 1), np.int32)
    for layer in range(1, k):
        new = np.full(n + 1, np.inf)
        new[0] = 0.0
        # all midpoints of one depth at a time: (first, last, low, high) of each open range
        open_ranges = [(1, n, 0, n - 1)]
        while open_ranges:
            nxt = []
            for first, last, low, high in open_ranges:
                i = (first + last) // 2
                j = np.arange(low, min(high, i - 1) + 1)
                cost = best[j] + lengths[i - 1] * (c[i] - c[j]) - (w[i] - w[j])
                at = int(cost.argmin())
                new[i], choice[layer, i] = cost[at], j[at]
                if first < i:
                    nxt.append((first, i - 1, low, int(j[at])))
                if i < last:
                    nxt.append((i + 1, last, int(j[at]), high))
            open_ranges = nxt
        best = new
    bounds, i = [], n
    for layer in range(k - 1, -1, -1):
        if i == 0:
            break
        bounds.append(lengths[i - 1])
        i = int(choice[layer, i]) if layer else 0
    return np.array(sorted(set(bounds)))


def plan_batches(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(multiplicity, [(bucket, items)...]) of the containers; every item of every bucket is placed."""
    left = [int(x) for x in counts]
    size = [int(x) for x in bounds]
    plan = []
    for top in range(len(size) - 1, -1, -1):
        while left[top]:
            room, pattern = capacity, []
            for b in range(top, -1, -1):
                n = min(room // size[b], left[b])
                if n:
                    pattern.append((b, n))
                    room -= n * size[b]
            times = min(left[b] // n for b, n in pattern)
            for b, n in pattern:
                left[b] -= times * n
            plan.append((times, pattern))
    return plan


def divide(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, tok_start, tok_end) of items, those over the capacity in full pieces and a rest."""
    c = F.lit(capacity)
    n = F.greatest(F.ceil(F.col(size) / c), F.lit(1)).cast("int")
    p = items.select(F.col(key), F.col(size).alias("_n"), F.explode(F.sequence(F.lit(1), n)).alias("piece_no"))
    start = (F.col("piece_no") - 1).cast("long") * c
    return p.select(key, "piece_no", start.alias("tok_start"), F.least(start + c, F.col("_n")).alias("tok_end"))


def pack(items: DataFrame, key: str, size: str, capacity: int, buckets: int = BUCKETS, share: int = SHARE) -> DataFrame:
    """(key, piece_no, tok_start, tok_end, container) for containers of ``capacity`` tokens.

    An item is divided only if it alone exceeds the capacity. Container numbers run from 0 without
    gaps. Equal input gives the equal result. An item of size 0 or null takes the room of one token;
    rows with a null key are left out; repeated rows are items of their own; an empty table gives an
    empty result. Other columns are ignored. ``share``: items that one task ranks, about; the
    items of a bucket are spread over as many tasks as that takes, however many they are.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = items.sparkSession
    clean = items.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("n")).where("k is not null")
    p = divide(clean, "k", "n", capacity).withColumn("len", F.greatest(F.col("tok_end") - F.col("tok_start"), F.lit(1)))
    hist = p.groupBy("len").agg(F.count(F.lit(1)).alias("c")).orderBy("len").collect()  # at most `capacity` rows
    out = [F.col("k").alias(key), "piece_no", "tok_start", "tok_end"]
    if not hist:
        return p.select(*out, F.lit(0).cast("long").alias("container"))
    lengths, counts = np.array([r[0] for r in hist], np.int64), np.array([r[1] for r in hist], np.int64)
    bounds = bucket_bounds(lengths, counts, buckets)
    of = np.searchsorted(bounds, lengths)
    per = np.bincount(of, weights=counts, minlength=len(bounds)).astype(np.int64)
    first, used, slots = 0, np.zeros(len(bounds), np.int64), []
    for times, pattern in plan_batches(bounds, per, capacity):
        for b, n in pattern:
            slots.append((b, int(used[b]), int(used[b] + times * n), n, first))
            used[b] += times * n
        first += times
    # at most `capacity` rows
    buckets_df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(lengths, of)], "len long, bucket int")
    spread = max(1, -(-int(per.max()) // share))
    p = p.join(F.broadcast(buckets_df), "len").withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(spread)))
    seen = p.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("before"))  # at most buckets x spread rows
    w = Window.partitionBy("bucket", "shard").orderBy("k", "piece_no")
    # the ranked items lie by bucket and shard already, so they stay where they are
    p = p.withColumn("rn", F.row_number().over(w)).hint("merge").join(seen, ["bucket", "shard"])
    return p.select(*out, _container(slots)("bucket", F.col("before") + F.col("rn") - 1).alias("container"))


def _container(slots: list[tuple[int, int, int, int, int]]):
    """Container of the item of a rank in its bucket, by a search in the sorted slots of the plan."""
    bucket, lo, _, each, first = (np.array(x, np.int64) for x in zip(*sorted(slots)))

    @F.pandas_udf("long")
    def place(b: pd.Series, rank: pd.Series) -> pd.Series:
        b, rank = b.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.empty(len(b), np.int64)
        for one in np.unique(b):  # a batch has items of few buckets
            here, begin = b == one, np.searchsorted(bucket, one)
            end = np.searchsorted(bucket, one, side="right")
            at[here] = begin + np.searchsorted(lo[begin:end], rank[here], side="right") - 1
        return pd.Series(first[at] + (rank - lo[at]) // each[at])

    return place

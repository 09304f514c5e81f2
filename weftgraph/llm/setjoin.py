"""All pairs of set-valued records above a similarity, by multi-index binary sketches.

A record's set becomes a code of one-bit minhashes: two codes agree in a bit with probability
``(1 + J) / 2``. The code is cut into segments, each an index of its own; records that agree in a
whole segment meet there. Segments grow with the logarithm of the number of classes, so that records
that agree by chance alone do not fill a bucket however many there are. The number of segments and
the Hamming radius of a further 64-bit word, which sorts out chance meetings before anything is
shuffled again, are both computed from the recall asked for at the threshold. What is left is
verified on the original sets.

Records of equal sets form one class and are looked at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log1p, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut
from .probminhash import radius_for

SEGMENT_BITS, WORD = 16, 64
BUCKET = 64  # classes that meet in a bucket by chance, at most


def value_set(*arrays: str) -> Column:
    """The distinct values of several array columns together: spaces at both ends removed, lower
    case, without nulls and empty values, sorted."""
    every = F.concat(*[F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays])
    clean = F.transform(every, lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != ""))))


def segments_for(threshold: float, miss: float, bits: int = SEGMENT_BITS) -> int:
    """Segments needed so that a pair at the threshold agrees in none with probability ``miss``."""
    return ceil(log(miss) / log1p(-(((1 + threshold) / 2) ** bits)))


def width_for(n_classes: int) -> int:
    """Bits of a segment: ``SEGMENT_BITS``, and more once chance alone would put more than ``BUCKET``
    of so many classes into a bucket."""
    return min(40, max(SEGMENT_BITS, ceil(log2(max(1, n_classes) / BUCKET))))


def one_bit_codes(values: np.ndarray, sizes: np.ndarray, n_bits: int, seed: int = 7) -> np.ndarray:
    """Bits (sets x n_bits) of the one-bit minhashes of sets given as hashes, one set after another."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, n_bits, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.empty((len(sizes), n_bits), bool)
    for k in range(0, n_bits, 16):
        h = (values[:, None] * factors[None, k : k + 16]) >> np.uint64(20)
        low = np.minimum.reduceat(h, begin, axis=0)
        low = (low ^ (low >> np.uint64(17))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, k : k + 16] = (low >> np.uint64(63)).astype(bool)
    return out


def similar_sets(records: DataFrame, key: str, values: str, threshold: float = 0.7, least: int = 1, miss: float = 5e-4) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the records with at least ``least`` values: members ``(id, cls)``, links
    ``(cls_a, cls_b, similarity)``, cls_a < cls_b, between classes of different sets whose Jaccard
    similarity is at least ``threshold``. Equal sets are one class, similarity 1.

    ``values`` is an array of distinct non-null strings, as :func:`value_set` gives; order does not
    matter. For a join between two tables, union them with keys that tell them apart. A pair at the
    threshold is missed with a probability of at most ``2 * miss``, a closer one with less.

    Null keys and null or too small sets take no part; repeated rows count once; an empty table
    gives empty results. Columns other than the two named are ignored.
    """
    r = records.select(F.col(f"`{key}`").alias("id"), F.array_sort(F.col(f"`{values}`")).alias("v"))
    r = r.where("id is not null").where(F.size("v") >= max(1, least))
    r = cut(r.withColumn("cls", F.xxhash64("v")))
    seen = Observation()
    classes = cut(r.groupBy("cls").agg(F.first("v").alias("v")).observe(seen, F.count(F.lit(1)).alias("n")))
    width = width_for(seen.get["n"])
    n_seg, radius = segments_for(threshold, miss, width), radius_for(threshold, miss, WORD)
    hashed = classes.select("cls", F.transform("v", lambda x: F.xxhash64(x)).alias("h"))
    place = (1 << np.arange(width - 1, -1, -1, dtype=np.int64)).astype(np.float64)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.iloc[a : a + 1000]
                sizes = part["h"].map(len).to_numpy()
                flat = np.concatenate(part["h"].tolist()).astype(np.int64).view(np.uint64)
                bits = one_bit_codes(flat, sizes, WORD + n_seg * width)
                word = np.packbits(bits[:, :WORD], axis=1).view(">i8").astype(np.int64).ravel()
                seg = (bits[:, WORD:].reshape(len(part), n_seg, width) @ place).astype(np.int64)
                k = (np.arange(n_seg) << width)[None, :] | seg
                yield pd.DataFrame({"key": k.ravel(), "cls": np.repeat(part["cls"].to_numpy(), n_seg), "word": np.repeat(word, n_seg)})

    # a class has many rows here, which no estimate from the table's size can know: never broadcast.
    # The join reads its shuffle directly, so a bucket that is skewed is split at run time
    index = hashed.mapInPandas(sketch, "key long, cls long, word long")
    a = index.select("key", F.col("cls").alias("a"), F.col("word").alias("wa"))
    b = index.select("key", F.col("cls").alias("b"), F.col("word").alias("wb"))
    near = F.bit_count(F.col("wa").bitwiseXOR(F.col("wb"))) <= radius
    pairs = cut(a.hint("merge").join(b, "key").where(F.col("a") < F.col("b")).where(near).select("a", "b").distinct())
    x, y = classes.select(F.col("cls").alias("a"), F.col("v").alias("va")), classes.select(F.col("cls").alias("b"), F.col("v").alias("vb"))
    both = F.size(F.array_intersect("va", "vb"))
    links = pairs.hint("merge").join(x, "a").hint("merge").join(y, "b").withColumn("both", both)
    links = links.withColumn("similarity", F.col("both") / (F.size("va") + F.size("vb") - F.col("both")))
    links = links.where(F.col("similarity") >= threshold).select(F.col("a").alias("cls_a"), F.col("b").alias("cls_b"), "similarity")
    return r.select("id", "cls").distinct(), cut(links)

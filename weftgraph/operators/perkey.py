"""Per-key results under heavy skew, by map-side combining.

Every input partition folds its rows into a bounded table of mergeable key states; a full table is
spilled downstream as rows of states. Only the states are shuffled, so a key that holds a third of
all rows costs each partition one state, and the reducer of that key reads at most
``k x (partitions + spills)`` rows. Algebraic results (counts, sums, extremes) need no code for
that: Spark's partial hash aggregation is the same technique.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.text import normal_value
from ..session import ship


def normal_values(key_array: str) -> Column:
    """The distinct non-empty normal values of an array column."""
    v = F.array_distinct(F.transform(F.col(key_array), normal_value))
    return F.filter(v, lambda x: x.isNotNull() & (x != ""))


def exploded_values(df: DataFrame, key_array: str, *keep: str) -> DataFrame:
    """One row per non-empty normal value of ``key_array``; ``keep`` columns come along."""
    v = F.explode(F.array_distinct(F.transform(F.col(key_array), normal_value)))
    return df.select(v.alias("_value"), *keep).where((F.col("_value") != "") & F.col("_value").isNotNull())


def latest_per_key(df: DataFrame, key: str, item: str, at: str, k: int = 3, max_keys: int = 50_000) -> DataFrame:
    """The ``k`` items with the latest ``at`` of each ``key``: rows ``(key, item, at, rank)``.

    Ties in ``at`` go to the smaller item. Repeated rows count once; an item that occurs with
    several times counts with its latest. Rows with a null key or item are left out; a null ``at``
    ranks last. A key with fewer items gives all of them, an empty input an empty result. Other
    columns are ignored, whatever their names.

    ``max_keys`` bounds the table of a partition: beyond it the states are handed on and a new table
    begins, which costs rows to shuffle but loses nothing.
    """
    d = df.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{item}`").alias("_i"), F.col(f"`{at}`").alias("_t"))
    d = d.where(F.col("_k").isNotNull() & F.col("_i").isNotNull())
    ship(df.sparkSession)

    def top(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["_k", "_t", "_i"], ascending=[True, False, True], na_position="last", kind="mergesort")
        p = p.drop_duplicates(["_k", "_i"])
        return p.groupby("_k", sort=False).head(k)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, waiting, rows = None, [], 0
        for b in batches:
            waiting.append(top(b))
            rows += len(waiting[-1])
            if rows < max_keys and table is not None:
                continue
            table = top(pd.concat(([table] if table is not None else []) + waiting))
            waiting, rows = [], 0
            if table["_k"].nunique() > max_keys:
                yield table
                table = None
        if table is not None or waiting:
            yield top(pd.concat(([table] if table is not None else []) + waiting))

    states = d.mapInPandas(fold, d.schema)
    merged = states.groupBy("_k", "_i").agg(F.max("_t").alias("_t"))
    w = Window.partitionBy("_k").orderBy(F.col("_t").desc_nulls_last(), F.col("_i").asc())
    ranked = merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("_k").alias(key), F.col("_i").alias(item), F.col("_t").alias(at), "rank")


def summary_per_key(df: DataFrame, key: str, item: str, at: str) -> DataFrame:
    """Rows ``(key, n_items, first_at, last_at)``, each item counted once per key. ``key`` is a column
    of keys or of arrays of keys.

    The deliveries of an item are brought together first, still with all keys in one row, so nothing
    is shuffled once a key; each then counts once for each of its keys. Behind that, algebraic
    aggregates with map-side combining: every task sends one state a key. Null items and keys are left
    out, a null ``at`` counts but bounds nothing; empty input gives an empty result.
    """
    keys = F.col(f"`{key}`")
    if not isinstance(df.schema[key].dataType, ArrayType):
        keys = F.array(keys)
    d = df.select(F.array_sort(F.array_distinct(F.array_compact(keys))).alias("_k"), F.col(f"`{item}`").alias("_i"), F.col(f"`{at}`").alias("_t"))
    d = d.where(F.col("_i").isNotNull() & (F.size("_k") > 0))
    # equal deliveries are one element; only versions that differ in keys or time stand side by side
    one = d.groupBy("_i").agg(F.collect_set(F.struct("_k", "_t")).alias("v"))
    alone = F.size("v") == 1
    key_of = F.when(alone, F.element_at("v", 1)["_k"]).otherwise(F.array_distinct(F.flatten(F.transform("v", lambda x: x["_k"]))))
    e = one.select("v", F.explode(key_of).alias("_key"))
    times = F.transform(F.filter("v", lambda x: F.array_contains(x["_k"], F.col("_key"))), lambda x: x["_t"])
    e = e.select(F.col("_key").alias(key), F.array_min(times).alias("lo"), F.array_max(times).alias("hi"))
    return e.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), F.min("lo").alias("first_at"), F.max("hi").alias("last_at"))

"""Near-duplicate texts: ProbMinHash over word shingles, banding, verification.

1. Each text becomes its set of shingles; texts with the same set form a *class*, of which only one
   copy is looked at from then on, so a group of copies costs no more than its rows.
2. ProbMinHash signatures of the classes; classes that agree in all registers of a band are
   candidates.
3. A 64-bit word of one-bit registers travels with each class; candidates whose words differ in
   too many bits part right where they meet. The radius follows from the threshold.
4. The sets of what is left are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut, write_cut
from .probminhash import bands, radius_for, signatures, words_of
from .shingles import blocks, mix, shingle_sets

REGISTERS, BAND_ROWS = 200, 4
WORD_MISS = 3e-4  # share of pairs at the threshold that the radius may cost
SEEN = 50_000  # classes a task remembers, so as not to send the bands of further copies


def _sets(texts: list[str], width: int, least: int):
    """(numbers of the texts with enough shingles, their class, set sizes, set number, hash) by block."""
    for a, b in blocks(texts):
        d, h = shingle_sets(texts[a:b], width)
        n = np.bincount(d, minlength=b - a)
        keep = np.flatnonzero(n >= max(1, least))
        to = np.full(b - a, -1)
        to[keep] = np.arange(len(keep))
        on = to[d] >= 0
        d, h = to[d[on]], h[on]
        cls = np.zeros(len(keep), np.uint64)
        np.add.at(cls, d, mix(h))
        cls = mix(cls * np.uint64(3) + n[keep].astype(np.uint64)).view(np.int64)
        yield keep + a, cls, n[keep], d, h


def text_classes(df: DataFrame, key: str, text: Column, width: int, least: int) -> DataFrame:
    """(id, cls, n, word, bands) of each text with at least ``least`` distinct shingles. Word and
    bands are null on copies that the task has seen before."""
    schema = f"id {df.schema[key].dataType.simpleString()}, cls long, n int, word long, bands array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch["id"].to_numpy()
            for at, cls, n, d, h in _sets(batch["t"].tolist(), width, least):
                if not len(at):
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                first = np.zeros(len(at), bool)
                for i, c in enumerate(cls.tolist()):
                    if c not in seen:
                        seen.add(c)
                        first[i] = True
                to = np.cumsum(first) - 1
                on = first[d]
                q = signatures(to[d[on]], h[on], int(first.sum()), REGISTERS)
                key_of, word = iter(bands(q, BAND_ROWS)), words_of(q)
                yield pd.DataFrame(
                    {
                        "id": ids[at], "cls": cls, "n": n.astype(np.int32),
                        "word": pd.array(word[np.maximum(to, 0)], dtype="Int64") if len(word) else pd.array([None] * len(at), dtype="Int64"),
                        "bands": [next(key_of) if f else None for f in first],
                    }
                )

    return df.select(F.col(f"`{key}`").alias("id"), text.alias("t")).where("id is not null and t is not null").mapInPandas(run, schema)


def _bucket_pairs(firsts: DataFrame, radius: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of different classes that meet in a bucket and whose words lie
    within the radius, from rows (cls, word, bands), one a class.

    Both sides of the join read one shuffle, and directly, so that a bucket that holds a great share
    of all classes is split at run time; no estimate knows how many rows the bands make, hence never a
    broadcast."""
    b = firsts.select(F.explode("bands").alias("key"), "cls", "word")
    x, y = (b.select("key", F.col("cls").alias(c), F.col("word").alias(f"w{c}")) for c in "ab")
    near = F.bit_count(F.col("wa").bitwiseXOR(F.col("wb"))) <= radius
    return x.hint("merge").join(y, "key").where(F.col("a") < F.col("b")).where(near).select("a", "b").distinct()


def near_duplicates(df: DataFrame, key: str, text: Column, width: int = 5, threshold: float = 0.8, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members, links): members ``(id, cls)`` gives each text with at least ``least`` distinct
    shingles of ``width`` words its class of equal shingle sets; links ``(cls_a, cls_b, similarity)``,
    cls_a < cls_b, are all found pairs of classes with a Jaccard similarity of ``threshold`` or more.

    Two texts are near-duplicates if they are of one class or their classes are linked. A pair at
    0.6 is missed with a probability of ``(1 - 0.6**4)**50 + WORD_MISS = 0.0013``, at 0.7 of 1e-6.

    Null keys and null texts are left out, empty and short texts have no shingles and no class;
    rows repeated with their key count once; an empty table gives empty results. Columns other than
    the key and those in ``text`` are ignored.
    """
    spark = df.sparkSession
    found = text_classes(df, key, text, width, least)
    path = write_cut(found)
    found = spark.read.schema(found.schema).parquet(path)
    classes = cut(found.select("id", "cls"))
    # a class that several tasks have met is made one before its bands part, so a bucket holds it once
    once = found.where("bands is not null").select("cls", "word", "bands").repartition("cls").dropDuplicates(["cls"])
    firsts = write_cut(once)
    drop_cut(spark, path)  # each table goes as soon as the next is there, so that little lies side by side
    close = cut(_bucket_pairs(spark.read.schema(once.schema).parquet(firsts), radius_for(threshold, WORD_MISS)))
    drop_cut(spark, firsts)

    # exact sets of one text of each class that is left
    wanted = close.select(F.col("a").alias("cls")).union(close.select("b")).distinct()
    one = classes.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("id")).select("id")
    some = df.select(F.col(f"`{key}`").alias("_id"), text.alias("_t")).join(one, F.col("_id") == one.id, "left_semi")
    sets = cut(_exact_sets(some, width, least))
    sets = sets.groupBy("cls").agg(F.first("els").alias("els"))
    x, y = (sets.select(F.col("cls").alias(c), F.col("els").alias(f"e{c}")) for c in "ab")
    both = F.size(F.array_intersect("ea", "eb"))
    exact = close.hint("merge").join(x, "a").hint("merge").join(y, "b").withColumn("both", both)
    exact = exact.withColumn("similarity", F.col("both") / (F.size("ea") + F.size("eb") - F.col("both")))
    exact = exact.where(F.col("similarity") >= threshold).select(F.col("a").alias("cls_a"), F.col("b").alias("cls_b"), "similarity")
    return classes.select("id", "cls").distinct(), cut(exact)


def _exact_sets(df: DataFrame, width: int, least: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, cls, _, d, h in _sets(batch["_t"].tolist(), width, least):
                if len(at):
                    els = np.split(h.view(np.int64), np.flatnonzero(np.diff(d)) + 1)
                    yield pd.DataFrame({"cls": cls, "els": els})

    return df.select("_t").mapInPandas(run, "cls long, els array<long>")


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, group_id, n_links): one row for each member. A class is named by its least id;
    so is a group, which joins the classes linked directly or through others. n_links counts the
    linked other classes."""
    from .links import components

    comp = components(links, "cls_a", "cls_b").withColumnRenamed("node", "cls")
    deg = links.select(F.col("cls_a").alias("cls")).union(links.select("cls_b")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    c = members.groupBy("cls").agg(F.min("id").alias("class_id")).join(comp, "cls", "left").join(deg, "cls", "left")
    c = cut(c.select("cls", "class_id", F.coalesce("component", "cls").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    c = c.join(c.groupBy("component").agg(F.min("class_id").alias("group_id")), "component")
    return members.join(c, "cls").select("id", "class_id", "group_id", "n_links")


def member_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (id_a, id_b), id_a < id_b, of members of one class or of linked classes."""
    x, y = members.select(F.col("cls").alias("cls_a"), F.col("id").alias("x")), members.select(F.col("cls").alias("cls_b"), F.col("id").alias("y"))
    across = links.join(x, "cls_a").join(y, "cls_b").select("x", "y")
    many = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cls")
    copies = members.join(many, "cls", "left_semi")
    within = copies.select("cls", F.col("id").alias("x")).join(copies.select("cls", F.col("id").alias("y")), "cls").where("x < y").select("x", "y")
    p = across.union(within).where("x <> y")
    return p.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

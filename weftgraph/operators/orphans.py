"""References to records that do not exist, and what hangs on them.

A reference names a record by key at a moment. It is a *direct* orphan if no stretch of that
record's existence covers the moment. The record that holds an orphan reference is itself
incomplete, so every sound reference to it is an *inherited* orphan, and so on: a fixpoint of
semi-joins down the reference graph, the frontier of one round being the records found in the round
before. A record is taken up once, hence cycles end.

What is asked for is made: direct orphans need no cascade.

Skew: keys that many references name are found by a count with map-side combining. There can be at
most ``1 / HOT_SHARE`` of them, whatever the data, so they are a bounded list; their references are
spread over ``SALTS`` tasks and the few rows of the other side that have such a key are repeated.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import base_id
from ..session import cut

HOT_SHARE, SALTS = 0.01, 32


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, at_least: int = 10_000, total: int | None = None) -> list[str]:
    """Keys with more than ``share`` of all rows and ``at_least`` rows: ``1 / share`` at most.
    ``total``: the number of rows with a key, where it is known."""
    rows = df.where(F.col(key).isNotNull())
    total = rows.count() if total is None else total
    if total < at_least:
        return []
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.where(F.col("n") > max(total * share, at_least)).collect()]


def salted(df: DataFrame, key: str, hot: list, spread: str | None) -> DataFrame:
    """Adds ``_salt``: by the hash of column ``spread`` on hot keys, or, where ``spread`` is None,
    all salts on hot keys (one row each); 0 on the others."""
    if not hot:
        return df.withColumn("_salt", F.lit(0))
    is_hot = F.col(key).isin(hot)
    if spread:
        return df.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0))
    all_salts = F.array(*[F.lit(i) for i in range(SALTS)])
    return df.withColumn("_salt", F.explode(F.when(is_hot, all_salts).otherwise(F.array(F.lit(0)))))


COLUMNS = ["ref_table", "from_id", "relation", "target_id", "at"]


class Orphans:
    """Orphan references among ``refs`` (``ref_table, from_id, relation, target_id, at``), judged by
    ``spans`` (``id, added_at, removed_at``); see :func:`orphan_references`."""

    def __init__(self, refs: DataFrame, spans: DataFrame):
        r = refs.select(*COLUMNS).where(F.trim("target_id") != "").distinct().withColumn("key", base_id(F.col("target_id")))
        seen = Observation()
        r = cut(r.observe(seen, F.count(F.lit(1)).alias("n")))
        self.hot = hot_keys(r, "key", total=(seen.get or {}).get("n") or 0)
        self.refs = salted(r, "key", self.hot, "from_id")
        s = spans.select(F.col("id").alias("key"), "added_at", "removed_at").where("added_at is not null").distinct()
        self.spans = salted(s, "key", self.hot, None)

    def _judged(self, how: str) -> DataFrame:
        r, s = F.col, lambda c: F.col(f"s.{c}")
        covers = (
            (r("r.key") == s("key")) & (r("r._salt") == s("_salt")) & (s("added_at") <= r("r.at")) & (s("removed_at").isNull() | (s("removed_at") > r("r.at")))
        )
        return self.refs.alias("r").join(self.spans.alias("s"), covers, how)

    @cached_property
    def _direct(self) -> DataFrame:
        return self._judged("left_anti")

    @property
    def direct(self) -> DataFrame:
        """No stretch of the record's existence covers the moment; level 0."""
        return self._direct.select(*COLUMNS, F.lit("direct").alias("kind"), F.lit(0).alias("level"))

    @property
    def inherited(self) -> DataFrame:
        """Sound references to records that hold an orphan reference, directly or through others."""
        self._direct = cut(self._direct)
        sound = cut(self._judged("left_semi"))
        links = sound.where("from_id is not null").select(F.col("from_id").alias("child"), "key", "_salt").where(F.col("child") != F.col("key")).distinct()
        links = links.repartition("key", "_salt").persist()
        up = lambda ids: salted(ids, "key", self.hot, None)
        first = self._direct.where("from_id is not null").select(F.col("from_id").alias("id"), F.lit(0).alias("level")).distinct()
        frontier = cut(first)
        levels, level = frontier, 0
        try:
            while not frontier.isEmpty():
                level += 1
                nxt = links.join(up(frontier.select(F.col("id").alias("key"))), ["key", "_salt"], "left_semi").select(F.col("child").alias("id")).distinct()
                frontier = cut(nxt.join(levels, "id", "left_anti").withColumn("level", F.lit(level)))
                levels = levels.unionByName(frontier)
        finally:
            links.unpersist()
        found = sound.join(up(levels.select(F.col("id").alias("key"), "level")), ["key", "_salt"])
        return found.select(*COLUMNS, F.lit("inherited").alias("kind"), (F.col("level") + 1).alias("level"))


def orphan_references(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """Orphan references, each with the way it is orphaned.

    ``refs``: ``ref_table, from_id, relation, target_id, at``; ``spans``: ``id, added_at,
    removed_at``. Result: ``ref_table, from_id, relation, target_id, at, kind, level``; kind is
    ``direct`` (level 0) or ``inherited`` (level: rounds from the nearest direct orphan).

    Repeated references and spans count once. A null or blank target is no reference; a null time
    has no span that covers it, so the reference is an orphan; a null ``added_at`` covers nothing, a
    null ``removed_at`` has no end. A reference with a null ``from_id`` can be an orphan but hands
    nothing on. Empty tables give an empty result (no spans: all references are direct orphans).
    Other columns are ignored.
    """
    o = Orphans(refs, spans)
    inherited = o.inherited
    return o.direct.unionByName(inherited)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per referring table, month and kind."""
    return orphans.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("period"), "kind").agg(
        F.count(F.lit(1)).alias("n_references"), F.countDistinct("target_id").alias("n_targets"), F.max("level").alias("max_level")
    )

"""Reachability over typed, ordered edges.

A breadth-first walk in which order matters: a node belongs to the edge that discovers it first,
frontier nodes being taken in the order of their own discovery and edges in ``edge_ord``. The order
is carried as the list of ``edge_ord`` on the way; lists of one level compare like the walk runs, so
no level needs a global sort. Each level is written once and cut from its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def edges_from(edges: DataFrame, node: str, relation: str | None = None) -> DataFrame:
    e = edges.where(F.col("src") == node)
    return e.where(F.col("relation") == relation) if relation else e


def edges_to(edges: DataFrame, node: str, relation: str | None = None) -> DataFrame:
    e = edges.where(F.col("dst") == node)
    return e.where(F.col("relation") == relation) if relation else e


def walk(edges: DataFrame, start: DataFrame | str, depth: int | None, relation: str | None = None, reverse: bool = False, each: bool = False) -> DataFrame:
    """(level, id, via, relation, path) of every node first discovered within ``depth`` hops; the
    start is level 0 with null via. ``start`` is an id or a table with a column ``id``; None as depth
    goes on to the fixpoint. An unknown start reaches itself only. Null ends lead nowhere.

    Several starts are one walk; with ``each`` every start has a walk of its own, all made in the same
    rounds, and the rows have the column ``start``, too."""
    e = edges.where("src is not null and dst is not null")
    if relation:
        e = e.where(F.col("relation") == relation)
    a, b = ("dst", "src") if reverse else ("src", "dst")
    e = e.select(F.col(a).alias("here"), F.col(b).alias("there"), "relation", "edge_ord")
    spark = edges.sparkSession
    if isinstance(start, str):
        start = spark.createDataFrame([(start,)], "id string")
    none, mine = F.lit(None).cast("string"), ["start"] if each else []
    first = start.select("id").where("id is not null").distinct().select(*[F.col("id").alias(m) for m in mine], "id")
    front = cut(first.select(*mine, F.lit(0).alias("level"), "id", none.alias("via"), none.alias("relation"), F.array().cast("array<bigint>").alias("path")))
    levels, seen = [front], front.select(*mine, "id")
    n = 0
    while depth is None or n < depth:
        n += 1
        step = front.select(*mine, F.col("id").alias("at"), "path").join(e, F.col("at") == F.col("here"))
        step = step.select(*mine, F.col("there").alias("id"), "here", "relation", F.array_append("path", F.col("edge_ord")).alias("path"))
        step = step.join(seen, [*mine, "id"], "left_anti")
        best = step.groupBy(*mine, "id").agg(F.min_by(F.struct("here", "relation"), "path").alias("x"), F.min("path").alias("path"))
        front = cut(best.select(*mine, F.lit(n).alias("level"), "id", F.col("x.here").alias("via"), F.col("x.relation").alias("relation"), "path"))
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.union(front.select(*mine, "id"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def forward_reachable(edges: DataFrame, start: DataFrame | str, depth: int, relation: str | None = None) -> DataFrame:
    """(id): the start and all that is reachable along edges within ``depth`` hops."""
    return walk(edges, start, depth, relation).select("id")


def trace_dependencies(edges: DataFrame, start: DataFrame | str, depth: int = 3) -> DataFrame:
    """(level, from_id, to_id, path): prerequisites, each at its first discovery."""
    w = walk(edges, start, depth, "requires").where("level > 0")
    return w.select("level", F.col("via").alias("from_id"), F.col("id").alias("to_id"), "path")


def analyze_impact(edges: DataFrame, start: DataFrame | str, depth: int = 5) -> DataFrame:
    """(level, id, relation, via, path): what depends on the start, over all relations, backwards."""
    return walk(edges, start, depth, reverse=True).where("level > 0").select("level", "id", "relation", "via", "path")

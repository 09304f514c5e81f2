"""Title search and ranked content search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import excerpt, score, terms

TOP = 15


def search_topics(nodes: DataFrame, query: str) -> DataFrame:
    """(id, title, okf_type, line): nodes whose id or title contains the query, case aside."""
    q = query.lower()
    hit = F.lower("id").contains(q) | F.lower("title").contains(q)
    line = F.concat("title", F.lit(" ("), "okf_type", F.lit(") ["), "id", F.lit("]"))
    return nodes.where(hit).select("id", "title", "okf_type", line.alias("line"))


def search_content(chunks: DataFrame, query: str, scope: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """(rank, id, title, score, excerpt, n_matches): the best ``top`` chunks, by score, then id.

    ``scope`` (column ``id``) restricts the chunks before any text is scored. Chunks delivered twice
    count once. ``n_matches`` is the number of all chunks with a score above 0.
    """
    c = chunks.select("id", "title", "text")
    if scope is not None:
        c = c.join(scope.select("id").distinct(), "id", "left_semi")
    hit = c.select("id", "title", "text", score(F.col("title"), F.col("text"), terms(query)).alias("score")).where("score > 0")
    hit = hit.dropDuplicates(["id"])
    best = hit.orderBy(F.desc("score"), "id").limit(top)
    best = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "id", "title", "text"))).alias("b"))
    rows = best.select(F.posexplode("b").alias("p", "r")).select(
        (F.col("p") + 1).alias("rank"), F.col("r.id").alias("id"), F.col("r.title").alias("title"),
        (-F.col("r.m")).cast("long").alias("score"), excerpt(F.coalesce("r.text", F.lit("")), 200).alias("excerpt"),
    )
    total = hit.agg(F.lit(1).alias("one"), F.count(F.lit(1)).alias("n_matches"))
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")  # one row

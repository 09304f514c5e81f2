"""Point lookups and derived columns of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import strings
from .search import excerpt

# Relations that the front matter lists.
LISTED = ("contains", "applies-to", "requires")


def titles(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("id").agg(F.max_by("title", "node_ord").alias("title"))


def find_related(nodes: DataFrame, edges: DataFrame, of: DataFrame | str, relation: str | None = None) -> DataFrame:
    """(src, edge_ord, relation, dst, title): outgoing edges with the target's title, or its id."""
    e = edges
    if relation:
        e = e.where(F.col("relation") == relation)
    e = e.where(F.col("src") == of) if isinstance(of, str) else e.join(of.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    if isinstance(of, str):  # of a single node's targets only the titles are looked up, not of all nodes
        nodes = nodes.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    t = titles(nodes).withColumnRenamed("id", "dst")
    return e.join(t, "dst", "left").select("src", "edge_ord", "relation", "dst", F.coalesce("title", "dst").alias("title"))


def summaries(nodes: DataFrame) -> DataFrame:
    """(id, summary): ``title: description``, or a placeholder."""
    d = F.coalesce("shortdesc", F.lit("(no description available)"))
    return nodes.select("id", F.concat("title", F.lit(": "), d).alias("summary"))


def explain(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, topic: DataFrame | str) -> DataFrame:
    """(id, part, ord, relation, text): title, description, body excerpt, and the requires, contains
    and applies-to targets of a node, in the order they are shown."""
    n = nodes.where(F.col("id") == topic) if isinstance(topic, str) else nodes.join(topic.select("id"), "id", "left_semi")
    none = F.lit(None).cast("string").alias("relation")
    head = n.select("id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), none, F.col("title").alias("text"))
    desc = n.select("id", F.lit(1), F.lit(0).cast("long"), none, F.coalesce("shortdesc", F.lit("(no description available)")))
    c = chunks.join(n.select("id"), "id", "left_semi").where("text is not null").dropDuplicates(["id"])
    body = c.select("id", F.lit(2), F.lit(0).cast("long"), none, excerpt(F.col("text"), 300))
    shown = F.create_map(F.lit("requires"), F.lit(3), F.lit("contains"), F.lit(4), F.lit("applies-to"), F.lit(5))
    rel = find_related(nodes, edges, n.select("id")).where(F.col("relation").isin("requires", "contains", "applies-to"))
    links = rel.select(F.col("src").alias("id"), F.element_at(shown, F.col("relation")), F.col("edge_ord"), "relation", F.concat("title", F.lit(" ("), "dst", F.lit(")")))
    return head.union(desc).union(body).union(links)


def suggest_ids(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, suggestion): an asked id that is no node but the tail, after ``--``, of exactly one.

    An id is a tail once for each ``--`` in it, so this is an equi-join, not a comparison of all
    pairs."""
    ids = nodes.select("id").distinct()
    parts = F.split("id", "--", -1)
    tails = ids.select("id", F.posexplode(parts).alias("p", "_"), parts.alias("a")).where("p > 0")
    tails = tails.select("id", F.array_join(F.slice("a", F.col("p") + 1, F.size("a")), "--").alias("asked"))
    missing = asked.select(F.col("id").alias("asked")).distinct().join(ids.withColumnRenamed("id", "asked"), "asked", "left_anti")
    hit = missing.join(tails, "asked").groupBy("asked").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("suggestion"))
    return hit.where("n = 1").select("asked", "suggestion")


def tags(nodes: DataFrame) -> DataFrame:
    """(id, tags): audience, product and keys in this order, repeats kept."""
    return nodes.where("kind = 'topic'").select("id", F.concat(strings(F.col("audience")), strings(F.col("product")), strings(F.col("keys"))).alias("tags"))


def listed_relations(edges: DataFrame) -> DataFrame:
    """(id, relation, edge_ord, target): the links that the front matter lists, one row each, so that a
    node with most links is no single row; targets stand in the order of ``edge_ord``."""
    e = edges.where(F.col("relation").isin(*LISTED))
    return e.select(F.col("src").alias("id"), "relation", "edge_ord", F.col("dst").alias("target"))


def sections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, section, relation, edge_ord, dst, title): links by relation, relations numbered in the
    order first seen; one row a link. Only relations, six a node at most, are ever grouped."""
    t = titles(nodes).withColumnRenamed("id", "dst")
    w = Window.partitionBy("src").orderBy("first")
    first = edges.groupBy("src", "relation").agg(F.min("edge_ord").alias("first"))
    first = first.select("src", "relation", F.row_number().over(w).alias("section"))
    e = edges.join(t, "dst", "left").join(first, ["src", "relation"])
    return e.select(F.col("src").alias("id"), "section", "relation", "edge_ord", "dst", F.coalesce("title", "dst").alias("title"))


def graph_view(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.col("okf_type").alias("type"))


def text_chunks(nodes: DataFrame, *keep: str) -> DataFrame:
    """The text index: one chunk a topic; empty arrays and missing text are null. ``keep``: columns of
    the nodes that come along."""
    none = F.col("shortdesc").isNull() & F.col("body").isNull()
    empty = lambda c: F.when(F.size(strings(F.col(c))) > 0, F.col(c))
    return nodes.where("kind = 'topic'").select(
        "id", "title", F.when(~none, F.concat_ws("\n\n", "shortdesc", "body")).alias("text"), F.col("okf_type").alias("topicType"),
        empty("audience").alias("audience"), empty("product").alias("product"), F.concat(F.lit("topics/"), "id", F.lit(".md")).alias("okfNode"), *keep,
    )

"""Nodes, edges and chunks of the engine over the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_id
from ..schema import display_type, strings
from ..session import table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Topics and maps, each once."""
    t = table(spark, d, "topics").dropDuplicates(["id"])
    m = table(spark, d, "maps").dropDuplicates(["id"])
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    topic = t.select(
        F.lit("topic").alias("kind"), "id", "topic_type", display_type(F.lit("topic"), F.col("topic_type")).alias("okf_type"), "title", "shortdesc", "body",
        strings(F.col("audience")).alias("audience"), strings(F.col("product")).alias("product"), strings(F.col("topic_keys")).alias("keys"),
        strings(F.col("uicontrols")).alias("uicontrols"), strings(F.col("cmd_uicontrols")).alias("cmd_uicontrols"), "source_file", F.lit(1).cast("long").alias("node_ord"),
    )
    maps = m.select(
        F.lit("map").alias("kind"), "id", none.alias("topic_type"), display_type(F.lit("map"), none).alias("okf_type"), "title", none.alias("shortdesc"), none.alias("body"),
        *[empty.alias(c) for c in ("audience", "product", "keys", "uicontrols", "cmd_uicontrols")], "source_file", F.lit(0).cast("long").alias("node_ord"),
    )
    return topic.unionByName(maps)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that name a target, each once; a target is the id before its fragment."""
    e = table(spark, d, "graph_edges").select("edge_id", "from_id", "to_id", "relation").where(F.trim("to_id") != "").distinct()
    return e.select(F.col("from_id").alias("src"), base_id(F.col("to_id")).alias("dst"), "relation", F.col("edge_id").alias("edge_ord"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", "title", "text", "topic_type", "audience", "product").dropDuplicates(["id"])

"""Readers of the normalized model and of published bundles."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import exists, names_in
from ..schema import MODEL, RELATIONS, TOPIC_TYPES, display_type, strings
from ..session import cut, ship
from .job import edge_order


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON array of topics and maps. Unknown types and relations fail the read."""
    m = spark.read.schema(MODEL).json(path, multiLine=True, mode="FAILFAST")
    # the array is one JSON value and thus one partition: its order is the nodes' order
    m = cut(m.withColumn("node_ord", F.monotonically_increasing_id()))
    bad_type = (F.col("type") == "topic") & ~F.coalesce(F.col("topicType").isin(*TOPIC_TYPES), F.lit(False))
    bad_link = F.exists(F.coalesce("links", F.array().cast("array<struct<relation:string,target:string>>")), lambda x: ~F.coalesce(x["relation"].isin(*RELATIONS), F.lit(False)))
    bad = m.where(~F.coalesce(F.col("type").isin("topic", "map"), F.lit(False)) | F.col("id").isNull() | bad_type | bad_link).select("id").first()
    if bad:
        raise ValueError(f"node {bad['id']!r} has an unknown type or relation, or no id")
    nodes = m.select(
        F.col("type").alias("kind"), "id", F.col("topicType").alias("topic_type"), display_type(F.col("type"), F.col("topicType")).alias("okf_type"), "title", "shortdesc", "body",
        *[strings(F.col(c)).alias(c) for c in ("audience", "product", "keys", "uicontrols")], strings(F.col("cmdUicontrols")).alias("cmd_uicontrols"),
        F.col("sourceFile").alias("source_file"), "node_ord",
    )
    e = m.select("id", "node_ord", F.posexplode("links").alias("p", "l"))
    edges = e.select(F.col("id").alias("src"), F.col("l.target").alias("dst"), F.col("l.relation").alias("relation"), edge_order(F.col("node_ord"), 0, F.col("p")).alias("edge_ord"))
    return nodes, edges


def read_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, okf_type, node_ord), edges) of a flattened graph; of repeated ids the last counts."""
    schema = "nodes array<struct<id: string, type: string>>, edges array<struct<`from`: string, `to`: string, relation: string>>"
    g = spark.read.schema(schema).json(f"{root}/graph.json", multiLine=True, mode="FAILFAST")
    n = g.select(F.posexplode("nodes").alias("p", "n")).groupBy("n.id").agg(F.max_by("n.type", "p").alias("okf_type"), F.max("p").cast("long").alias("node_ord"))
    e = g.select(F.posexplode("edges").alias("p", "e"))
    return n, e.select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.relation").alias("relation"), F.col("p").cast("long").alias("edge_ord"))


CHUNK = "id string, title string, text string, topicType string, audience array<string>, product array<string>, okfNode string"


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The text index; empty where there is none. Blank lines are skipped, bad lines fail."""
    path = f"{root}/rag/chunks.jsonl"
    if not exists(spark, path):
        return spark.createDataFrame([], CHUNK)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", CHUNK, {"mode": "FAILFAST"}).alias("c")).select("c.*")


def split_concept(text: str) -> tuple[str, str]:
    """(front matter, body) of a concept file."""
    if not text.startswith("---\n"):
        raise ValueError("no front matter")
    head, found, body = text[4:].partition("\n---\n")
    if not found:
        raise ValueError("front matter is not closed")
    return head, body


def _scalar(text: str) -> str:
    if text[:1] == '"':
        return json.loads(text)
    return text[1:-1].replace("''", "'") if text[:1] == "'" and text[-1:] == "'" else text


def read_front_matter(head: str) -> dict[str, str]:
    """The scalar keys of the top level; what the queries need of a concept."""
    out = {}
    for line in head.split("\n"):
        key, colon, value = line.partition(":")
        if colon and key and not key.startswith((" ", "-")) and value.strip():
            out[key] = _scalar(value.strip())
    return out


def read_relations(head: str) -> list[str]:
    """The targets that the front matter lists under ``relations``, in order."""
    out, inside = [], False
    for line in head.split("\n"):
        if not line.startswith((" ", "-")):
            inside = line.rstrip() == "relations:"
        elif inside and line.lstrip().startswith("- "):
            out.append(_scalar(line.lstrip()[2:].strip()))
    return out


def read_concepts(spark: SparkSession, root: str) -> DataFrame:
    """(file, kind, id, okf_type, title, shortdesc, okf_version, relations, content) of the concept
    files of a bundle."""
    ship(spark)
    folders = [p for p in (f"{root}/okf/{k}" for k in ("topics", "maps")) if any(n.endswith(".md") for n in names_in(spark, p))]
    schema = "file string, kind string, id string, okf_type string, title string, shortdesc string, okf_version string, relations array<string>, content string"
    if not folders:
        return spark.createDataFrame([], schema)
    t = spark.read.option("pathGlobFilter", "*.md").text(folders, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import unquote

        for b in batches:
            rows = []
            for p, text in zip(b["p"], b["value"]):
                folder, name = unquote(p).rsplit("/", 2)[1:]
                try:
                    head = split_concept(text)[0]
                    f, targets = read_front_matter(head), read_relations(head)
                except ValueError:
                    f, targets = {}, []
                rows.append((f"{folder}/{name}", folder[:-1], f.get("id") or name[:-3], f.get("type"), f.get("title"), f.get("description"), f.get("okf_version"), targets, text))
            yield pd.DataFrame(rows, columns=["file", "kind", "id", "okf_type", "title", "shortdesc", "okf_version", "relations", "content"])

    return t.mapInPandas(run, schema)


def bundle_root(config: str | None = None, path: str | None = None) -> str:
    """The bundle's folder from a server configuration, a path, or the working folder."""
    if config:
        with open(config, "rb") as f:
            okf = tomllib.load(f)["graph"]["okf"]
        return os.path.dirname(os.path.realpath(os.path.join(os.path.dirname(os.path.abspath(config)), okf)))
    return path or "."

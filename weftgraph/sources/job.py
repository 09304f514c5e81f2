"""Job folders of resolved XML to nodes, ordered edges and diagnostics."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import is_file, read_text, task_store
from ..operators import resolve
from ..schema import display_type
from ..session import cut, ship
from . import xml_parse

# link classes in the order a node lists them
CONTAINS, LINKED, REUSED, APPLIES, RELATED = range(5)


def edge_order(node_ord, link_class: int, ord_):
    """Place of an edge in the whole graph: its node, its class, its place there; no global sort."""
    return F.shiftleft(node_ord.cast("long"), 32) + F.lit(link_class << 29) + ord_.cast("long")


def find_manifest(spark: SparkSession, job_dir: str) -> str:
    for name in (".job.xml", "job.xml"):
        if is_file(spark, f"{job_dir}/{name}"):
            return f"{job_dir}/{name}"
    raise FileNotFoundError(f"no .job.xml or job.xml in {job_dir}")


def read_manifest(spark: SparkSession, job_dir: str) -> DataFrame:
    """(ord, path, format, src, input) of every file of the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for xml in b["value"]:
                rows = [
                    (i, f.get("path") or "", f.get("format") or "", f.get("src") or "", f.get("input") == "true")
                    for i, f in enumerate(ElementTree.fromstring(xml).iter("file"))
                ]
                yield pd.DataFrame(rows, columns=["ord", "path", "format", "src", "input"])

    ship(spark)
    # read here, as Spark's readers skip names with a leading dot
    whole = spark.createDataFrame([(read_text(spark, find_manifest(spark, job_dir)),)], "value string")
    return whole.mapInPandas(run, "ord long, path string, format string, src string, input boolean")


def root_map(manifest: DataFrame) -> str:
    """The first map marked as input, else the first map."""
    r = manifest.where("format = 'ditamap'").orderBy(F.desc("input"), "ord").select("path").first()
    if r is None:
        raise ValueError("the job has no map")
    return r["path"]


FILES = 200  # files that one task reads, about


def _contents(spark: SparkSession, job_dir: str, files: DataFrame) -> DataFrame:
    """(ord, path, xml) of the files listed, each read by the task that has its row; whatever else lies
    in the folder is not touched. A file that is not there has no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = task_store(job_dir)
        for b in batches:
            for ord_, path in zip(b["ord"], b["path"]):
                try:
                    with store.open_input_stream(f"{base}/{path}") as f:
                        yield pd.DataFrame({"ord": [ord_], "path": [path], "xml": [f.read()]})
                except FileNotFoundError:
                    continue

    n = files.count()
    spread = files.select("ord", "path").repartition(max(1, -(-n // FILES)), "path")
    return spread.mapInPandas(run, "ord long, path string, xml binary")


TOPIC_ROWS = (
    "path string, ord long, root_tag string, id string, topic_type string, title string, shortdesc string, body string, audience array<string>, "
    "product array<string>, uicontrols array<string>, cmd_uicontrols array<string>, status string, foreign array<string>, "
    "links array<struct<relation: string, target: string>>"
)


def read_topics(spark: SparkSession, job_dir: str, manifest: DataFrame) -> DataFrame:
    """One record a topic file. Reused content is known by source marks; which marks are other
    topics of the job is decided by a join, so no list of all files travels to the tasks."""
    files = manifest.where("format = 'dita'")
    xml = cut(_contents(spark, job_dir, files))  # read twice below, from the source once

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, m) for p, x in zip(b["path"], b["xml"]) for m in xml_parse.foreign_marks(x)]
            yield pd.DataFrame(rows, columns=["path", "src"])

    found = xml.select("path", "xml").mapInPandas(marks, "path string, src string")
    origin = files.where("src <> ''").select("src", F.col("path").alias("origin"))
    known = found.join(origin, "src").groupBy("path").agg(F.collect_list(F.struct("src", "origin")).alias("known"))
    return parse_topics(xml.join(known, "path", "left"))


KNOWN = "array<struct<src: string, origin: string>>"


def parse_topics(files: DataFrame) -> DataFrame:
    """Records of topic files (ord, path, xml, known); ``known``: the file of each source mark that is
    one of the job's topics."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for o, p, x, k in zip(b["ord"], b["path"], b["xml"], b["known"]):
                r = xml_parse.parse_topic(p, x, {e["src"]: e["origin"] for e in k} if k is not None else {})
                r["ord"] = o
                r["links"] = [{"relation": a, "target": t} for a, t in r["links"]]
                out.append(r)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TOPIC_ROWS.split(", ") if ":" not in c or c.startswith("links")])

    ship(files.sparkSession)
    return files.select("ord", "path", "xml", "known").mapInPandas(run, TOPIC_ROWS)


MAP_ROWS = "row string, id string, title string, source_file string, kind string, container string, target string, level int, keys array<string>, ord long"


def parse_maps(files: DataFrame) -> DataFrame:
    """Records of map files (path, xml): a row for the map, then one for each reference."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, xml in zip(b["path"], b["xml"]):
                m, rows = xml_parse.parse_map(path, xml)
                none = {"kind": None, "container": None, "target": None, "level": 0, "keys": []}
                out = [{"row": "map", **m, **none, "ord": -1}]
                out += [{"row": "ref", "id": None, "title": None, "source_file": path, **r, "ord": i} for i, r in enumerate(rows)]
                yield pd.DataFrame(out)

    ship(files.sparkSession)
    return files.select("path", "xml").mapInPandas(run, MAP_ROWS)


def read_map(spark: SparkSession, job_dir: str, path: str) -> DataFrame:
    one = spark.createDataFrame([(0, path)], "ord long, path string")
    return parse_maps(_contents(spark, job_dir, one))


def extract(spark: SparkSession, job_dir: str, depth: int | None = None, include_drafts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, diagnostics) of a job folder; ``depth`` cuts the levels of containment."""
    job_dir = job_dir.rstrip("/") or "/"
    manifest = cut(read_manifest(spark, job_dir))
    map_path = root_map(manifest)
    refs = cut(read_map(spark, job_dir, map_path))
    parsed = cut(read_topics(spark, job_dir, manifest))
    topics, renamed = resolve.disambiguate(parsed)
    topics = cut(topics)
    ids = topics.select("path", "id")
    map_id = refs.where("row = 'map'").first()["id"]

    most = depth if depth is not None else (1 << 30)
    held = refs.where("kind = 'contains'").where(F.col("level") <= most)
    contains, lost = resolve.resolve_containment(held.select(F.col("container").alias("src_path"), F.col("target").alias("target_path"), "ord"), ids, map_id)
    lost = lost.withColumn("subject", F.coalesce("subject", F.lit(map_path)))
    raw = parsed.select(F.col("path").alias("src_path"), F.posexplode("links").alias("ord", "l")).select("src_path", F.col("l.target").alias("target_path"), F.col("l.relation").alias("relation"), "ord")
    links, lost_links = resolve.resolve_links(raw, ids)
    reuse = parsed.select(F.col("path").alias("src_path"), F.posexplode("foreign").alias("ord", "target_path"))
    reused = resolve.resolve_reuse(reuse, ids)

    keys = held.where(F.size("keys") > 0).groupBy(F.col("target").alias("path")).agg(F.max_by("keys", "ord").alias("keys"))
    kept, drafts = resolve.without_drafts(topics.join(keys, "path", "left"), include_drafts)
    topic_nodes = kept.select(
        F.lit("topic").alias("kind"), "id", "topic_type", display_type(F.lit("topic"), F.col("topic_type")).alias("okf_type"), "title", "shortdesc", "body", "audience", "product",
        F.coalesce("keys", F.array().cast("array<string>")).alias("keys"), "uicontrols", "cmd_uicontrols", F.col("path").alias("source_file"), (F.col("ord") + 1).alias("node_ord"),
    )
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    map_node = refs.where("row = 'map'").select(
        F.lit("map").alias("kind"), "id", none.alias("topic_type"), display_type(F.lit("map"), none).alias("okf_type"), "title", none.alias("shortdesc"), none.alias("body"),
        *[empty.alias(c) for c in ("audience", "product", "keys", "uicontrols", "cmd_uicontrols")], "source_file", F.lit(0).cast("long").alias("node_ord"),
    )
    nodes = map_node.unionByName(topic_nodes)

    order = nodes.select(F.col("id").alias("src"), "node_ord", "kind")
    out = None
    for cls, e in ((CONTAINS, contains), (LINKED, links), (REUSED, reused)):
        # the map and a topic may have one id: containment by the map is the map's
        e = e.join(order.groupBy("src").agg(F.min("node_ord").alias("node_ord")), "src")
        e = e.select("src", "dst", "relation", edge_order(F.col("node_ord"), cls, F.col("ord")).alias("edge_ord"))
        out = e if out is None else out.unionByName(e)

    odd = parsed.where("root_tag <> topic_type").select(
        F.lit("040W").alias("id"), F.lit("warning").alias("severity"), F.concat(F.lit("Unknown topic type: "), "root_tag").alias("message"), F.col("path").alias("subject")
    )
    nav = refs.where("kind = 'navref'").where(F.col("level") <= most + 1).select(
        F.lit("060W").alias("id"), F.lit("warning").alias("severity"), F.concat(F.lit("navref is not resolved: "), "target").alias("message"), F.lit(map_path).alias("subject")
    )
    notes = lost.unionByName(lost_links).unionByName(renamed).unionByName(drafts).unionByName(odd).unionByName(nav)
    return nodes, out, notes


def with_inferred(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, diagnostics): applies-to first, then related-to, which sees the edges of the former."""
    from ..operators import infer

    order = nodes.groupBy("id").agg(F.max("node_ord").alias("ord"))
    src, dst = (order.select(F.col("id").alias(end), F.col("ord").alias(f"{end}_ord")) for end in ("src", "dst"))

    def placed(e: DataFrame, relation: str, cls: int) -> DataFrame:
        # edges of one class leave a node in the order of their targets, so the target's place is theirs
        return e.select("src", "dst", F.lit(relation).alias("relation"), edge_order(F.col("src_ord"), cls, F.col("dst_ord")).alias("edge_ord"))

    new, ambiguous = infer.applies_to(nodes, edges)
    one = cut(edges.unionByName(placed(new.join(src, "src").join(dst, "dst"), "applies-to", APPLIES)))
    two = one.unionByName(placed(infer.related_to(nodes, one), "related-to", RELATED))
    notes = ambiguous.select(
        F.lit("010W").alias("id"), F.lit("warning").alias("severity"),
        F.concat(F.lit("'"), "term", F.lit("' is used by several references: "), "candidates").alias("message"), F.col("task_id").alias("subject"),
    )
    return two, notes

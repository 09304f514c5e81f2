"""Publishing a bundle: concept files, index, graph, text index, configuration.

Nodes and edges go out as Parquet, the edges twice, clustered by either end, for point lookups in
both directions; the server reads these. Files of the interchange format are written beside them:
concept files by the tasks, one by one, the single-file documents as sorted parts that are then
joined. The folder may lie in any file system that Spark and pyarrow both know.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import __version__
from ..files import delete, exists, join_files, rename, task_store, write_text
from ..operators import check, lookup
from ..session import cut, ship

PRODUCER = f"weftgraph {__version__}"
HEADINGS = {"contains": "Contains", "references": "References", "related-to": "Related To", "applies-to": "Applies To", "requires": "Requires", "generated-from": "Generated From"}
SERVER_CONFIG = '[server]\nname = "weftgraph"\ntransport = "stdio"\n\n[graph]\nokf = "../okf"\n'

_UNSAFE = r'[/\\\x00-\x1f:*?"<>|]'
_PLAIN = re.compile(r"[A-Za-z][A-Za-z0-9 _./()-]*[A-Za-z0-9_./)]|[A-Za-z]")
_WORDS = {"true", "false", "null", "yes", "no", "on", "off", "y", "n", "nan"}


def scalar(text: str) -> str:
    """A YAML scalar; JSON strings are YAML, so whatever is not plainly safe is quoted like one."""
    return text if _PLAIN.fullmatch(text) and text.lower() not in _WORDS else json.dumps(text, ensure_ascii=False)


NAME = 200  # bytes of a file name; of a longer one a quarter of that is kept, in characters


def file_name(node_id: str) -> str:
    """An id as a file name: separators and leading dots cannot leave the folder, and no name begins
    like those that readers skip. A name that had to be changed ends in a hash of the id, so that no
    two ids get one name."""
    name = re.sub(_UNSAFE, "-", node_id)
    name = "-" + name if name.startswith((".", "_")) or not name else name
    name = name if len(name.encode()) <= NAME else name[: NAME // 4]
    return name if name == node_id else f"{name}~{hashlib.md5(node_id.encode()).hexdigest()[:12]}"


def file_name_of(node_id: Column) -> Column:
    """:func:`file_name` of a column."""
    name = F.regexp_replace(node_id, _UNSAFE, "-")
    name = F.when(name.startswith(".") | name.startswith("_") | (name == ""), F.concat(F.lit("-"), name)).otherwise(name)
    name = F.when(F.octet_length(name) <= NAME, name).otherwise(F.substring(name, 1, NAME // 4))
    return F.when(name == node_id, node_id).otherwise(F.concat(name, F.lit("~"), F.substring(F.md5(node_id), 1, 12)))


TO_TOPIC, TO_MAP = "\0t", "\0m"  # where a link's folder stands until it is known which file it is in


def render_concept(n: dict, sections: list[dict], relations: dict[str, list[str]] | None, at: str) -> str:
    """A concept file. ``sections``: relation and lines in order, folders not yet put in."""
    head = [f"type: {scalar(n['okf_type'] or '')}", f"title: {scalar(n['title'] or n['id'])}"]
    if file_name(n["id"]) != n["id"]:
        head.append(f"id: {scalar(n['id'])}")
    if n["shortdesc"] is not None:
        head.append(f"description: {scalar(n['shortdesc'])}")
    head.append(f"resource: {scalar(n['source_file'] or '')}")
    if n["tags"]:
        head += ["tags:", *[f"- {scalar(t)}" for t in n["tags"]]]
    head += ["generated:", f"  by: {scalar(PRODUCER)}", f"  at: {at}"]
    if relations:
        head.append("relations:")
        for r in sorted(relations):
            head += [f"  {r}:", *[f"  - {scalar(t)}" for t in relations[r]]]
    body = []
    if n["shortdesc"] is not None:
        body.append(f"# Summary\n\n{n['shortdesc']}\n")
    if n["body"] is not None:
        body.append(f"# Content\n\n{n['body']}\n")
    topics, maps = ("", "../maps/") if n["kind"] == "topic" else ("../topics/", "")
    for s in sections:
        body.append(f"# {HEADINGS[s['relation']]}\n\n" + s["lines"].replace(TO_TOPIC, topics).replace(TO_MAP, maps) + "\n")
    text = "\n".join(body).rstrip()
    return "---\n" + "\n".join(head) + "\n---\n\n" + text


FILES = 500  # files that one task renders and writes, about


def concepts(nodes: DataFrame, edges: DataFrame, at: str, n: int) -> DataFrame:
    """(file, content) of every node; ``n``: their number. Small files cost by the piece, not by the
    byte, so they are spread by number."""
    target = nodes.groupBy(F.col("id").alias("dst")).agg(F.max_by(F.struct("title", "kind"), F.when(F.col("kind") == "topic", 1).otherwise(0)).alias("t"))
    e = edges.join(target, "dst", "left")
    folder = F.when(F.col("t.kind") == "map", TO_MAP).otherwise(TO_TOPIC)
    line = F.concat(F.lit("- ["), F.coalesce("t.title", "dst"), F.lit("]("), folder, file_name_of(F.col("dst")), F.lit(".md)"))
    # links become text here; the tasks that render get one text a relation, and ids only where they are listed
    e = e.select("src", "edge_ord", "relation", line.alias("line"), F.when(F.col("relation").isin(*lookup.LISTED), F.col("dst")).alias("dst"))
    g = e.groupBy("src", "relation").agg(F.min("edge_ord").alias("first"), F.array_sort(F.collect_list(F.struct("edge_ord", "line", "dst"))).alias("x"))
    g = g.select("src", "relation", "first", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("lines"), F.array_compact(F.transform("x", lambda x: x["dst"])).alias("listed"))
    g = g.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("first", "relation", "lines", "listed"))).alias("sections"))
    t = lookup.tags(nodes).dropDuplicates(["id"])
    d = nodes.join(g, "id", "left").join(t, "id", "left").select("kind", "id", "okf_type", "title", "shortdesc", "body", "source_file", "tags", "sections")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n in b.to_dict("records"):
                n = {k: (None if v is None or (isinstance(v, float) and v != v) else v) for k, v in n.items()}
                secs = list(n["sections"]) if n["sections"] is not None else []
                rel = {s["relation"]: list(s["listed"]) for s in secs if s["relation"] in lookup.LISTED}
                n["tags"] = list(n["tags"]) if n["tags"] is not None and n["kind"] == "topic" else []
                rows.append((f"{n['kind']}s/{file_name(n['id'])}.md", render_concept(n, secs, rel, at)))
            yield pd.DataFrame(rows, columns=["file", "content"])

    return d.repartition(max(1, -(-n // FILES)), "kind", "id").mapInPandas(run, "file string, content string")


def _write_files(files: DataFrame, root: str) -> None:
    """Each task writes its own files below ``root``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = task_store(root)
        for folder in ("topics", "maps"):
            store.create_dir(f"{base}/{folder}", recursive=True)
        for b in batches:
            for name, content in zip(b["file"], b["content"]):
                with store.open_output_stream(f"{base}/{name}") as f:
                    f.write(content.encode("utf-8"))
            yield pd.DataFrame({"n": [len(b)]})

    files.mapInPandas(run, "n long").agg(F.sum("n")).collect()


def _line(*fields: str) -> Column:
    return F.to_json(F.struct(*fields))


def _node_lines(nodes: DataFrame) -> DataFrame:
    """(doc, node_ord, id, line): the lines that the single-file documents have of each node."""
    # titles may hold line ends, file names cannot
    shown = F.concat(F.lit("- ["), F.regexp_replace("title", r"\s+", " "), F.lit("]("), "kind", F.lit("s/"), file_name_of(F.col("id")), F.lit(".md)"))
    graph = F.concat(F.lit(","), F.to_json(F.struct("id", F.col("okf_type").alias("type"))))
    lines = F.array(F.struct(F.concat("kind", F.lit("s")).alias("doc"), shown.alias("line")), F.struct(F.lit("nodes").alias("doc"), graph.alias("line")))
    return nodes.select("node_ord", "id", F.explode(lines).alias("x")).select("x.doc", "node_ord", "id", "x.line")


def _chunk_lines(nodes: DataFrame) -> DataFrame:
    c = lookup.text_chunks(nodes, "node_ord")
    return c.select(F.lit("chunks").alias("doc"), "node_ord", "id", _line("id", "title", "text", "topicType", "audience", "product", "okfNode").alias("line"))


def edge_lines(edges: DataFrame) -> DataFrame:
    e = F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "relation")
    return edges.select("edge_ord", F.concat(F.lit(","), F.to_json(e)).alias("line"))


def _sorted_parts(lines: DataFrame, order: list[str], path: str, *by: str) -> None:
    """Sorted lines in parts, whose names are in the order of the lines."""
    w = lines.orderBy(*order).select(*by, "line").write
    (w.partitionBy(*by) if by else w).text(path)


def _join_documents(spark, stage: str, parts: str, stamp: str, topics: int, graph_json: bool) -> None:
    """The single-file documents, of the parts that were written."""
    at = lambda doc: (f"{parts}/nodes/doc={doc}", 0)
    head = f'---\nokf_version: "0.2"\n---\n\n# Knowledge bundle\n\nGenerated {stamp} by {PRODUCER}.\n'
    join_files(spark, f"{stage}/okf/index.md", [head.encode(), b"\n## Maps\n\n", at("maps"), b"\n## Topics\n\n", at("topics")])
    write_text(spark, f"{stage}/okf/okf.toml", f'okf_version = "0.2"\ngenerator = "{PRODUCER}"\noutput = "."\n')
    join_files(spark, f"{stage}/rag/chunks.jsonl", [at("chunks")])
    write_text(spark, f"{stage}/rag/metadata.json", json.dumps({"generated": {"by": PRODUCER, "at": stamp}, "chunkCount": topics}, indent=2) + "\n")
    if graph_json:  # a line begins with a comma, which the first line must not have
        join_files(spark, f"{stage}/graph.json", [b'{"nodes": [\n', (at("nodes")[0], 1), b'], "edges": [\n', (f"{parts}/edges", 1), b"]}\n"])


def publish(nodes: DataFrame, edges: DataFrame, root: str, graph_json: bool = True, server: bool = False, at: datetime | None = None, tables: dict[str, DataFrame] | None = None) -> tuple[dict, DataFrame]:
    """Check the bundle and write it. Returns (summary, findings); with an error among the findings
    nothing is left: the bundle appears in ``root`` as a whole or not at all. The former bundle is
    moved aside before the new one takes its place, and is deleted only then. ``tables``: further ones
    to write beside nodes and edges, by name."""
    stamp = (at or datetime.now(timezone.utc)).astimezone(timezone.utc).isoformat()
    spark, root = nodes.sparkSession, root.rstrip("/")
    ship(spark)
    n_seen, e_seen, f_seen = Observation(), Observation(), Observation()
    count = F.count(F.lit(1)).alias("n")
    stage, parts = f"{root}.staging", f"{root}.staging.parts"
    delete(spark, stage)
    delete(spark, parts)
    # the writes depend on nothing but the two tables, so they run side by side, and beside the checks:
    # what is staged is not the bundle yet
    with ThreadPoolExecutor(8) as pool:
        one = pool.submit(cut, nodes.observe(n_seen, count, F.count_if(F.col("kind") == "topic").alias("topics")))
        two = pool.submit(cut, edges.observe(e_seen, count))
        nodes, edges = one.result(), two.result()
        rendered = pool.submit(cut, concepts(nodes, edges, stamp, n_seen.get["n"]))
        jobs = [pool.submit(_sorted_parts, _node_lines(nodes).unionByName(_chunk_lines(nodes)), ["doc", "node_ord", "id"], f"{parts}/nodes", "doc")]
        if graph_json:
            jobs.append(pool.submit(_sorted_parts, edge_lines(edges), ["edge_ord"], f"{parts}/edges"))
        for name, df, key in (("nodes", nodes, "id"), ("edges_by_src", edges, "src"), ("edges_by_dst", edges, "dst")):
            jobs.append(pool.submit(df.repartitionByRange(key).sortWithinPartitions(key).write.parquet, f"{stage}/tables/{name}"))
        for name, df in (tables or {}).items():
            jobs.append(pool.submit(df.write.parquet, f"{stage}/tables/{name}"))
        files = rendered.result()
        jobs.append(pool.submit(_write_files, files, f"{stage}/okf"))
        rag = _chunk_lines(nodes).select(F.lit("rag/chunks.jsonl").alias("file"), F.col("line").alias("content"))
        found = cut(check.findings(nodes, edges, files, rag).observe(f_seen, F.count_if(F.col("severity") == "error").alias("errors")))
        for j in jobs:
            j.result()
    topics = n_seen.get["topics"]
    summary = {"topics": topics, "maps": n_seen.get["n"] - topics, "edges": e_seen.get["n"], "chunks": 0, "errors": f_seen.get["errors"]}
    if summary["errors"]:
        delete(spark, stage)
        delete(spark, parts)
        return summary, found
    summary["chunks"] = topics
    _join_documents(spark, stage, parts, stamp, topics, graph_json)
    delete(spark, parts)
    if server:
        write_text(spark, f"{stage}/mcp/mcp-server.toml", SERVER_CONFIG)
    write_text(spark, f"{stage}/tables/built.json", json.dumps({"by": PRODUCER, "at": stamp}) + "\n")
    old = f"{root}.old"
    delete(spark, old)
    if exists(spark, root):
        rename(spark, root, old)
    rename(spark, stage, root)
    delete(spark, old)
    return summary, found

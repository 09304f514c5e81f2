"""Query tools over a published bundle, as text and over JSON-RPC on standard input and output."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .files import is_file, names_in, stamp
from .operators import check, lookup, search, traverse
from .session import scope
from .sources import model

# Fixed values of the protocol, here and below: its version, the names of tools and arguments, and the
# lines of the answers.
PROTOCOL = "2024-11-05"

_ID = {"type": "string", "description": "Id of a topic or map, as search_topics gives it"}
_RELATION = {"type": "string", "description": "Only this relation"}
_DEPTH = {"type": "integer", "minimum": 0, "description": "Hops to follow"}
_QUERY = {"type": "string", "description": "Text to look for"}


def _tool(name: str, description: str, required: list[str], **properties) -> dict:
    return {"name": name, "description": description, "inputSchema": {"type": "object", "properties": properties, "required": required}}


TOOLS = [
    _tool("search_topics", "Find topics and maps by title or id.", ["query"], query=_QUERY),
    _tool("find_related_topics", "List what a topic links to.", ["topicId"], topicId=_ID, relation=_RELATION),
    _tool("explain_task", "Title, description, excerpt and main relations of a topic.", ["topicId"], topicId=_ID),
    _tool("trace_dependencies", "Follow prerequisites from a topic.", ["topicId"], topicId=_ID, depth=_DEPTH),
    _tool("search_content", "Ranked search in the text, if wanted only in what a topic reaches.", ["query"], query=_QUERY, topicId=_ID, relation=_RELATION, depth=_DEPTH),
    _tool("analyze_impact", "List what depends on a topic, directly or through others.", ["topicId"], topicId=_ID, depth=_DEPTH),
    _tool("generate_summary", "Title and description of a topic.", ["topicId"], topicId=_ID),
    _tool("validate_bundle", "Check the bundle's files.", []),
]


class ToolError(Exception):
    """An error that the caller of a tool is told."""


def _text(args: dict, key: str) -> str:
    v = args.get(key)
    if not isinstance(v, str):
        raise ToolError(f"missing required argument `{key}`")
    return v


def _optional(args: dict, key: str) -> str | None:
    return args[key] if isinstance(args.get(key), str) else None


def _depth(args: dict, default: int) -> int:
    v = args.get("depth")
    return v if isinstance(v, int) and not isinstance(v, bool) and v >= 0 else default


class Snapshot:
    """The tables of a bundle at one moment. A bundle that was published has them as Parquet, nodes
    sorted by id and edges by either end, so that a point lookup reads the row groups it needs; only
    where these are missing, or older than the interchange files, are the latter read."""

    def __init__(self, spark: SparkSession, root: str):
        self.cached: list[DataFrame] = []
        if has_tables(spark, root):
            nodes = spark.read.parquet(f"{root}/tables/nodes")
            # of an id that is both a topic and a map the topic is shown
            topic = F.when(F.col("kind") == "topic", 1).otherwise(0)
            shown = nodes.groupBy("id").agg(F.max_by(F.struct("okf_type", "node_ord", "title", "shortdesc"), topic).alias("n"))
            self.nodes = shown.select("id", "n.okf_type", "n.node_ord", F.coalesce("n.title", "id").alias("title"), "n.shortdesc", F.lit(True).alias("has_file"))
            self.edges, self.edges_to = (spark.read.parquet(f"{root}/tables/edges_by_{end}") for end in ("src", "dst"))
            self.chunks = lookup.text_chunks(nodes)
            return
        graph, edges = model.read_graph(spark, root)
        info = model.read_concepts(spark, root)
        info = info.groupBy("id").agg(F.max_by(F.struct("title", "shortdesc"), F.when(F.col("kind") == "topic", 1).otherwise(0)).alias("i"), F.lit(True).alias("has_file"))
        n = graph.join(info, "id", "left")
        self.nodes = n.select(
            "id", "okf_type", "node_ord", F.coalesce("i.title", "id").alias("title"), F.col("i.shortdesc").alias("shortdesc"), F.coalesce("has_file", F.lit(False)).alias("has_file")
        ).cache()
        self.edges, self.chunks = edges.cache(), model.read_chunks(spark, root).cache()
        self.edges_to = self.edges
        self.cached = [self.nodes, self.edges, self.chunks]
        for t in self.cached:
            t.count()

    def close(self) -> None:
        for t in self.cached:
            t.unpersist()


INTERCHANGE = ("graph.json", "rag/chunks.jsonl")


def has_tables(spark: SparkSession, root: str) -> bool:
    """Whether the tables of a bundle are there and no interchange file was changed after them."""
    built = stamp(spark, f"{root}/tables/built.json")
    others = [stamp(spark, f"{root}/{name}") for name in INTERCHANGE]
    return built is not None and all(o is None or o[0] <= built[0] for o in others)


class Bundle:
    """A bundle under a folder; read anew when its graph or its text index has changed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._mark: tuple | None = None
        self._snapshot: Snapshot | None = None

    def _stamp(self) -> tuple:
        return tuple(stamp(self.spark, f"{self.root}/{name}") for name in (*INTERCHANGE, "tables/built.json"))

    def tables(self) -> Snapshot:
        mark = self._stamp()
        if self._snapshot is None or mark != self._mark:
            try:
                fresh = Snapshot(self.spark, self.root)
            except Exception as e:
                if self._snapshot is None:
                    raise ToolError(f"the bundle in {self.root} cannot be read: {str(e)[:300]}") from e
                return self._snapshot
            if self._snapshot is not None:
                self._snapshot.close()
            self._snapshot, self._mark = fresh, mark
        return self._snapshot

    # the tools, each a text

    def call(self, name: str, args: dict) -> str:
        if name not in {t["name"] for t in TOOLS}:
            raise ToolError(f"unknown tool: {name}")
        with scope(self.spark):  # a walk's levels are not needed once the answer is there
            return getattr(self, name)(args)

    def _node(self, t: Snapshot, node_id: str):
        r = t.nodes.where((F.col("id") == node_id) & F.col("has_file")).first()
        if r is None:
            asked = self.spark.createDataFrame([(node_id,)], "id string")
            s = lookup.suggest_ids(t.nodes, asked).first()
            raise ToolError(f"no concept `{node_id}`" + (f" -- did you mean `{s['suggestion']}`?" if s else ""))
        return r

    def _titled(self, t: Snapshot, df: DataFrame, column: str) -> DataFrame:
        n = lookup.titles(t.nodes).select(F.col("id").alias(column), F.col("title").alias("shown"))
        return df.join(n, column, "left").withColumn("shown", F.coalesce("shown", column))

    def search_topics(self, args: dict) -> str:
        q = _text(args, "query")
        lines = sorted(r["line"] for r in search.search_topics(self.tables().nodes, q).select("line").collect())
        return "\n".join(lines) or f"no topics matched `{q.lower()}`"

    def search_content(self, args: dict) -> str:
        try:
            words = search.terms(_text(args, "query"))
        except ValueError as e:
            raise ToolError("`query` must contain at least one word") from e
        t, start = self.tables(), _optional(args, "topicId")
        if t.chunks.isEmpty():
            return "the bundle has no text index"
        scope = traverse.forward_reachable(t.edges, start, _depth(args, 3), _optional(args, "relation")) if start else None
        rows = search.search_content(t.chunks, " ".join(words), scope)
        kinds = t.chunks.select("id", "topicType", F.col("text").isNotNull().alias("has")).dropDuplicates(["id"])
        rows = rows.join(kinds, "id").orderBy("rank").collect()
        if not rows:
            return f"no content matched `{' '.join(words)}`" + (f" within topics reachable from `{start}`" if start else "")
        out = []
        for r in rows:
            out.append(f"{r['title']} ({r['topicType']}) [{r['id']}] (score: {r['score']})" + (f"\n  {r['excerpt']}" if r["has"] else ""))
        total = rows[0]["n_matches"]
        if total > search.TOP:
            out.append(f"\n(showing top {search.TOP} of {total} matches -- narrow with topicId to see more of a specific area)")
        return "\n".join(out)

    def find_related_topics(self, args: dict) -> str:
        node, t = _text(args, "topicId"), self.tables()
        rows = lookup.find_related(t.nodes, t.edges, node, _optional(args, "relation")).orderBy("edge_ord").collect()
        return "\n".join(f"{r['relation']} -> {r['title']} ({r['dst']})" for r in rows) or f"no relations found for `{node}`"

    def explain_task(self, args: dict) -> str:
        node, t = _text(args, "topicId"), self.tables()
        n = self._node(t, node)
        out = f"Topic: {n['title']} ({node})\n{n['shortdesc'] if n['shortdesc'] is not None else '(no description)'}\n"
        c = t.chunks.where((F.col("id") == node) & F.col("text").isNotNull()).select(search.excerpt(F.col("text"), 300).alias("x")).first()
        if c:
            out += f"\n{c['x']}\n"
        rel = lookup.find_related(t.nodes, t.edges, node).orderBy("edge_ord").collect()
        for kind in ("requires", "contains", "applies-to"):
            lines = [f"  - {r['title']} ({r['dst']})\n" for r in rel if r["relation"] == kind]
            if lines:
                out += f"\n{kind}:\n" + "".join(lines)
        return out

    def trace_dependencies(self, args: dict) -> str:
        node, t = _text(args, "topicId"), self.tables()
        rows = self._titled(t, traverse.trace_dependencies(t.edges, node, _depth(args, 3)), "to_id").orderBy("level", "path").collect()
        return "\n".join(f"{'  ' * (r['level'] - 1)}{r['from_id']} requires {r['shown']} ({r['to_id']})" for r in rows) or "no `requires` dependencies found"

    def analyze_impact(self, args: dict) -> str:
        node, t = _text(args, "topicId"), self.tables()
        w = self._titled(t, traverse.analyze_impact(t.edges_to, node, _depth(args, 5)), "id")
        c = t.chunks.where("text is not null").select("id", search.excerpt(F.col("text"), 140).alias("x")).dropDuplicates(["id"])
        rows = w.join(c, "id", "left").orderBy("level", "path").collect()
        if not rows:
            return f"nothing depends on `{node}` (no incoming edges found)"
        lines = []
        for r in rows:
            pad = "  " * (r["level"] - 1)
            lines.append(f"{pad}{r['shown']} ({r['id']}) --{r['relation']}--> {r['via']}" + (f"\n{pad}  {r['x']}" if r["x"] is not None else ""))
        return f"changing `{node}` would affect {len(rows)} concept(s):\n" + "\n".join(lines)

    def generate_summary(self, args: dict) -> str:
        n = self._node(self.tables(), _text(args, "topicId"))
        return f"{n['title']}: {n['shortdesc'] if n['shortdesc'] is not None else '(no description)'}"

    def validate_bundle(self, args: dict) -> str:
        rows = validate_files(self.spark, self.root).orderBy("severity", "subject").collect()
        return "\n".join(f"{r['severity']} {r['rule']}: {r['subject']}" for r in rows) or "bundle OK: no issues"


def validate_files(spark: SparkSession, root: str) -> DataFrame:
    """(severity, rule, subject) of the files of a bundle as they lie there; needs no graph.

    Errors: no index; a file other than the index that carries ``okf_version``; a concept without a
    type; an id twice; a link or a listed relation that leads nowhere; a secret in ``okf`` or ``rag``.
    Warnings: a target linked twice in one file; a file that the index does not lead to.
    """
    root = root.rstrip("/")
    c = model.read_concepts(spark, root).cache()
    one = lambda df, severity, rule: df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.col("s").alias("subject"))
    out = one(c.where("okf_type is null or okf_type = ''").select(F.col("file").alias("s")), "error", "missing-type")
    out = out.union(one(c.where("okf_version is not null").select(F.col("file").alias("s")), "error", "version-outside-index"))
    out = out.union(one(check.duplicate_ids(c.select("id")).select(F.col("id").alias("s")), "error", "duplicate-id"))
    found = F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^- \[.*\]\(((?:\.\./(?:topics|maps)/)?[^()/]+\.md)\)$"), F.lit(1)))
    links = c.select("file", "kind", found.alias("l"))
    links = links.select("file", F.when(F.col("l").startswith("../"), F.substring("l", 4, 1 << 20)).otherwise(F.concat("kind", F.lit("s/"), "l")).alias("to"))
    bad = links.join(c.select(F.col("file").alias("to")).distinct(), "to", "left_anti").distinct()
    out = out.union(one(bad.select(F.concat("file", F.lit(" -> "), "to").alias("s")), "error", "dangling-link"))
    listed = c.select("file", F.explode("relations").alias("id")).distinct()
    lost = listed.join(c.select("id").distinct(), "id", "left_anti")
    out = out.union(one(lost.select(F.concat("file", F.lit(" -> "), "id").alias("s")), "error", "unknown-relation-target"))
    twice = links.groupBy("file", "to").count().where("count > 1")
    out = out.union(one(twice.select(F.concat("file", F.lit(" -> "), "to").alias("s")), "warning", "redundant-link"))
    files = c.select("file", "content")
    index = f"{root}/okf/index.md"
    if is_file(spark, index):
        i = spark.read.text(index)
        at = F.regexp_extract("value", r"^- \[.*\]\(((?:topics|maps)/[^()/]+\.md)\)$", 1)
        shown = i.select(at.alias("file")).where("file <> ''").distinct()
        far = check.unreachable(c.select("file"), links.select(F.col("file").alias("src"), F.col("to").alias("dst")), shown)
        out = out.union(one(far.select(F.col("file").alias("s")), "warning", "not-reachable"))
        gone = shown.join(c.select("file"), "file", "left_anti")
        out = out.union(one(gone.select(F.concat(F.lit("index.md -> "), "file").alias("s")), "error", "dangling-link"))
        files = files.union(i.select(F.lit("index.md").alias("file"), F.col("value").alias("content")))
    else:
        out = out.union(spark.createDataFrame([("error", "missing-index", "index.md")], out.schema))
    for name in names_in(spark, f"{root}/rag"):
        if not name.startswith((".", "_")):
            files = files.union(spark.read.text(f"{root}/rag/{name}").select(F.lit(f"rag/{name}").alias("file"), F.col("value").alias("content")))
    secret = check.secret_scan(files, "file", "content")
    return out.union(one(secret.select(F.concat("file", F.lit(": "), "pattern").alias("s")), "error", "secret"))


def handle(request: dict, bundle: Bundle) -> dict | None:
    """The answer to one request; None where there is none to give."""
    method = request.get("method") if isinstance(request, dict) else None
    if not isinstance(method, str):
        return None
    error = result = None
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "weftgraph", "version": __version__}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": TOOLS}
    elif method == "tools/call":
        params = request.get("params") if isinstance(request.get("params"), dict) else {}
        args = params.get("arguments") if isinstance(params.get("arguments"), dict) else {}
        try:
            text, failed = bundle.call(params.get("name") or "", args), False
        except ToolError as e:
            text, failed = str(e), True
        result = {"content": [{"type": "text", "text": text}], "isError": failed}
    elif method in ("notifications/initialized", "notifications/cancelled", "notifications/roots/list_changed"):
        return None
    else:
        error = {"code": -32601, "message": f"method not found: {method}"}
    if "id" not in request:
        return None
    return {"jsonrpc": "2.0", "id": request["id"], **({"error": error} if error else {"result": result})}


def serve(bundle: Bundle, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError as e:
            print(f"weftgraph: bad request: {e}", file=sys.stderr)
            continue
        answer = handle(request, bundle)
        if answer is not None:
            print(json.dumps(answer, ensure_ascii=False), file=out, flush=True)

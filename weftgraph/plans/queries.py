"""Registered queries of the core and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_id, file_stem
from ..operators import check, hierarchy, infer, lookup, orphans, perkey, resolve, reuse, search, traverse
from ..session import table
from ..sinks import bundle
from ..sources import job, xml_parse
from ..streaming import incremental
from . import testbed
from .oracle import ORACLE as _REFERENCE


def _product_topics(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "topics")
    return perkey.exploded_values(t, "product", "id", "built_at").withColumnRenamed("_value", "product")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    top = perkey.latest_per_key(_product_topics(spark, d), "product", "id", "built_at", 3)
    return top.select("product", F.col("id").alias("topic_id"))


def p4_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "topics").select(perkey.normal_values("product").alias("product"), "id", "built_at")
    return perkey.summary_per_key(t, "product", "id", "built_at")


def references(spark: SparkSession, d: str) -> DataFrame:
    """All references of the three referring tables."""
    out = None
    for name in ("topics", "maps"):
        t = table(spark, d, name).select("id", "built_at", F.explode("links").alias("l"))
        t = t.select(
            F.lit(name).alias("ref_table"), F.col("id").alias("from_id"), F.col("l.relation").alias("relation"),
            F.col("l.target_id").alias("target_id"), F.col("built_at").alias("at"),
        )
        out = t if out is None else out.unionByName(t)
    e = table(spark, d, "graph_edges").select(
        F.lit("graph_edges").alias("ref_table"), "from_id", "relation", F.col("to_id").alias("target_id"), F.col("built_at").alias("at")
    )
    return out.unionByName(e)


def spans(spark: SparkSession, d: str) -> DataFrame:
    """When each topic, map and library topic existed."""
    cols = ("id", "added_at", "removed_at")
    return table(spark, d, "graph_nodes").select(*cols).unionByName(table(spark, d, "library_topics").select(*cols))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    o = orphans.Orphans(references(spark, d), spans(spark, d)).direct
    return o.select("ref_table", "from_id", "relation", "target_id", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(orphans.orphan_references(references(spark, d), spans(spark, d)))


def publications(spark: SparkSession, d: str, roots_only: bool = False) -> hierarchy.Hierarchy:
    """The hierarchy of the containment edges between nodes of the graph."""
    ids = table(spark, d, "graph_nodes").select("id").where("id is not null").distinct()
    e = table(spark, d, "graph_edges").where("relation = 'contains'").select("from_id", "to_id").distinct()
    e = e.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return hierarchy.build_hierarchy(e, "from_id", "to_id", roots_only)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    h = publications(spark, d, roots_only=True)
    cyc = h.cycles.select(F.col("node").alias("node_id"), F.col("component").alias("root_id"), F.lit(-1).alias("depth"))
    return hierarchy.node_depths(h).unionByName(cyc)


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.node_paths(publications(spark, d, roots_only=True))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Subtree size and height of every node that contains something."""
    h = publications(spark, d)
    return h.descendants.groupBy(F.col("node").alias("node_id")).agg(F.count(F.lit(1)).alias("n_descendants"), F.max("dist").alias("height"))


def p5_descendant_rows(spark: SparkSession, d: str) -> DataFrame:
    """The descendants themselves with their least distances, for every node that contains something."""
    return publications(spark, d).descendants.select(F.col("node").alias("node_id"), F.col("desc").alias("descendant_id"), "dist")


def _least(df: DataFrame, column: str) -> DataFrame:
    """A table of the least value of a column, as start of a walk."""
    return df.agg(F.min(column).alias("id"))


def search_topics(spark: SparkSession, d: str) -> DataFrame:
    return search.search_topics(testbed.nodes(spark, d), "Ledger")


def search_content(spark: SparkSession, d: str) -> DataFrame:
    return search.search_content(testbed.chunks(spark, d), "Tenant palette tenant")


def _first_map(spark: SparkSession, d: str) -> DataFrame:
    return _least(table(spark, d, "maps"), "id")


def search_content_scoped(spark: SparkSession, d: str) -> DataFrame:
    scope = traverse.forward_reachable(testbed.edges(spark, d), _first_map(spark, d), 3)
    return search.search_content(testbed.chunks(spark, d), "snapshot", scope)


def find_related(spark: SparkSession, d: str) -> DataFrame:
    """Outgoing edges of every map, with titles."""
    return lookup.find_related(testbed.nodes(spark, d), testbed.edges(spark, d), table(spark, d, "maps").select("id"))


def forward_reachable(spark: SparkSession, d: str) -> DataFrame:
    return traverse.forward_reachable(testbed.edges(spark, d), _first_map(spark, d), 3)


def trace_dependencies(spark: SparkSession, d: str) -> DataFrame:
    e = testbed.edges(spark, d)
    t = traverse.trace_dependencies(e, _least(e.where("relation = 'requires'"), "src"), 3)
    return t.select("level", "from_id", "to_id")


def analyze_impact(spark: SparkSession, d: str) -> DataFrame:
    e = testbed.edges(spark, d)
    i = traverse.analyze_impact(e, _least(e.where("relation = 'requires'"), "dst"), 5)
    c = testbed.chunks(spark, d).select("id", search.excerpt(F.col("text"), 140).alias("excerpt"))
    return i.select("level", "id", "relation", "via").join(c, "id", "left")


def reachable_of_maps(spark: SparkSession, d: str) -> DataFrame:
    """What every map reaches within three hops, map by map."""
    starts = table(spark, d, "maps").select("id")
    return traverse.walk(testbed.edges(spark, d), starts, 3, each=True).select(F.col("start").alias("map_id"), "id", "level")


def trace_of_topics(spark: SparkSession, d: str) -> DataFrame:
    """The prerequisites of everything that requires something, each with a walk of its own."""
    e = testbed.edges(spark, d).where("relation = 'requires'")
    w = traverse.walk(e, e.select(F.col("src").alias("id")).distinct(), 3, each=True).where("level > 0")
    return w.select("start", "level", F.col("via").alias("from_id"), F.col("id").alias("to_id"))


def infer_applies_to(spark: SparkSession, d: str) -> DataFrame:
    return infer.applies_to(testbed.nodes(spark, d), testbed.edges(spark, d).where("relation <> 'applies-to'"))[0]


def ambiguous_terms(spark: SparkSession, d: str) -> DataFrame:
    return infer.applies_to(testbed.nodes(spark, d), testbed.edges(spark, d))[1]


def term_candidates(spark: SparkSession, d: str) -> DataFrame:
    return infer.term_candidates(testbed.nodes(spark, d))


def related_counts(spark: SparkSession, d: str) -> DataFrame:
    """For every topic the number of related-to edges it gets, no pair being made."""
    return infer.related_counts(testbed.nodes(spark, d), testbed.edges(spark, d))


def infer_related_to(spark: SparkSession, d: str) -> DataFrame:
    """The related-to relation of all topics, whole and in the space of its classes: rows ``member``
    (topic, class of equal product sets), ``link`` (two classes that share a product, one with itself
    where it has several members), ``linked`` (pairs that an edge connects already). Members of linked
    classes are related in both directions, except the pairs linked already."""
    n = testbed.nodes(spark, d)
    parts = (("member", infer.related_members(n)), ("link", infer.related_classes(n)), ("linked", infer.related_exceptions(n, testbed.edges(spark, d))))
    out = None
    for part, df in parts:
        df = df.toDF("a", "b").select(F.lit(part).alias("part"), "a", "b")
        out = df if out is None else out.unionByName(df)
    return out


def related_members(spark: SparkSession, d: str) -> DataFrame:
    return infer.related_members(testbed.nodes(spark, d))


def related_classes(spark: SparkSession, d: str) -> DataFrame:
    return infer.related_classes(testbed.nodes(spark, d))


def related_exceptions(spark: SparkSession, d: str) -> DataFrame:
    return infer.related_exceptions(testbed.nodes(spark, d), testbed.edges(spark, d))


def contains_depth_cut(spark: SparkSession, d: str) -> DataFrame:
    """Containment edges of all maps down to two levels."""
    e = testbed.edges(spark, d).where("relation = 'contains'")
    w = traverse.walk(e, table(spark, d, "maps").select("id").distinct(), 1).select(F.col("id").alias("src"))
    return e.join(w, "src", "left_semi").select("src", "dst").distinct()


def _topic_links(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "topics").select("id", F.posexplode("links").alias("ord", "l"))
    return t.select(F.col("id").alias("src_path"), base_id(F.col("l.target_id")).alias("target_path"), F.col("l.relation").alias("relation"), "ord").where(F.trim("target_path") != "")


def resolve_links(spark: SparkSession, d: str) -> DataFrame:
    ids = testbed.nodes(spark, d).select(F.col("id").alias("path"), "id")
    return resolve.resolve_links(_topic_links(spark, d), ids)[0].select("src", "dst", "relation", F.col("ord").cast("int").alias("ord"))


def unresolved_links(spark: SparkSession, d: str) -> DataFrame:
    ids = testbed.nodes(spark, d).select(F.col("id").alias("path"), "id")
    return resolve.resolve_links(_topic_links(spark, d), ids)[1].select("subject", "message").distinct()


def _topic_files(spark: SparkSession, d: str) -> DataFrame:
    """(id, path, ord) of the topics' files: ids from file names, claimed in order of the topics' ids."""
    t = table(spark, d, "topics").select("id", "source_file").distinct()
    return t.select(file_stem(F.col("source_file")).alias("id"), F.col("source_file").alias("path"), F.col("id").alias("ord"))


def dedup_ids(spark: SparkSession, d: str) -> DataFrame:
    return resolve.disambiguate(_topic_files(spark, d))[0].select("id", "path", F.col("ord").alias("topic_id"))


def dedup_ids_planted(spark: SparkSession, d: str) -> DataFrame:
    """The same with files whose own ids are those that renamed topics would get: for each later owner
    of an id one that comes before all topics, and one with ``-2`` right after it."""
    f = _topic_files(spark, d)
    late = f.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("n > 1")
    long = F.concat("id", F.lit("--"), F.translate("path", "/", "-"))
    first = late.select(long.alias("id"), F.concat(F.lit("first/"), "path").alias("path"), F.concat(F.lit("0"), "ord").alias("ord"))
    last = late.select(F.concat(long, F.lit("-2")).alias("id"), F.concat(F.lit("last/"), "path").alias("path"), F.concat("ord", F.lit("~")).alias("ord"))
    return resolve.disambiguate(f.unionByName(first).unionByName(last))[0].select("id", "path", F.col("ord").alias("topic_id"))


def contained(spark: SparkSession, d: str) -> DataFrame:
    """Containment by all maps, resolved: a target listed twice counts twice."""
    m = table(spark, d, "maps").dropDuplicates(["id"]).select("id", F.posexplode("links").alias("ord", "l")).where("l.relation = 'contains'")
    raw = m.select(F.col("id").alias("src_path"), base_id(F.col("l.target_id")).alias("target_path"), F.col("ord").cast("int").alias("ord"))
    ids = testbed.nodes(spark, d).select(F.col("id").alias("path"), "id").distinct()
    return resolve.resolve_containment(raw, ids, "")[0]


def reused(spark: SparkSession, d: str) -> DataFrame:
    ids = testbed.nodes(spark, d).select(F.col("id").alias("path"), "id").distinct()
    raw = _topic_links(spark, d).where("relation = 'generated-from'")
    return resolve.resolve_reuse(raw, ids).withColumn("ord", F.col("ord").cast("int"))


def graph_edge_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the edges in the flattened graph."""
    return bundle.edge_lines(testbed.edges(spark, d))


def edges_into_targets(spark: SparkSession, d: str) -> DataFrame:
    """All edges into the target that most edges name."""
    e = testbed.edges(spark, d)
    hub = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").first()
    return traverse.edges_to(e, hub["dst"] if hub else "")


def _escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def xml_maps(spark: SparkSession, d: str) -> DataFrame:
    """What the XML reader makes of all maps, written as XML: their references in order, every second
    of them inside the one before it."""
    m = table(spark, d, "maps").dropDuplicates(["id"])
    to = F.filter(F.transform(F.coalesce("links", F.array().cast(m.schema["links"].dataType)), lambda x: base_id(x["target_id"])), lambda x: F.trim(x) != "")
    ref = F.transform(to, lambda x, i: F.concat(F.lit('<topicref href="'), _escaped(x), F.when((i % 2 == 0) & (i < F.size(to) - 1), '">').when(i % 2 == 0, '"/>').otherwise('"/></topicref>')))
    xml = F.concat(F.lit('<map id="'), _escaped(F.col("id")), F.lit('"><title>'), _escaped(F.col("title")), F.lit("</title>"), F.array_join(ref, ""), F.lit("</map>"))
    rows = job.parse_maps(m.select(F.col("id").alias("path"), F.encode(xml, "UTF-8").alias("xml"))).where("row = 'ref'")
    return rows.select(F.col("source_file").alias("map_id"), F.col("ord").cast("int").alias("ord"), "container", "target", "level")


def xml_topics(spark: SparkSession, d: str) -> DataFrame:
    """What the XML reader makes of all topics, written as XML by a column expression."""
    esc = _escaped
    body = F.create_map(*[F.lit(x) for kv in xml_parse.BODY.items() for x in kv])[F.col("topic_type")]
    controls = F.array_join(F.transform("uicontrols", lambda x: F.concat(F.lit(" <uicontrol>"), esc(x), F.lit("</uicontrol>"))), "")
    tag = lambda name, c: F.concat(F.lit("<"), name, F.lit(">"), c, F.lit("</"), name, F.lit(">"))
    n = testbed.nodes(spark, d).where("kind = 'topic'")
    xml = F.concat(
        F.lit("<"), "topic_type", F.lit(' id="'), esc(F.col("id")), F.lit('" audience="'), esc(F.array_join("audience", " ")), F.lit('">'),
        tag(F.lit("title"), esc(F.col("title"))), F.coalesce(tag(F.lit("shortdesc"), esc(F.col("shortdesc"))), F.lit("")),
        tag(body, F.concat(F.coalesce(esc(F.col("body")), F.lit("")), controls)), F.lit("</"), "topic_type", F.lit(">"),
    )
    files = n.select(F.monotonically_increasing_id().alias("ord"), F.col("id").alias("path"), F.encode(xml, "UTF-8").alias("xml"))
    t = job.parse_topics(files.withColumn("known", F.lit(None).cast(job.KNOWN)))
    return t.select("id", "topic_type", "title", "shortdesc", "body", F.array_join("audience", "|").alias("audience"), F.array_join("uicontrols", "|").alias("uicontrols"))


def generated_from(spark: SparkSession, d: str) -> DataFrame:
    return reuse.generated_from(table(spark, d, "documents"), "doc_id", "text")


def canonical_body(spark: SparkSession, d: str) -> DataFrame:
    return reuse.canonical_text(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = lookup.text_chunks(testbed.nodes(spark, d))
    return c.select("id", "title", "text", "topicType", F.array_join("product", "|").alias("product"), F.array_join("audience", "|").alias("audience"), "okfNode")


def graph_view(spark: SparkSession, d: str) -> DataFrame:
    return lookup.graph_view(testbed.nodes(spark, d))


def tags(spark: SparkSession, d: str) -> DataFrame:
    return lookup.tags(testbed.nodes(spark, d)).select("id", F.array_join("tags", "|", "").alias("tags"))


def listed_relations(spark: SparkSession, d: str) -> DataFrame:
    return lookup.listed_relations(testbed.edges(spark, d))


def sections(spark: SparkSession, d: str) -> DataFrame:
    return lookup.sections(testbed.nodes(spark, d), testbed.edges(spark, d))


def dangling(spark: SparkSession, d: str) -> DataFrame:
    return check.dangling(testbed.nodes(spark, d), testbed.edges(spark, d))


def redundant_links(spark: SparkSession, d: str) -> DataFrame:
    return check.redundant_links(testbed.edges(spark, d))


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return check.duplicate_ids(table(spark, d, "topics").select("id").unionAll(table(spark, d, "maps").select("id")))


def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return check.secret_scan(table(spark, d, "documents"), "doc_id", "text")


def secret_scan_planted(spark: SparkSession, d: str) -> DataFrame:
    """The scan of all documents, four in five of which got a secret of one of the kinds; the parts of
    a secret stand apart here, so that this file holds none."""
    k = F.col("doc_id")
    plant = (
        F.when(k % 5 == 0, F.concat(F.lit("AK"), F.lit("IA"), F.lpad(F.hex(k), 16, "0")))
        .when(k % 5 == 1, F.concat(F.lit("-----BEGIN "), F.lit("EC PRIVATE KEY-----")))
        .when(k % 5 == 2, F.concat(F.lit("gh"), F.lit("o_"), F.lpad(k.cast("string"), 36, "x")))
        .when(k % 5 == 3, F.concat(F.lit("xo"), F.lit("xp-"), F.lpad(k.cast("string"), 12, "0")))
        .otherwise(F.lit("akia"))
    )
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n"), plant).alias("text"))
    return check.secret_scan(docs, "doc_id", "text")


def suggest_id(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions for the file names of all topics, where they are no ids themselves."""
    asked = table(spark, d, "topics").select(F.regexp_replace("source_file", "/", "-").alias("id"))
    return lookup.suggest_ids(testbed.nodes(spark, d), asked)


def suggest_id_planted(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions where each topic has a namesake with a tail of two parts, which is asked for."""
    tail = F.concat("topic_type", F.lit("--"), F.regexp_extract("id", "[^-]*$", 0))
    t = table(spark, d, "topics").select("id", tail.alias("tail")).distinct()
    nodes = testbed.nodes(spark, d).select("id").union(t.select(F.concat("id", F.lit("--"), "tail")))
    return lookup.suggest_ids(nodes, t.select(F.col("tail").alias("id")))


def explain(spark: SparkSession, d: str) -> DataFrame:
    """Explanation of every task."""
    n = testbed.nodes(spark, d)
    return lookup.explain(n, testbed.edges(spark, d), testbed.chunks(spark, d), n.where("topic_type = 'task'").select("id"))


def summary(spark: SparkSession, d: str) -> DataFrame:
    return lookup.summaries(testbed.nodes(spark, d))


def index_changes(spark: SparkSession, d: str) -> DataFrame:
    """What a text index made from the topics would change in the one that was delivered."""
    old = testbed.chunks(spark, d).select("id", "title", "text")
    return incremental.changes(old, lookup.text_chunks(testbed.nodes(spark, d)).select("id", "title", "text"), "id")


QUERIES = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p4_found": p4_found,
    "p4_summary": p4_summary,
    "p5_found": p5_found,
    "p5_paths": p5_paths,
    "p5_descendants": p5_descendants,
    "p5_descendant_rows": p5_descendant_rows,
    "search_topics": search_topics,
    "search_content": search_content,
    "search_content_scoped": search_content_scoped,
    "find_related": find_related,
    "forward_reachable": forward_reachable,
    "trace_dependencies": trace_dependencies,
    "analyze_impact": analyze_impact,
    "reachable_of_maps": reachable_of_maps,
    "trace_of_topics": trace_of_topics,
    "infer_applies_to": infer_applies_to,
    "ambiguous_terms": ambiguous_terms,
    "term_candidates": term_candidates,
    "related_counts": related_counts,
    "infer_related_to": infer_related_to,
    "related_members": related_members,
    "related_classes": related_classes,
    "related_exceptions": related_exceptions,
    "contains_depth_cut": contains_depth_cut,
    "resolve_links": resolve_links,
    "unresolved_links": unresolved_links,
    "dedup_ids": dedup_ids,
    "dedup_ids_planted": dedup_ids_planted,
    "contained": contained,
    "reused": reused,
    "graph_edge_lines": graph_edge_lines,
    "edges_into_targets": edges_into_targets,
    "xml_topics": xml_topics,
    "xml_maps": xml_maps,
    "generated_from": generated_from,
    "canonical_body": canonical_body,
    "text_chunks": text_chunks,
    "graph_view": graph_view,
    "tags": tags,
    "listed_relations": listed_relations,
    "sections": sections,
    "dangling": dangling,
    "redundant_links": redundant_links,
    "duplicate_ids": duplicate_ids,
    "secret_scan": secret_scan,
    "secret_scan_planted": secret_scan_planted,
    "suggest_id": suggest_id,
    "suggest_id_planted": suggest_id_planted,
    "explain": explain,
    "summary": summary,
    "index_changes": index_changes,
}

_CONTAINS = """e AS (SELECT DISTINCT from_id AS p, to_id AS c FROM graph_edges WHERE relation = 'contains'
            AND from_id IN (SELECT id FROM graph_nodes) AND to_id IN (SELECT id FROM graph_nodes)),
        roots AS (SELECT DISTINCT p AS id FROM e WHERE p NOT IN (SELECT c FROM e))"""

_REFS = """(SELECT DISTINCT * FROM (
        SELECT 'topics' AS ref_table, id AS from_id, l.relation AS relation, l.target_id AS target_id, built_at AS tm
          FROM (SELECT id, built_at, unnest(links) AS l FROM topics)
        UNION ALL SELECT 'maps', id, l.relation, l.target_id, built_at FROM (SELECT id, built_at, unnest(links) AS l FROM maps)
        UNION ALL SELECT 'graph_edges', from_id, relation, to_id, built_at FROM graph_edges)
        WHERE trim(target_id, ' ') <> '')"""
_SPANS = "(SELECT id, added_at, removed_at FROM graph_nodes UNION SELECT id, added_at, removed_at FROM library_topics)"

_PRODUCT_TOPICS = """(SELECT DISTINCT lower(trim(p, ' ')) AS product, id, built_at
        FROM (SELECT id, built_at, unnest(product) AS p FROM topics) WHERE trim(p, ' ') <> '')"""

ORACLE = {
    **_REFERENCE,
    "p5_found": f"""
        WITH RECURSIVE {_CONTAINS},
        w(root, node, d) AS (SELECT id, id, 0 FROM roots UNION SELECT w.root, e.c, w.d + 1 FROM w JOIN e ON e.p = w.node WHERE w.d < 60),
        r(a, b) AS (SELECT p, c FROM e UNION SELECT r.a, e.c FROM r JOIN e ON e.p = r.b),
        cyc AS (SELECT a FROM r WHERE a = b)
        SELECT node AS node_id, root AS root_id, min(d)::INT AS depth FROM w GROUP BY ALL
        UNION ALL SELECT x.a, min(x.b), -1 FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a IN (SELECT a FROM cyc) GROUP BY x.a""",
    "p5_paths": f"""
        WITH RECURSIVE {_CONTAINS},
        x(root, node, d) AS (SELECT id, id, 0 FROM roots UNION SELECT x.root, e.c, x.d + 1 FROM x JOIN e ON e.p = x.node WHERE x.d < 60),
        m AS (SELECT root, node, min(d) AS d FROM x GROUP BY ALL),
        w(root, node, d, path, rev) AS (SELECT id, id, 0, id, [id] FROM roots
            UNION ALL SELECT w.root, e.c, w.d + 1, w.path || ' > ' || e.c, list_prepend(e.c, w.rev)
            FROM w JOIN e ON e.p = w.node JOIN m ON m.root = w.root AND m.node = e.c AND m.d = w.d + 1)
        SELECT node AS node_id, root AS root_id, d::INT AS depth, path FROM w QUALIFY row_number() OVER (PARTITION BY root, node ORDER BY rev) = 1""",
    "p5_descendants": f"""
        WITH RECURSIVE {_CONTAINS},
        w(a, b, d) AS (SELECT p, c, 1 FROM e UNION SELECT w.a, e.c, w.d + 1 FROM w JOIN e ON e.p = w.b WHERE w.d < 60),
        m AS (SELECT a, b, min(d) AS d FROM w GROUP BY ALL)
        SELECT a AS node_id, count(*) AS n_descendants, max(d) AS height FROM m GROUP BY a""",
    "p5_descendant_rows": f"""
        WITH RECURSIVE {_CONTAINS},
        w(a, b, d) AS (SELECT p, c, 1 FROM e UNION SELECT w.a, e.c, w.d + 1 FROM w JOIN e ON e.p = w.b WHERE w.d < 60)
        SELECT a AS node_id, b AS descendant_id, min(d)::INT AS dist FROM w GROUP BY ALL""",
    "p2_found": f"""
        SELECT DISTINCT ref_table, from_id, relation, target_id, strftime(tm, '%Y-%m') AS period FROM {_REFS} r
        WHERE NOT EXISTS (SELECT 1 FROM {_SPANS} s WHERE s.id = split_part(r.target_id, '#', 1)
            AND s.added_at <= r.tm AND (s.removed_at IS NULL OR s.removed_at > r.tm))""",
    "p2_report": f"""
        WITH RECURSIVE r AS (SELECT *, split_part(target_id, '#', 1) AS base FROM {_REFS}),
        m AS (SELECT r.*, EXISTS (SELECT 1 FROM {_SPANS} s WHERE s.id = r.base
            AND s.added_at <= r.tm AND (s.removed_at IS NULL OR s.removed_at > r.tm)) AS sound FROM r),
        k AS (SELECT DISTINCT from_id, base FROM m WHERE sound),
        o(id, level) AS (SELECT DISTINCT from_id, 0 FROM m WHERE NOT sound
            UNION SELECT k.from_id, o.level + 1 FROM o JOIN k ON k.base = o.id WHERE o.level < 12),
        lv AS (SELECT id, min(level) AS level FROM o GROUP BY id),
        a AS (SELECT *, 'direct' AS kind, 0 AS level FROM m WHERE NOT sound
            UNION ALL SELECT m.*, 'inherited', lv.level + 1 FROM m JOIN lv ON lv.id = m.base WHERE sound)
        SELECT ref_table, strftime(tm, '%Y-%m') AS period, kind, count(*) AS n_references,
            count(DISTINCT target_id) AS n_targets, max(level) AS max_level FROM a GROUP BY ALL""",
    "p4_found": f"""
        SELECT product, id AS topic_id FROM {_PRODUCT_TOPICS}
        QUALIFY row_number() OVER (PARTITION BY product ORDER BY built_at DESC, id) <= 3""",
    "p4_summary": f"""
        SELECT product, count(DISTINCT id) AS n_items, min(built_at) AS first_at, max(built_at) AS last_at
        FROM {_PRODUCT_TOPICS} GROUP BY product""",
}

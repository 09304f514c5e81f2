"""From extracted records to nodes and edges: ids, link resolution, draft filter.

Raw links name files; nodes have ids. All resolution is equi-joins on the path. What does not
resolve becomes a row of diagnostics, never an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import drop_cut, write_cut


def _name(level: Column) -> Column:
    """The ids that a topic asks for, one after another: its own, then that with its path behind it,
    then numbers behind that."""
    long = F.concat("was", F.lit("--"), F.translate("path", "/", "-"))
    return F.when(level == 0, F.col("was")).when(level == 1, long).otherwise(F.concat(long, F.lit("-"), level))


def disambiguate(topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, diagnostics): ``topics`` has ``id, path, ord``; ``ord`` is unique and gives the order
    in which ids are claimed. The first to claim an id has it, a later one becomes ``id--path`` with
    hyphens for slashes, and ``-2``, ``-3``... behind that until the id is free. Other columns stay.
    Diagnostics 070W name both files.

    All claim at once: of those that ask for one id the first in order keeps it, as long as no earlier
    one comes to ask for it, and the others ask for their next. As one order decides everywhere, this
    ends where claiming one by one would. A round is a count with map-side combining; a second round
    is needed only where a made-up id is taken, too. A null id is an id like others; an empty table
    gives empty results.
    """
    spark = topics.sparkSession
    now = topics.select(F.col("id").alias("was"), "path", "ord", F.lit(0).alias("level"))
    old, schema = None, now.schema
    while True:
        asked = now.withColumn("name", _name(F.col("level")))
        first = asked.groupBy("name").agg(F.min("ord").alias("first"))
        late = F.col("ord") > F.col("first")
        asked = asked.alias("a").join(first.alias("f"), F.col("a.name").eqNullSafe(F.col("f.name"))).select("was", "path", "ord", F.when(late, F.col("level") + 1).otherwise(F.col("level")).alias("level"), late.alias("late"))
        seen = Observation()
        path = write_cut(asked.observe(seen, F.count_if("late").alias("n")).drop("late"))
        now = spark.read.schema(schema).parquet(path)
        if old:
            drop_cut(spark, old)
        if not (seen.get or {}).get("n"):
            break
        old = path
    final = now.withColumn("_new", _name(F.col("level")))
    # the holder of an id that others asked for may be one that was renamed to it
    holder = final.select(F.col("_new").alias("_was"), F.col("path").alias("_first"))
    moved = final.where("level > 0").join(holder, F.col("was").eqNullSafe(F.col("_was")))
    note = moved.select(
        F.lit("070W").alias("id"), F.lit("warning").alias("severity"),
        F.concat(F.lit("Duplicate id '"), "was", F.lit("' in "), "path", F.lit(" (first in "), "_first", F.lit("); renamed to '"), "_new", F.lit("'")).alias("message"),
        F.col("path").alias("subject"),
    )
    t = topics.join(final.select(F.col("ord").alias("_ord"), "_new"), F.col("ord") == F.col("_ord"))
    return t.select(*[F.col("_new").alias("id") if c == "id" else F.col(f"`{c}`") for c in topics.columns]), note


def without_drafts(topics: DataFrame, include_drafts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(topics, diagnostics): drafts go, with 020I each, unless they are wanted. Edges are made before
    this, so edges to a draft stay."""
    draft = F.coalesce(F.col("status") == "draft", F.lit(False)) & F.lit(not include_drafts)
    note = topics.where(draft).select(
        F.lit("020I").alias("id"), F.lit("info").alias("severity"), F.concat(F.lit("Draft left out: "), "path").alias("message"), F.col("path").alias("subject")
    )
    return topics.where(~draft), note


def _unresolved(rows: DataFrame, what: str) -> DataFrame:
    return rows.select(
        F.lit("010W").alias("id"), F.lit("warning").alias("severity"),
        F.concat(F.lit(f"Unresolved {what}: "), "target_path").alias("message"), F.col("src_path").alias("subject"),
    )


def resolve_containment(raw: DataFrame, ids: DataFrame, map_id: str) -> tuple[DataFrame, DataFrame]:
    """(edges, diagnostics) of ``raw`` (src_path, target_path, ord) and ``ids`` (path, id). A null
    src_path is the map. A topic listed twice gives two edges; a container that does not resolve is
    dropped in silence."""
    t = ids.select(F.col("path").alias("target_path"), F.col("id").alias("dst"))
    s = ids.select(F.col("path").alias("src_path"), F.col("id").alias("_src"))
    r = raw.join(t, "target_path", "left").join(s, "src_path", "left")
    src = F.when(F.col("src_path").isNull(), F.lit(map_id)).otherwise(F.col("_src"))
    good = r.where(F.col("dst").isNotNull()).select(src.alias("src"), "dst", F.lit("contains").alias("relation"), "ord").where("src is not null")
    return good, _unresolved(r.where(F.col("dst").isNull()), "topic reference")


def resolve_links(raw: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, diagnostics) of ``raw`` (src_path, target_path, relation, ord): self-links go in
    silence, of repeated (source, relation, target) the first stays."""
    t = ids.select(F.col("path").alias("target_path"), F.col("id").alias("dst"))
    s = ids.select(F.col("path").alias("src_path"), F.col("id").alias("src"))
    r = raw.join(t, "target_path", "left").join(s, "src_path")
    good = r.where("dst is not null and src <> dst").groupBy("src", "dst", "relation").agg(F.min("ord").alias("ord"))
    return good, _unresolved(r.where("dst is null"), "link")


def resolve_reuse(raw: DataFrame, ids: DataFrame) -> DataFrame:
    """generated-from edges of ``raw`` (src_path, target_path, ord); what does not resolve goes in silence."""
    t = ids.select(F.col("path").alias("target_path"), F.col("id").alias("dst"))
    s = ids.select(F.col("path").alias("src_path"), F.col("id").alias("src"))
    e = raw.join(t, "target_path").join(s, "src_path").where("src <> dst")
    return e.groupBy("src", "dst").agg(F.min("ord").alias("ord")).select("src", "dst", F.lit("generated-from").alias("relation"), "ord")

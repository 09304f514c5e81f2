"""Registered queries of the subpackage and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import langid, mix, neardup, pack, setjoin, split, tokens

ITEM_LIMIT, ITEM_OVERLAP = 2000, 150


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    t = split.divided(table(spark, d, "topics"), "id", "body", ITEM_LIMIT, ITEM_OVERLAP)
    c = split.divided(table(spark, d, "chunks"), "id", "text", ITEM_LIMIT, ITEM_OVERLAP)
    return t.select(F.lit("topics").alias("item_table"), F.col("id").alias("item_id")).unionByName(
        c.select(F.lit("chunks").alias("item_table"), F.col("id").alias("item_id"))
    )


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all topic bodies and chunk texts; a redelivered row is split once."""
    out = None
    for name, text in (("topics", "body"), ("chunks", "text")):
        items = table(spark, d, name).select("id", text).dropDuplicates(["id"])
        p = split.split_texts(items, "id", text, ITEM_LIMIT, ITEM_OVERLAP).withColumnRenamed("id", "item_id")
        p = p.select(F.lit(name).alias("item_table"), *p.columns)
        out = p if out is None else out.unionByName(p)
    return out


def p1_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every item put together again from its pieces without their overlaps, and whether all of them
    keep the limit and all but the first share characters with the one before."""
    own = F.substring("piece", F.col("cut_char") - F.col("start_char") + 1, F.lit(ITEM_LIMIT))
    p = p1_pieces(spark, d).select("item_table", "item_id", "piece_no", own.alias("own"), F.length("piece").alias("n"), (F.col("cut_char") - F.col("start_char")).alias("lap"))
    # the pieces of one item, which was one row before
    g = p.groupBy("item_table", "item_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "own"))).alias("p"), F.max("n").alias("n"), F.max("lap").alias("lap"))
    text = F.array_join(F.transform("p", lambda x: x["own"]), "")
    kept = (F.col("n") <= ITEM_LIMIT) & (F.col("lap") <= ITEM_OVERLAP)
    return g.select("item_table", "item_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"), kept.alias("kept"))


def _topic_text():
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))


def _topic_duplicates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Three words, 0.6 and 30 shingles are the values of the problem's statement."""
    return neardup.near_duplicates(table(spark, d, "topics"), "id", _topic_text(), width=3, threshold=0.6, least=30)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.member_pairs(*_topic_duplicates(spark, d))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Class, group and number of links of every topic with enough shingles."""
    return neardup.duplicate_groups(*_topic_duplicates(spark, d)).withColumnRenamed("id", "topic_id")


def _similar_records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = setjoin.value_set("product", "audience", "topic_keys").alias("v")
    r = table(spark, d, "topics").select("id", v).unionByName(table(spark, d, "library_topics").select("id", v))
    return setjoin.similar_sets(r, "id", "v", threshold=0.7, least=5)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.member_pairs(*_similar_records(spark, d))


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """Class and number of linked classes of every record with enough values."""
    return neardup.duplicate_groups(*_similar_records(spark, d)).withColumnRenamed("id", "record_id")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or piece of one, for each capacity of pack_specs."""
    counts = tokens.token_counts(table(spark, d, "documents"), "doc_id", "text")
    out = None
    for r in table(spark, d, "pack_specs").orderBy("spec_name").collect():
        p = pack.pack(counts, "doc_id", "n_tokens", r["capacity_tokens"])
        p = p.select(F.lit(r["spec_name"]).alias("spec_name"), *p.columns)
        out = p if out is None else out.unionByName(p)
    return out


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers and their fill for each capacity."""
    size = F.sum(F.col("tok_end") - F.col("tok_start"))
    c = p7_containers(spark, d).groupBy("spec_name", "container").agg(size.alias("used"), F.count(F.lit(1)).alias("n_items"))
    c = c.join(F.broadcast(table(spark, d, "pack_specs")), "spec_name")
    return c.groupBy("spec_name", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n_items").alias("n_pieces"), F.sum("used").alias("n_tokens"),
        F.max("used").alias("fullest"), (F.sum("used") / F.sum("capacity_tokens")).alias("fill"),
    )


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """For each capacity: documents that lie in containers whole or in gapless pieces, containers
    that hold too much, and documents divided without need."""
    p = p7_containers(spark, d).join(F.broadcast(table(spark, d, "pack_specs")), "spec_name").withColumn("n", F.col("tok_end") - F.col("tok_start"))
    docs = p.groupBy("spec_name", "capacity_tokens", "doc_id").agg(F.sum("n").alias("n"), F.max("tok_end").alias("end"), F.min("tok_start").alias("begin"), F.count(F.lit(1)).alias("c"))
    docs = docs.groupBy("spec_name").agg(F.count_if((F.col("n") == F.col("end")) & (F.col("begin") == 0)).alias("n_documents"), F.count_if((F.col("c") > 1) & (F.col("end") <= F.col("capacity_tokens"))).alias("n_needless"))
    full = p.groupBy("spec_name", "capacity_tokens", "container").agg(F.sum("n").alias("used"))
    full = full.groupBy("spec_name").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("n_overfull"))
    return docs.join(full, "spec_name")


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counts = tokens.token_counts(table(spark, d, "documents"), "doc_id", "text", "source")
    return mix.mix_sources(counts, table(spark, d, "mix_targets"))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """For each target: documents used too often, documents of another source, documents used twice
    over under one name."""
    s = p8_selection(spark, d).withColumnRenamed("source", "chosen")
    own = table(spark, d, "documents").select("doc_id", mix.source_name(F.col("source")).alias("own"))
    t = table(spark, d, "mix_targets").select(mix.source_name(F.col("source")).alias("source"), "max_repeats")
    s = s.join(own, "doc_id").join(F.broadcast(t), F.col("chosen") == F.col("source"), "right")
    return s.groupBy("source").agg(
        F.count_if(F.col("times") > F.col("max_repeats")).alias("n_too_often"), F.count_if(~F.col("own").eqNullSafe(F.col("source")) & F.col("doc_id").isNotNull()).alias("n_foreign"),
        (F.count("doc_id") - F.count_distinct("doc_id")).alias("n_twice"),
    )


def _stretches(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, str]]:
    names = langid.label_map(table(spark, d, "languages"))
    docs = table(spark, d, "documents")
    model = langid.fit_on_sample(docs, "doc_id", "text", langid.label_language(F.col("lang"), names), sorted(set(names.values())))
    return langid.identify(docs, "doc_id", "text", model), names


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    s, names = _stretches(spark, d)
    label = langid.label_language(F.col("lang"), names)
    labels = table(spark, d, "documents").select("doc_id", label.alias("label"))
    s = s.withColumnRenamed("lang", "true_lang").join(labels, "doc_id")
    case = (F.col("n_segs") > 1) | F.col("label").isNull() | (F.col("label") != F.col("true_lang"))
    return s.where(case).select("doc_id", "seg_no", "true_lang")


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every document with its place, language and confidence."""
    return _stretches(spark, d)[0]


def p9_cover(spark: SparkSession, d: str) -> DataFrame:
    """How far the stretches of each document reach, where they follow each other without a gap."""
    s = p9_segments(spark, d)
    whole = F.sum(F.col("end_char") - F.col("start_char")) == F.max("end_char")
    return s.groupBy("doc_id").agg(F.when(whole & (F.max("seg_no") == F.count(F.lit(1))), F.max("end_char")).cast("long").alias("n_chars"))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_rebuilt": p1_rebuilt,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p6_found": p6_found,
    "p6_links": p6_links,
    "p7_containers": p7_containers,
    "p7_report": p7_report,
    "p7_check": p7_check,
    "p8_selection": p8_selection,
    "p8_report": p8_report,
    "p8_check": p8_check,
    "p9_found": p9_found,
    "p9_segments": p9_segments,
    "p9_cover": p9_cover,
}

# The sets of problems 3 and 6 as rows (id, g) of those large enough, and the similar pairs of them.
_SHINGLES = r"""t AS (SELECT id, any_value(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '[a-z0-9]+')) AS w
            FROM topics GROUP BY id),
        s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
            FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id HAVING count(*) >= 30)"""
_VALUES = """r AS (SELECT id, unnest(product) AS x FROM topics UNION SELECT id, unnest(audience) FROM topics
            UNION SELECT id, unnest(topic_keys) FROM topics UNION SELECT id, unnest(product) FROM library_topics
            UNION SELECT id, unnest(audience) FROM library_topics UNION SELECT id, unnest(topic_keys) FROM library_topics),
        s AS (SELECT DISTINCT id, lower(trim(x, ' ')) AS g FROM r WHERE trim(x, ' ') <> ''),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id HAVING count(*) >= 5)"""


def _pairs(least: float) -> str:
    return f"""k AS (SELECT s.id, s.g, n.n FROM s JOIN n USING (id)),
        p AS (SELECT id_a, id_b FROM (SELECT a.id AS id_a, b.id AS id_b, a.n + b.n AS total, count(*) AS c
            FROM k a JOIN k b ON a.g = b.g AND a.id < b.id GROUP BY ALL) WHERE c >= {least} * (total - c))"""


# Classes of equal sets, links between them, and what the links join.
_GROUPS = """c AS (SELECT id, min(id) OVER (PARTITION BY v) AS class_id FROM (SELECT id, string_agg(g, chr(10) ORDER BY g) AS v FROM k GROUP BY id)),
        l AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM (SELECT id_a, id_b FROM p UNION ALL SELECT id_b, id_a FROM p)
            JOIN c x ON x.id = id_a JOIN c y ON y.id = id_b WHERE x.class_id <> y.class_id),
        w(a, b) AS (SELECT class_id, class_id FROM c UNION SELECT w.a, l.b FROM w JOIN l ON l.a = w.b),
        g AS (SELECT a, min(b) AS group_id FROM w GROUP BY a), m AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)"""

ORACLE = {
    "p6_found": f"WITH {_VALUES}, {_pairs(0.7)} SELECT id_a, id_b FROM p",
    "p3_found": f"WITH {_SHINGLES}, {_pairs(0.6)} SELECT id_a, id_b FROM p",
    "p3_groups": f"""WITH RECURSIVE {_SHINGLES}, {_pairs(0.6)}, {_GROUPS}
        SELECT id AS topic_id, class_id, group_id, coalesce(n_links, 0) AS n_links FROM c JOIN g ON g.a = class_id LEFT JOIN m ON m.a = class_id""",
    "p6_links": f"""WITH RECURSIVE {_VALUES}, {_pairs(0.7)}, {_GROUPS}
        SELECT id AS record_id, class_id, group_id, coalesce(n_links, 0) AS n_links FROM c JOIN g ON g.a = class_id LEFT JOIN m ON m.a = class_id""",
    "p1_found": """
        SELECT DISTINCT 'topics' AS item_table, id AS item_id FROM topics WHERE length(body) > 2000
        UNION ALL SELECT DISTINCT 'chunks', id FROM chunks WHERE length(text) > 2000""",
    "p1_rebuilt": """
        SELECT 'topics' AS item_table, id AS item_id, length(any_value(body))::INT AS n_chars, md5(any_value(body)) AS text_md5, true AS kept
            FROM topics WHERE body IS NOT NULL GROUP BY id
        UNION ALL SELECT 'chunks', id, length(any_value(text))::INT, md5(any_value(text)), true FROM chunks WHERE text IS NOT NULL GROUP BY id""",
    "p7_check": "SELECT spec_name, (SELECT count(*) FROM documents) AS n_documents, 0::BIGINT AS n_needless, 0::BIGINT AS n_overfull FROM pack_specs",
    "p8_check": "SELECT replace(lower(trim(source, ' ')), '_', '-') AS source, 0::BIGINT AS n_too_often, 0::BIGINT AS n_foreign, 0::BIGINT AS n_twice FROM mix_targets",
    "p9_cover": r"SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, '\p{L}')",
}

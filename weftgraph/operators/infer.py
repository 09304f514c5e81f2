"""Inferred relations: tasks that a reference applies to, and topics that share a product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUBSET_ITEMS = 8  # sets of at most so many values are counted by their subsets


def connected_pairs(edges: DataFrame) -> DataFrame:
    """(lo, hi): end points of all existing edges, without direction."""
    return edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()


def _terms(nodes: DataFrame, topic_type: str, column: str) -> DataFrame:
    t = nodes.where((F.col("kind") == "topic") & (F.col("topic_type") == topic_type))
    return t.select("id", F.explode(F.array_distinct(column)).alias("term")).where("term is not null")


def applies_to(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, ambiguous): ``(src, dst)`` from each task to the reference that alone uses one of the
    control names of its commands; ``(task_id, term, n_candidates, candidates)`` for names that several
    use, candidates being the first and the last of them; :func:`term_candidates` has all.

    A term that several references use yields nothing, even where one of them is linked already;
    pairs that are linked in either direction get no edge. Names match exactly, case included.
    """
    use = _terms(nodes, "reference", "uicontrols")
    owner = use.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("ref"), F.max("id").alias("last"))
    cmd = _terms(nodes, "task", "cmd_uicontrols")
    hit = cmd.join(owner, "term")
    pairs = hit.where("n = 1").select(F.col("id").alias("src"), F.col("ref").alias("dst")).distinct()
    pairs = pairs.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))
    new = pairs.join(connected_pairs(edges), ["lo", "hi"], "left_anti").select("src", "dst")
    named = F.concat("ref", F.when(F.col("n") > 2, ", ..., ").otherwise(", "), "last")
    return new, hit.where("n > 1").select(F.col("id").alias("task_id"), "term", F.col("n").alias("n_candidates"), named.alias("candidates"))


def term_candidates(nodes: DataFrame) -> DataFrame:
    """(term, ref_id): all references that use a control name which several use; one row each, as the
    candidates are the same for every task that names the term."""
    use = _terms(nodes, "reference", "uicontrols")
    many = use.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return use.join(many, "term", "left_semi").select("term", F.col("id").alias("ref_id"))


BLOCK = 2000  # topics of a product that one task compares with as many others


def products(nodes: DataFrame) -> DataFrame:
    """(id, ord, v, value): a row for each product of a topic; v has all of them."""
    t = nodes.where("kind = 'topic'").select("id", F.col("node_ord").alias("ord"), F.array_distinct(F.array_compact("product")).alias("v"))
    return t.select("id", "ord", "v", F.explode("v").alias("value"))


def related_to(nodes: DataFrame, edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(src, dst, src_ord, dst_ord) in both directions for topics that share a product and are not
    linked yet; ``ord`` is the place of a node.

    The result is quadratic in the topics of a product. ``of`` (column ``id``) restricts one end to
    a stated set, e.g. the topics of a query; without it all pairs are made, as is right for small
    bundles only: for large ones :func:`related_members`, :func:`related_classes` and
    :func:`related_exceptions` hold the relation in little space.

    The topics of a product are cut into blocks and every pair of blocks is a task's work, so that one
    product of all topics is spread over all tasks. A pair is made at the least product it shares, so
    none has to be taken out again.
    """
    p = products(nodes)
    blocks = p.groupBy("value").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("g"))
    p = p.join(blocks, "value").withColumn("own", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    q = p if of is None else p.join(of.select("id").distinct(), "id", "left_semi")
    every = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    a = q.select("value", F.col("own").alias("i"), every.alias("j"), F.col("id").alias("src"), F.col("ord").alias("src_ord"), F.col("v").alias("va"))
    b = p.select("value", every.alias("i"), F.col("own").alias("j"), F.col("id").alias("dst"), F.col("ord").alias("dst_ord"), F.col("v").alias("vb"))
    pairs = a.hint("merge").join(b, ["value", "i", "j"]).where("src <> dst")
    one = F.size("va") == 1
    pairs = pairs.where(one | (F.size("vb") == 1) | (F.array_min(F.array_intersect("va", "vb")) == F.col("value")))
    pairs = pairs.select("src", "dst", "src_ord", "dst_ord")
    if of is not None:
        pairs = pairs.union(pairs.select("dst", "src", "dst_ord", "src_ord")).distinct()
    pairs = pairs.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))
    return pairs.join(connected_pairs(edges), ["lo", "hi"], "left_anti").select("src", "dst", "src_ord", "dst_ord")


def _product_sets(nodes: DataFrame) -> DataFrame:
    """(id, v): topics that have a product, with their sets of them."""
    return nodes.where("kind = 'topic'").select("id", F.array_sort(F.array_distinct(F.array_compact("product"))).alias("v")).where("size(v) > 0")


def related_members(nodes: DataFrame) -> DataFrame:
    """(id, class): topics of equal product sets form a class, named by its least id."""
    t = _product_sets(nodes)
    return t.join(t.groupBy("v").agg(F.min("id").alias("class")), "v").select("id", "class")


def related_classes(nodes: DataFrame) -> DataFrame:
    """(a, b), a <= b: classes that share a product; (a, a) for those of several members.

    With :func:`related_members` and :func:`related_exceptions` this is the whole of :func:`related_to`:
    members of linked classes get edges in both directions, except the pairs that are linked already.
    """
    sets = _product_sets(nodes).groupBy("v").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n"))
    x = sets.select("class", "n", F.explode("v").alias("value"))
    pairs = x.select(F.col("class").alias("a"), "n", "value").join(x.select(F.col("class").alias("b"), "value"), "value")
    return pairs.where("a < b or a = b and n > 1").select("a", "b").distinct()


def related_exceptions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(lo, hi): the pairs that share a product, but are linked already."""
    t = _product_sets(nodes)
    x, y = (t.select(F.col("id").alias(i), F.col("v").alias(f"v{i}")) for i in ("lo", "hi"))
    linked = connected_pairs(edges).where("lo <> hi").join(x, "lo").join(y, "hi")
    return linked.where(F.arrays_overlap("vlo", "vhi")).select("lo", "hi")


def related_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_related): how many topics :func:`related_to` would link each topic with a product to.

    No pair is made. The topics that share a value with a set are counted by inclusion and exclusion
    over the set's subsets, whose supports come from one aggregation with map-side combining; sets
    of more than ``SUBSET_ITEMS`` values are compared one by one with the sets that share a value.
    """
    t = nodes.where("kind = 'topic'").select("id", F.array_sort(F.array_distinct(F.array_compact("product"))).alias("v")).where("size(v) > 0")
    sets = t.groupBy("v").agg(F.count(F.lit(1)).alias("n"))  # topics of equal sets count as one row from here
    small, big = sets.where(F.size("v") <= SUBSET_ITEMS), sets.where(F.size("v") > SUBSET_ITEMS)

    # all non-empty subsets, by the bits of 1 .. 2^size - 1
    subsets = F.expr("transform(sequence(1, shiftleft(1, size(v)) - 1), m -> filter(v, (x, i) -> shiftright(m, i) % 2 = 1))")
    parts = small.select("v", "n", F.explode(subsets).alias("s"))
    support = parts.groupBy("s").agg(F.sum("n").alias("m"))
    sign = F.when(F.size("s") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
    near = parts.join(support, "s").groupBy("v").agg(F.sum(sign * F.col("m")).alias("k"))
    # pairs with a big set on either side, by shared value
    a = sets.select("v", F.explode("v").alias("x"))
    b = big.select(F.col("v").alias("w"), F.col("n").alias("nw"), F.explode("v").alias("x"))
    mixed = a.join(b, "x").select("v", "w", "nw").distinct()
    with_big = mixed.groupBy("v").agg(F.sum("nw").alias("k"))
    c = big.select("v", F.explode("v").alias("x")).join(small.select(F.col("v").alias("w"), F.col("n").alias("nw"), F.explode("v").alias("x")), "x")
    of_big = c.select("v", "w", "nw").distinct().groupBy("v").agg(F.sum("nw").alias("k"))
    per_set = near.unionByName(with_big).unionByName(of_big).groupBy("v").agg(F.sum("k").alias("k"))
    shared = t.join(per_set, "v").select("id", (F.col("k") - 1).alias("k"))
    # linked pairs that share a value do not count
    pairs = connected_pairs(edges).where("lo <> hi")
    x, y = (t.select(F.col("id").alias(i), F.col("v").alias(f"v{i}")) for i in ("lo", "hi"))
    linked = pairs.join(x, "lo").join(y, "hi").where(F.arrays_overlap("vlo", "vhi"))
    minus = linked.select(F.col("lo").alias("id")).unionAll(linked.select("hi")).groupBy("id").agg(F.count(F.lit(1)).alias("l"))
    return shared.join(minus, "id", "left").select("id", (F.col("k") - F.coalesce("l", F.lit(0))).cast("long").alias("n_related"))

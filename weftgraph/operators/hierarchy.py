"""Parent-child rows to full hierarchies, by bottom-up leaf peeling.

Round by round the nodes all of whose children are done are peeled off. Only edges between nodes that
have children themselves take part; the others end in leaves, which are done from the start. The
first job takes one round, as it leaves much less to the next; later ones take up to ``STEPS`` thin
rounds. The rounds of a job form a *band*. Once no more than ``LOCAL`` edges are open, a bound on what
one task holds, a single task peels the rest. What cannot be peeled stands on cycles or above them:
the residue.

Descendants go up in the order of peeling, a node handing its list to its parents as rows, so that no
list has to fit into a task. Depths and paths go down in reverse order. Either way a node hands on
what it has once, when all that can reach it has. In the residue, which has no such order, both are
searched breadth first. The nodes on cycles are found there by colouring: the least id is handed down
to the fixpoint, and the nodes of a colour from which the colour's own node can be reached form one
strong component; a residue of at most ``LOCAL`` edges is coloured by one task.

Every job appends small tables in the shared folder; nothing is collected but counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..files import exists
from ..session import cut, cut_path, write_cut

STEPS = 8  # rounds or steps that one job takes at most
MERGE = 4  # steps after which rows that met are made one
LOCAL = 20_000  # edges that one task may hold


def _all(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _part(spark: SparkSession, tables: list[str], part: str, schema) -> DataFrame:
    """The rows of one partition of partitioned tables; a table without such rows has no folder for it."""
    return _all(spark, [p for p in (f"{t}/{part}" for t in tables) if exists(spark, p)], schema)


def _counted(df: DataFrame, *partition_by: str, **what: Column) -> tuple[str, dict[str, int]]:
    """Write ``df``; the aggregates ``what`` over it are observed on the way."""
    seen = Observation()
    path = write_cut(df.observe(seen, *[c.alias(k) for k, c in what.items()]), *partition_by)
    got = seen.get or {}
    return path, {k: got.get(k) or 0 for k in what}


@dataclass
class Order:
    """The order of peeling of a graph. ``steps``: rounds of each band, band 0 being the sinks.
    ``done``: a table of edges ``(p, c, rank, band)`` of the parents of each band from 1 on, rank and
    band being the child's. ``placed``: (node, rank, band). ``rest``: a table of the edges whose
    parent is residual, rank and band null where the child is, too."""

    steps: list[int]
    done: list[str]
    placed: DataFrame
    rest: str | None


EDGE = "p string, c string, rank int, band int"


def _in_one_task(df: DataFrame, schema: str, solve: Callable[[list, list, list], dict]) -> DataFrame:
    """Edges ``(p, c, rank)`` of a number that was checked, solved by one task: ``(node, value)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, c, r = [], [], []
        for b in batches:
            p += b["p"].tolist()
            c += b["c"].tolist()
            r += [None if x is None or x != x else int(x) for x in b["rank"].tolist()]
        found = solve(p, c, r)
        yield pd.DataFrame({"node": list(found), "value": pd.array(list(found.values()), dtype=object)})

    return df.select("p", "c", "rank").coalesce(1).mapInPandas(run, schema)


def _ranks(p: list, c: list, rank: list) -> dict:
    """The rank of each parent, None for residual ones."""
    open_, best, over = defaultdict(int), defaultdict(int), defaultdict(list)
    for a, b, r in zip(p, c, rank):
        if r is None:
            open_[a] += 1
            over[b].append(a)
        else:
            best[a] = max(best[a], r)
    out = dict.fromkeys(p)
    now = [a for a in out if not open_[a]]
    while now:
        a = now.pop()
        out[a] = best[a] + 1
        for up in over[a]:
            best[up] = max(best[up], out[a])
            open_[up] -= 1
            if not open_[up]:
                now.append(up)
    return out


def _strong(p: list, c: list, _: list) -> dict:
    """The least id of the strong component of each node on a cycle."""
    down = defaultdict(list)
    for a, b in zip(p, c):
        down[a].append(b)
    looped = {a for a, b in zip(p, c) if a == b}
    order, low, stack, on, out = {}, {}, [], set(), {}
    for start in list(down):
        todo = [] if start in order else [(start, iter(down[start]))]
        if todo:
            order[start] = low[start] = len(order)
            stack.append(start)
            on.add(start)
        while todo:
            a, rest = todo[-1]
            for b in rest:
                if b not in order:
                    order[b] = low[b] = len(order)
                    stack.append(b)
                    on.add(b)
                    todo.append((b, iter(down.get(b, ()))))
                    break
                if b in on:
                    low[a] = min(low[a], order[b])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[a])
                if low[a] == order[a]:
                    group = [stack.pop()]
                    while group[-1] != a:
                        group.append(stack.pop())
                    on.difference_update(group)
                    if len(group) > 1 or a in looped:
                        out.update(dict.fromkeys(group, min(group)))
    return out


def peel(edges: DataFrame, local: int = LOCAL) -> Order:
    """The order in which the graph of distinct edges ``(p, c)`` is peeled from its sinks."""
    spark = edges.sparkSession
    par = edges.select(F.col("p").alias("node")).distinct()
    # a child without children is a sink: rank 0 in band 0
    x = edges.join(par.select("node", F.lit(True).alias("is_par")), F.col("c") == F.col("node"), "left")
    zero = F.when(F.col("is_par").isNull(), F.lit(0))
    rest, n = _counted(x.select("p", "c", zero.alias("rank"), zero.alias("band")), rows=F.count(F.lit(1)))
    n_open = n["rows"]
    left = _all(spark, [rest], EDGE)
    steps, done = [1], []
    placed = [write_cut(left.where("band = 0").select(F.col("c").alias("node"), "rank", "band").distinct())] if n_open else []
    while n_open:
        band, lo = len(steps), sum(steps) - 1
        last = n_open <= local
        # the first rounds take most edges off, so jobs begin with few rounds and go on with more
        k = min(STEPS, 1 << band - 1)
        if last:
            state = _in_one_task(left, "node string, value int", _ranks).select(F.col("node").alias("p"), F.col("value").alias("rank"))
        else:
            state = None
            for _ in range(k):
                now = left.select("p", "c", "rank")
                if state is not None:
                    now = now.join(state.select(F.col("p").alias("c"), F.col("rank").alias("new")), "c", "left").withColumn("rank", F.coalesce("rank", "new"))
                full = F.count("rank") == F.count(F.lit(1))
                state = now.groupBy("p").agg(F.when(full, F.max("rank") + 1).cast("int").alias("rank"))
        in_band = F.lit(band) + (F.floor((F.col("rank") - lo - 1) / STEPS).cast("int") if last else F.lit(0))
        path, n = _counted(state.select(F.col("p").alias("node"), "rank", F.when(F.col("rank").isNotNull(), in_band).alias("band")), new=F.count("rank"), top=F.max("rank"))
        if not n["new"]:
            break
        new = [k]
        if last:
            rounds = n["top"] - lo
            new = [min(STEPS, rounds - i) for i in range(0, rounds, STEPS)]
        state = _all(spark, [path], "node string, rank int, band int")
        placed.append(path)
        kid = state.where("rank is not null").select(F.col("node").alias("c"), F.col("rank").alias("r"), F.col("band").alias("b"))
        own = state.select(F.col("node").alias("p"), F.coalesce("band", F.lit(-1)).alias("of"))
        nxt = left.join(kid, "c", "left").join(own, "p")
        nxt = nxt.select("p", "c", F.coalesce("rank", "r").alias("rank"), F.coalesce("band", "b").alias("band"), "of")
        path, n = _counted(nxt, "of", open=F.count_if(F.col("of") < 0))
        done += [f"{path}/of={band + i}" for i in range(len(new))]
        steps += new
        n_open, rest = n["open"], f"{path}/of=-1"
        left = _all(spark, [rest], EDGE) if n_open else None
        if last:
            break
    at = _all(spark, placed, "node string, rank int, band int").where("rank is not null")
    return Order(steps, done, at, rest if n_open else None)


@dataclass
class Hierarchy:
    """The hierarchy of distinct edges; see :func:`build_hierarchy`. What is not asked for is not made."""

    edges: DataFrame  # (p, c, inner): inner where the child has children
    roots_only: bool
    order: Order
    local: int

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @cached_property
    def roots(self) -> DataFrame:
        """(node): has a child and no parent."""
        inner = self.edges.where("inner").select(F.col("c").alias("node"))
        return cut(self.edges.select(F.col("p").alias("node")).distinct().join(inner, "node", "left_anti"))

    @cached_property
    def residual(self) -> DataFrame:
        """(p, c, rank, band): edges of residual parents to children that have children."""
        return _all(self.spark, [self.order.rest] if self.order.rest else [], EDGE)

    @cached_property
    def placed(self) -> DataFrame:
        """(node, rank, band) of the peeled parents. Nodes with leaves only have rank 0."""
        par = self.edges.groupBy(F.col("p").alias("node")).agg(F.max("inner").alias("inner"))
        only = par.where("not inner").select("node", F.lit(0).alias("rank"), F.lit(0).alias("band"))
        return self.order.placed.where("rank > 0").unionByName(only)

    @cached_property
    def cycles(self) -> DataFrame:
        """(node, component): the nodes on cycles; component is the least id of its members."""
        if not self.order.rest:
            return self.spark.createDataFrame([], "node string, component string")
        inner = self.residual.where("band is null")
        if inner.count() <= self.local:
            found = _in_one_task(inner, "node string, value string", _strong)
            return cut(found.select("node", F.col("value").alias("component")))
        return _components(inner.select("p", "c"))

    @cached_property
    def descendants(self) -> DataFrame:
        """(node, desc, dist, peel_round) for all nodes with a child; peel_round is -1 for residual ones."""
        return _descendants(self)


def build_hierarchy(edges: DataFrame, parent: str, child: str, roots_only: bool = False, local: int = LOCAL) -> Hierarchy:
    """Descendants, roots and cycles of the graph of distinct (parent, child) pairs.

    Pairs with a null end are left out, repeated pairs count once, a self-pair is a cycle of one
    node. A node with several parents is a descendant of each; distances are least numbers of steps.
    A root has a child and no parent; a node on a cycle is a descendant of itself. With ``roots_only``
    residual nodes that are no roots get no list. ``local``: edges that one task may hold; with 0 all is
    done in rounds, the result being the same. An empty input gives empty tables. Other columns are
    ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(f"`{parent}`").alias("p"), F.col(f"`{child}`").alias("c")).dropna().distinct()
    e = cut(e)
    par = e.select(F.col("p").alias("c")).distinct().withColumn("is_par", F.lit(True))
    split = write_cut(e.join(par, "c", "left").select("p", "c", F.col("is_par").isNotNull().alias("inner")), "inner")
    inner = _part(spark, [split], "inner=true", "p string, c string")
    leafy = _part(spark, [split], "inner=false", "p string, c string")
    both = inner.withColumn("inner", F.lit(True)).unionByName(leafy.withColumn("inner", F.lit(False)))
    return Hierarchy(both, roots_only, peel(inner, local), local)


# --- handing on in the order of peeling


def _least(df: DataFrame, paths: bool) -> DataFrame:
    """The least distance of each (tag, node); with ``paths`` also the least way among those as near."""
    if not paths:
        return df.groupBy("tag", "node").agg(F.min("dist").cast("int").alias("dist"))
    return df.groupBy("tag", "node").agg(F.min(F.struct("dist", "way")).alias("b")).select("tag", "node", F.col("b.dist").alias("dist"), F.col("b.way").alias("way"))


def _step(front: DataFrame, ways: DataFrame, paths: bool, *keep: str) -> DataFrame:
    """``front`` moved along ``ways`` (here, there, len, keep...); where it has no way it stays."""
    w = front.join(ways, front.node == ways.here, "left")
    moved = F.coalesce(F.col("len"), F.lit(0))
    out = [F.col("tag"), F.coalesce("there", "node").alias("node"), (F.col("dist") + moved).cast("int").alias("dist")]
    if paths:
        out.append(F.when(moved > 0, F.concat(F.array("there"), F.col("way"))).otherwise(F.col("way")).alias("way"))
    return w.select(*out, *keep)


def _entry_schema(paths: bool) -> str:
    return "tag string, node string, dist int" + (", way array<string>" if paths else "")


def _hand_on(spark: SparkSession, start: DataFrame, bands: list[tuple[int, int]], ways, paths: bool = False) -> DataFrame:
    """(tag, node, dist): what every node has in the end. ``start``: entries with the band of their node. ``bands``: (band, rounds in it) in
    the order they hand on; ``ways(band)``: the ways (here, there, band) from its nodes, band being
    that of ``there``."""
    schema = _entry_schema(paths)
    base = cut_path(spark)
    tables = [write_cut(start, "band", path=f"{base}/step=0")]
    for band, rounds in bands:
        here = _part(spark, tables, f"band={band}", schema)
        w = ways(band).withColumn("len", F.lit(1))
        if rounds > 1:  # first among the nodes of the band; the self-ways keep what has already arrived
            inside = w.where(F.col("band") == band).select("here", "there", "len")
            inside = inside.unionByName(inside.select("here", F.col("here").alias("there"), F.lit(0).alias("len")).distinct())
            for k in range(rounds - 1):
                here = _step(_least(here, paths) if k % MERGE == 0 else here, inside, paths)
        out = _least(here, paths).join(w, F.col("node") == F.col("here"))
        cols = [F.col("tag"), F.col("there").alias("node"), (F.col("dist") + 1).cast("int").alias("dist")]
        if paths:
            cols.append(F.concat(F.array("there"), F.col("way")).alias("way"))
        tables.append(write_cut(out.select(*cols, "band"), "band", path=f"{base}/step={len(tables)}"))
    every = spark.read.schema(schema + ", step int, band int").parquet(base)
    return _least(every, paths)


def _from_roots(h: Hierarchy, paths: bool) -> DataFrame:
    """(tag, node, dist): every root and all it reaches, in reverse order of peeling; with ``paths``
    the way back from the node to the root."""
    spark = h.spark
    begin = h.roots.select(F.col("node").alias("tag"), "node", F.lit(0).alias("dist"), *([F.array("node").alias("way")] if paths else []))
    entries, start = None, begin.join(h.placed.select("node", "band"), "node")
    if h.order.rest:
        inner, outer = h.residual.where("band is null"), h.residual.where("band is not null")
        entries = _walk(inner.select("p", "c"), begin.join(h.residual.select(F.col("p").alias("node")).distinct(), "node", "left_semi"), paths)
        down = outer.select(F.col("p").alias("here"), F.col("c").alias("there"), F.lit(1).alias("len"), "band")
        start = start.unionByName(_step(entries, down, paths, "band").where("band is not null"))
    cols = ["tag", "node", "dist"] + ["way"] * paths
    n = len(h.order.steps)
    bands = [(b, h.order.steps[b]) for b in range(n - 1, 0, -1)]
    got = _hand_on(spark, start.select(*cols, "band"), bands, lambda b: _all(spark, [h.order.done[b - 1]], EDGE).select(F.col("p").alias("here"), F.col("c").alias("there"), "band"), paths)
    if entries is not None:
        got = got.unionByName(entries)
    got = cut(got)
    leafy = h.edges.where("not inner").select(F.col("p").alias("here"), F.col("c").alias("there"), F.lit(1).alias("len"))
    last = got.join(leafy, F.col("node") == F.col("here"))
    last = last.select("tag", F.col("there").alias("node"), (F.col("dist") + 1).cast("int").alias("dist"), *([F.concat(F.array("there"), F.col("way")).alias("way")] if paths else []))
    return got.unionByName(_least(last, paths))


def node_depths(h: Hierarchy) -> DataFrame:
    """(node_id, root_id, depth) for every root and all it reaches, itself included."""
    return _from_roots(h, False).select(F.col("node").alias("node_id"), F.col("tag").alias("root_id"), F.col("dist").alias("depth"))


def node_paths(h: Hierarchy, sep: str = " > ") -> DataFrame:
    """(node_id, root_id, depth, path): the shortest path from each root, among equally short ones
    the one whose nodes, taken from the end, are least."""
    path = F.array_join(F.reverse("way"), sep)
    return _from_roots(h, True).select(F.col("node").alias("node_id"), F.col("tag").alias("root_id"), F.col("dist").alias("depth"), path.alias("path"))


def _descendants(h: Hierarchy) -> DataFrame:
    spark, order = h.spark, h.order
    placed = h.placed
    own = h.edges.select("p", "c").join(placed.select(F.col("node").alias("p"), "band"), "p")
    start = own.select(F.col("c").alias("tag"), F.col("p").alias("node"), F.lit(1).alias("dist"), "band")
    # edges by the band of the child, which hands its list up; band then is the parent's
    up = None
    for b, path in enumerate(order.done, 1):
        part = _all(spark, [path], EDGE).select(F.col("c").alias("here"), F.col("p").alias("there"), F.col("band").alias("from"), F.lit(b).alias("band"))
        up = part if up is None else up.unionByName(part)
    ups = [write_cut(up, "from")] if up is not None else []
    bands = [(b, order.steps[b]) for b in range(len(order.steps))] if ups else []
    lists = _hand_on(spark, start, bands, lambda b: _part(spark, ups, f"from={b}", "here string, there string, band int"))
    lists = lists.join(placed.select("node", (F.col("rank") + 1).alias("peel_round")), "node").select("node", F.col("tag").alias("desc"), "dist", "peel_round")
    if not order.rest:
        return lists
    lists = cut(lists)
    inner, outer = h.residual.where("band is null").select("p", "c"), h.residual.where("band is not null").select("p", "c")
    starts = h.residual.select(F.col("p").alias("node")).distinct()
    if h.roots_only:
        starts = starts.join(h.roots, "node", "left_semi")
    walked = _walk(inner, starts.select(F.col("node").alias("tag"), "node", F.lit(0).alias("dist")), False)
    # below a residual node: its leaves, its peeled children and their lists
    res = h.residual.select("p").distinct()
    leafy = h.edges.where("not inner").select("p", "c").join(res, "p", "left_semi")
    heard = outer.join(lists.select(F.col("node").alias("c"), "desc", (F.col("dist") + 1).alias("far")), "c").select("p", "desc", "far")
    heard = heard.unionByName(outer.union(leafy).select("p", F.col("c").alias("desc"), F.lit(1).alias("far")))
    below = walked.join(heard, walked.node == heard.p).select("tag", F.col("desc").alias("node"), (F.col("dist") + F.col("far")).alias("dist"))
    found = walked.where("dist > 0").unionByName(below)
    # the walk has its start at 0 only; on a cycle it comes back to it
    back = inner.select(F.col("p").alias("node"), F.col("c").alias("tag"))
    if not h.roots_only:
        found = found.unionByName(walked.join(back, ["tag", "node"]).select("tag", F.col("tag").alias("node"), (F.col("dist") + 1).alias("dist")))
    found = _least(found, False).select(F.col("tag").alias("node"), F.col("node").alias("desc"), "dist", F.lit(-1).alias("peel_round"))
    return lists.unionByName(found)


# --- the residue


def _stepping(edges: DataFrame) -> DataFrame:
    """Ways (here, there, len) with one of no length from each node to itself, so that a plan of
    several steps stays a chain of joins."""
    stay = edges.select("p").union(edges.select("c")).distinct().select("p", F.col("p").alias("c"), F.lit(0).alias("len"))
    e = edges.select("p", "c", F.lit(1).alias("len")).where("p <> c").unionByName(stay)
    return cut(e.select(F.col("p").alias("here"), F.col("c").alias("there"), "len"))


def _walk(edges: DataFrame, starts: DataFrame, paths: bool) -> DataFrame:
    """(tag, node, dist) for all nodes reached from each start, by least steps, itself included."""
    spark, schema = edges.sparkSession, _entry_schema(paths)
    cols = ["tag", "node", "dist"] + ["way"] * paths
    ways = _stepping(edges)
    tables, d = [write_cut(starts.select(*cols))], 0
    front, n = _all(spark, tables, schema), 1
    while n:
        d += STEPS
        for k in range(STEPS):
            front = _step(front, ways, paths)
            if k % MERGE == MERGE - 1:
                front = _least(front, paths)
        front = front.join(_all(spark, tables, schema).select("tag", "node"), ["tag", "node"], "left_anti")
        path, seen = _counted(front.select(*cols), n=F.count_if(F.col("dist") == d))
        n = seen["n"]
        tables.append(path)
        front = _all(spark, tables[-1:], schema).where(F.col("dist") == d)
    return _all(spark, tables, schema)


def _components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes on cycles of a graph from which no sink can be peeled."""
    spark, schema = edges.sparkSession, "node string, component string"
    out: list[str] = []
    left = _looped(edges, turn=True)
    while left is not None:
        ways = _stepping(left)
        color = ways.where("len = 0").select(F.col("here").alias("node"), F.col("here").alias("color"))
        mark, last = None, ()
        while mark != last:
            last = mark
            for k in range(STEPS):
                color = color.join(ways, color.node == ways.here).select(F.col("there").alias("node"), "color")
                if k % MERGE == MERGE - 1:
                    color = color.groupBy("node").agg(F.min("color").alias("color"))
            path, seen = _counted(color, mark=F.sum(F.xxhash64("node", "color").cast("decimal(38,0)")))
            mark, color = seen["mark"], _all(spark, [path], "node string, color string")
        a, b = color.select(F.col("node").alias("p"), F.col("color").alias("pc")), color.select(F.col("node").alias("c"), F.col("color").alias("cc"))
        same = cut(left.join(a, "p").join(b, "c").where("pc = cc").select("p", "c", F.col("pc").alias("color")))
        # backwards inside each colour, from the colour's own node
        own = same.where("p = color or c = color").select(F.col("color").alias("node")).distinct()
        back = _walk(same.select(F.col("c").alias("p"), F.col("p").alias("c")), own.select(F.col("node").alias("tag"), "node", F.lit(0).alias("dist")), False)
        comp = back.select("node", F.col("tag").alias("component"))
        # a colour alone in its component is on no cycle, unless it points at itself
        many = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("component"))
        on = comp.join(many, "component", "left_semi").select("node", "component")
        looped = same.where("p = c").select(F.col("p").alias("node"))
        alone = looped.join(comp.where("node = component").select("node"), "node", "left_semi").select("node", F.col("node").alias("component"))
        out.append(write_cut(on.union(alone).distinct()))
        gone = comp.select("node").union(color.where("node = color").select("node")).distinct()
        rest = same.join(gone.withColumnRenamed("node", "p"), "p", "left_anti").join(gone.withColumnRenamed("node", "c"), "c", "left_anti")
        left = _looped(rest.select("p", "c"), turn=False)
        left = None if left is None else _looped(left, turn=True)
    return _all(spark, out, schema)


def _looped(edges: DataFrame, turn: bool) -> DataFrame | None:
    """The edges (p, c) left when nodes without a way out, or with ``turn`` without a way in, are
    peeled off to the last; None where none is."""
    order = peel(edges.select(F.col("c").alias("p"), F.col("p").alias("c")) if turn else edges, 0)
    if not order.rest:
        return None
    rest = _all(edges.sparkSession, [order.rest], EDGE).where("band is null")
    return rest.select(F.col("c").alias("p"), F.col("p").alias("c")) if turn else rest.select("p", "c")

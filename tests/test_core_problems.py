"""Orphans, per-key results and hierarchies against brute force on small, dirty tables."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weftgraph.operators import hierarchy, orphans, perkey

DAY0 = datetime(2024, 1, 1)
REFS = "ref_table string, from_id string, relation string, target_id string, at timestamp, id string, removed_at timestamp"
SPANS = "id string, added_at timestamp, removed_at timestamp, at string"


def day(n):
    return None if n is None else DAY0 + timedelta(days=n)


def orphan_model(refs, spans):
    rows = {r for r in refs if r[3] is not None and r[3].strip(" ")}
    alive = lambda k, t: t is not None and any(s[0] == k and s[1] is not None and s[1] <= t and (s[2] is None or s[2] > t) for s in spans)
    direct = {r for r in rows if not alive(r[3].split("#")[0], r[4])}
    level = {r[1]: 0 for r in direct if r[1] is not None}
    n = 0
    while True:
        n += 1
        new = {r[1] for r in rows - direct if r[1] is not None and level.get(r[3].split("#")[0]) == n - 1 and r[1] not in level}
        if not new:
            break
        level.update({x: n for x in new})
    out = {(*r, "direct", 0) for r in direct}
    return out | {(*r, "inherited", level[r[3].split("#")[0]] + 1) for r in rows - direct if r[3].split("#")[0] in level}


def run_orphans(spark, refs, spans):
    r = spark.createDataFrame([(*x, "clash", None) for x in refs], REFS)
    s = spark.createDataFrame([(*x, "clash") for x in spans], SPANS)
    return {tuple(x) for x in orphans.orphan_references(r, s).collect()}


def test_orphans_random(spark):
    rng = random.Random(1)
    ids = [f"n{i}" for i in range(25)]
    spans = [(rng.choice(ids), day(rng.choice([None, 0, 3, 9])), day(rng.choice([None, 5, 20]))) for _ in range(40)]
    spans += spans[:5]
    refs = [
        (rng.choice("ab"), rng.choice([*ids, None]), "contains", rng.choice([*ids, None, "", "  ", "n1#x", "gone"]), day(rng.choice([None, 1, 4, 7, 15])))
        for _ in range(120)
    ]
    refs += refs[:10]
    assert run_orphans(spark, refs, spans) == orphan_model(refs, spans)


def test_orphans_hot_target_is_salted(spark, monkeypatch):
    hot = orphans.hot_keys
    monkeypatch.setattr(orphans, "hot_keys", lambda df, key, **_: hot(df, key, share=0.1, at_least=20))
    refs = [("t", f"f{i}", "requires", "hub" if i % 2 else f"f{(i + 7) % 90}", day(i % 30)) for i in range(90)]
    spans = [("hub", day(0), day(12)), ("hub", day(20), None), *[(f"f{i}", day(0), None) for i in range(90)]]
    assert run_orphans(spark, refs, spans) == orphan_model(refs, spans)


def test_orphans_empty(spark):
    assert run_orphans(spark, [], []) == set()
    only = [("t", "a", "requires", "b", day(1))]
    assert run_orphans(spark, only, []) == {(*only[0], "direct", 0)}
    assert orphans.orphan_report(orphans.orphan_references(spark.createDataFrame([], REFS), spark.createDataFrame([], SPANS))).count() == 0


def test_hot_keys_are_few(spark):
    d = spark.range(30_000).select(F.when(F.col("id") < 20_000, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    assert orphans.hot_keys(d, "k") == ["hot"]


def test_latest_per_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["p", "p", "p", "q", None, "r"]), f"i{rng.randrange(40):02}" if rng.random() > 0.05 else None, day(rng.choice([None, 1, 2, 3]))) for _ in range(400)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, item string, t timestamp, rank int").repartition(5)
    for max_keys in (50_000, 1):
        got = {(r["k"], r["rank"], r["item"]) for r in perkey.latest_per_key(df, "k", "item", "t", 3, max_keys).collect()}
        want = set()
        for k in {r[0] for r in rows} - {None}:
            best = {}
            for _, i, t in (r for r in rows if r[0] == k and r[1] is not None):
                best[i] = max(best.get(i, -1), -1 if t is None else (t - DAY0).days)
            want |= {(k, n + 1, i) for n, (i, _) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:3])}
        assert got == want
    assert perkey.latest_per_key(df.limit(0), "k", "item", "t").count() == 0


def test_normal_values(spark):
    df = spark.createDataFrame([("a", [" X ", "x", "", None, "  "]), ("b", None), ("c", [])], "id string, v array<string>")
    assert [tuple(r) for r in perkey.exploded_values(df, "v", "id").collect()] == [("x", "a")]


def test_summary_counts_an_item_once(spark):
    df = spark.createDataFrame([("k", "i", day(1)), ("k", "i", day(1)), ("k", "j", day(4)), (None, "z", day(1))], "k string, i string, t timestamp")
    assert [tuple(r) for r in perkey.summary_per_key(df, "k", "i", "t").collect()] == [("k", 2, day(1), day(4))]


def reach(edges):
    nodes = {x for e in edges for x in e}
    out = {}
    for s in nodes:
        dist, front = {}, [s]
        d = 0
        while front:
            d += 1
            front = [c for p, c in edges if p in front and c not in dist and not dist.update({c: d})]
        out[s] = dist
    return out


def run_hierarchy(spark, pairs, local=hierarchy.LOCAL):
    h = hierarchy.build_hierarchy(spark.createDataFrame([(*p, "x") for p in pairs], "p string, c string, node string"), "p", "c", local=local)
    depths = {tuple(r) for r in hierarchy.node_depths(h).collect()}
    cycles = {tuple(r) for r in h.cycles.collect()}
    return h, depths, cycles


def check_hierarchy(spark, pairs, local=hierarchy.LOCAL):
    edges = {p for p in pairs if None not in p}
    r = reach(edges)
    roots = {p for p, _ in edges} - {c for _, c in edges}
    want = {(n, root, d) for root in roots for n, d in r[root].items()} | {(x, x, 0) for x in roots}
    cyc = {(x, min(y for y in r[x] if x in r[y])) for x in r if x in r[x]}
    h, depths, cycles = run_hierarchy(spark, pairs, local)
    assert depths == want
    assert cycles == cyc
    return h, r


def test_descendants_of_residual_nodes(spark):
    pairs = [("r", "a"), ("a", "b"), ("b", "c"), ("c", "b"), ("c", "x"), ("x", "y"), ("o", "o"), ("k", "l"), ("l", "k")]
    h, r = check_hierarchy(spark, pairs)
    got = [(x["node"], x["desc"], x["dist"]) for x in h.descendants.collect()]
    assert sorted(got) == sorted((n, d, k) for n in r for d, k in r[n].items())
    few = hierarchy.build_hierarchy(spark.createDataFrame(pairs, "p string, c string"), "p", "c", roots_only=True)
    assert {x["node"] for x in few.descendants.where("peel_round < 0").collect()} == {"r"}


def test_hierarchy_random(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}") for _ in range(38)]
    for local in (0, hierarchy.LOCAL):
        check_hierarchy(spark, [*pairs, *pairs[:4], (None, "n01"), ("n02", None)], local)


def test_child_under_many_parents(spark):
    pairs = [("top", f"p{i}") for i in range(10_000)] + [(f"p{i}", "shared") for i in range(10_000)] + [("shared", "leaf"), ("shared", "end")]
    h = hierarchy.build_hierarchy(spark.createDataFrame(pairs, "p string, c string"), "p", "c")
    got = {r["node_id"]: (r["root_id"], r["depth"]) for r in hierarchy.node_depths(h).collect()}
    assert len(got) == 10_004 and got["shared"] == ("top", 2) and got["leaf"] == ("top", 3) and got["p7"] == ("top", 1)
    assert h.descendants.where("node = 'top'").count() == 10_003 and h.cycles.isEmpty()


def test_one_task_gives_what_rounds_give():
    rng = random.Random(11)
    for n in (4, 9, 20, 40):
        p, c = zip(*[(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(n + 6)])
        r = reach(set(zip(p, c)))
        assert hierarchy._strong(list(p), list(c), []) == {x: min(y for y in r[x] if x in r[y]) for x in r if x in r[x]}
        ranks = hierarchy._ranks(list(p), list(c), [None if x in p else 0 for x in c])
        bad = {x for x in r if x in r[x] or any(y in r[y] for y in r[x])}
        assert {x for x in ranks if ranks[x] is None} == bad & set(p)
        for x in set(p) - bad:
            assert ranks[x] == 1 + max((ranks.get(y) or 0) for y in {b for a, b in zip(p, c) if a == x})


def test_hierarchy_tree_chain_and_cycles(spark):
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(9)]
    pairs = [*chain, ("r", "c00"), ("r", "a"), ("a", "b"), ("b", "d"), ("r", "d"), ("u", "v"), ("v", "w"), ("w", "v"), ("w", "z"), ("z", "y"), ("s", "s"), ("z", "q"), ("q", "z2"), ("z2", "q")]
    h, r = check_hierarchy(spark, pairs)
    peeled = {(x["node"], x["desc"], x["dist"]) for x in h.descendants.where("peel_round > 0").collect()}
    for n in ("a", "b", "c03", "r"):
        assert {(d, k) for m, d, k in peeled if m == n} == set(r[n].items())
    paths = {(x["root_id"], x["node_id"]): x["path"] for x in hierarchy.node_paths(h).collect()}
    assert paths["r", "d"] == "r > d" and paths["r", "b"] == "r > a > b" and paths["u", "y"] == "u > v > w > z > y"


def test_hierarchy_empty(spark):
    _, depths, cycles = run_hierarchy(spark, [])
    assert depths == set() and cycles == set()

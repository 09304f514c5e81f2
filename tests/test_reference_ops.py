"""Inference, search, lookup and validation on small graphs."""

import random

import pytest

from weftgraph.operators import check, infer, lookup, search, traverse
from weftgraph.operators.resolve import disambiguate, resolve_containment, resolve_links
from weftgraph.plans import queries
from weftgraph.schema import EDGES, NODES, display_type
from pyspark.sql import functions as F


def node(i, kind="topic", topic_type="topic", product=(), uic=(), cmd=(), title=None, short=None, body=None, audience=(), keys=()):
    return (kind, i, topic_type if kind == "topic" else None, None, title or i, short, body, list(audience), list(product), list(keys), list(uic), list(cmd), f"{i}.dita", 0)


def nodes(spark, *rows):
    n = spark.createDataFrame([(*r[:13], i) for i, r in enumerate(rows)], NODES)
    return n.withColumn("okf_type", display_type(F.col("kind"), F.col("topic_type")))


def edges(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], EDGES)


def pairs(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


@pytest.mark.parametrize(
    "topics, links, n",
    [
        ([("a", ["ent"]), ("b", ["ent"])], [], 2),
        ([("a", ["ent"]), ("b", ["com"])], [], 0),
        ([("a", []), ("b", [])], [], 0),
        ([("a", ["ent"]), ("b", ["ent"])], [("a", "b", "requires")], 0),
        ([("a", ["ent"]), ("b", ["ent"])], [("b", "a", "references")], 0),
        ([("a", ["ent", "com"]), ("b", ["com", "cloud"])], [], 2),
        ([("a", ["ent"]), ("b", ["ent"]), ("c", ["ent"])], [], 6),
        ([(f"e{i}", ["ent"]) for i in range(5)] + [(f"c{i}", ["com"]) for i in range(5)] + [("x", ["cloud"])], [], 40),
        ([("a", [""]), ("b", [""])], [], 2),
        ([("a", ["x", "x"]), ("b", ["x"])], [], 2),
    ],
)
def test_related_to(spark, topics, links, n):
    ns, es = nodes(spark, *[node(i, product=p) for i, p in topics], node("m", kind="map")), edges(spark, *links)
    got = pairs(infer.related_to(ns, es))
    assert len(got) == n and {(b, a) for a, b in got} == got
    counts = {r["id"]: r["n_related"] for r in infer.related_counts(ns, es).collect()}
    assert counts == {i: sum(1 for a, _ in got if a == i) for i, p in topics if p}
    assert pairs(infer.related_to(ns, es, spark.createDataFrame([("a",)], "id string"))) == {p for p in got if "a" in p}


def test_a_product_of_all_topics_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(infer, "BLOCK", 4)
    rng = random.Random(3)
    sets = {f"t{i:02}": ["all", *rng.sample("pqrs", rng.randrange(0, 4))] for i in range(30)}
    ns, es = nodes(spark, *[node(i, product=p) for i, p in sets.items()]), edges(spark, ("t01", "t02", "requires"))
    rows = infer.related_to(ns, es).collect()
    assert len(rows) == 30 * 29 - 2 == len({(r["src"], r["dst"]) for r in rows})
    assert all((r["src_ord"], r["dst_ord"]) == (int(r["src"][1:]), int(r["dst"][1:])) for r in rows)


def test_walks_of_their_own(spark):
    rng = random.Random(7)
    es = edges(spark, *[(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", "requires") for _ in range(25)])
    starts = [f"n{i}" for i in range(6)] + ["nowhere", "n0"]
    each = traverse.walk(es, spark.createDataFrame([(x,) for x in starts] + [(None,)], "id string"), 3, each=True).collect()
    for x in set(starts):
        alone = {tuple(r) for r in ((r["level"], r["id"], r["via"], tuple(r["path"])) for r in traverse.walk(es, x, 3).collect())}
        assert {(r["level"], r["id"], r["via"], tuple(r["path"])) for r in each if r["start"] == x} == alone


def test_related_counts_with_large_sets(spark):
    rng = random.Random(4)
    ns = nodes(spark, *[node(f"t{i}", product=rng.sample([f"p{k}" for k in range(14)], rng.randrange(0, 13))) for i in range(40)])
    es = edges(spark, ("t1", "t2", "requires"), ("t3", "t9", "contains"), ("t4", "nowhere", "requires"))
    want = {}
    for a, _ in pairs(infer.related_to(ns, es)):
        want[a] = want.get(a, 0) + 1
    got = {r["id"]: r["n_related"] for r in infer.related_counts(ns, es).collect()}
    assert {k: v for k, v in got.items() if v} == want


def test_related_classes_hold_the_whole_relation(spark):
    rng = random.Random(6)
    ns = nodes(spark, *[node(f"t{i:02}", product=rng.choices("abcdefg", k=rng.randrange(0, 4))) for i in range(30)], node("m", kind="map", product=["a"]))
    es = edges(spark, *[(f"t{rng.randrange(30):02}", f"t{rng.randrange(30):02}", "requires") for _ in range(40)], ("m", "t01", "contains"))
    members = {}
    for r in infer.related_members(ns).collect():
        members.setdefault(r["class"], []).append(r["id"])
    links = [tuple(r) for r in infer.related_classes(ns).collect()]
    out = {tuple(r) for r in infer.related_exceptions(ns, es).collect()}
    got = {(x, y) for a, b in links for x in members[a] for y in members[b] if x != y and (min(x, y), max(x, y)) not in out}
    assert len(links) == len(set(links)) and any(len(m) > 1 for m in members.values()) and out
    assert got | {(y, x) for x, y in got} == pairs(infer.related_to(ns, es))


@pytest.mark.parametrize(
    "cmd, refs, links, want, warned",
    [
        (["Save"], {"r": ["Save"]}, [], {("t", "r")}, 0),
        (["Save"], {"r": ["Cancel"]}, [], set(), 0),
        (["Cancel"], {"r1": ["Cancel"], "r2": ["Cancel"]}, [], set(), 1),
        (["Save", "Cancel"], {"r1": ["Save", "Cancel"], "r2": ["Cancel"]}, [], {("t", "r1")}, 1),
        (["Save", "Discard"], {"r": ["Save", "Discard"]}, [], {("t", "r")}, 0),
        ([], {"r": ["Save"]}, [], set(), 0),
        (["Save"], {"r": ["save"]}, [], set(), 0),
        (["Save"], {"r": ["Save"]}, [("t", "r", "references")], set(), 0),
        (["Cancel"], {"r1": ["Cancel"], "r2": ["Cancel"]}, [("t", "r1", "references")], set(), 1),
    ],
)
def test_applies_to(spark, cmd, refs, links, want, warned):
    ns = nodes(spark, node("t", topic_type="task", cmd=cmd, uic=["Save"]), node("c", topic_type="concept", uic=["Save"]), *[node(i, topic_type="reference", uic=u) for i, u in refs.items()])
    new, many = infer.applies_to(ns, edges(spark, *links))
    assert pairs(new) == want
    rows = many.collect()
    assert len(rows) == warned and all(r["candidates"] == ", ".join(sorted(refs)) and r["n_candidates"] == 2 for r in rows)
    assert {r["ref_id"] for r in infer.term_candidates(ns).collect()} == {i for i in refs if len(refs) > 1}


def bfs(es, start, depth, relation=None, reverse=False):
    seen, front, out = {start}, [start], []
    for level in range(1, depth + 1):
        nxt = []
        for x in front:
            for s, d, r in es:
                a, b = (d, s) if reverse else (s, d)
                if a == x and (relation in (None, r)) and b not in seen:
                    seen.add(b)
                    nxt.append(b)
                    out.append((level, b, x, r))
        front = nxt
    return out


@pytest.mark.parametrize("seed", range(3))
def test_walk_is_the_sequential_walk(spark, seed):
    rng = random.Random(seed)
    es = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice(["requires", "contains"])) for _ in range(30)]
    e = edges(spark, *es)
    for rel, rev in ((None, True), ("requires", False)):
        w = traverse.walk(e, "n0", 4, rel, rev).where("level > 0").orderBy("level", "path").collect()
        assert [(r["level"], r["id"], r["via"], r["relation"]) for r in w] == bfs(es, "n0", 4, rel, rev)
    assert [r["id"] for r in traverse.forward_reachable(e, "unknown", 3).collect()] == ["unknown"]
    assert traverse.walk(e, "n0", 0).count() == 1
    every = {r["id"] for r in traverse.walk(e, "n0", None).collect()}
    assert every == {"n0"} | {x[1] for x in bfs(es, "n0", 30)}


def test_registered_impact_goes_to_the_default_depth(spark, tmp_path):
    rng = random.Random(8)
    es = [*((f"n{i + 1}", f"n{i}", "requires") for i in range(7)), *((f"m{rng.randrange(9)}", f"n{rng.randrange(8)}", "contains") for _ in range(8))]
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(es)], "edge_id long, from_id string, to_id string, relation string")
    e.write.parquet(f"{tmp_path}/graph_edges.parquet")
    c = "id string, title string, text string, topic_type string, audience array<string>, product array<string>"
    spark.createDataFrame([], c).write.parquet(f"{tmp_path}/chunks.parquet")
    got = {(r["level"], r["id"], r["relation"], r["via"]) for r in queries.analyze_impact(spark, str(tmp_path)).collect()}
    assert got == {(n, i, r, via) for n, i, via, r in bfs(es, "n0", 5, None, True)}
    assert max(x[0] for x in got) == 5


def test_scores_and_excerpts(spark):
    rows = [("a", "Install", ""), ("b", "x", "install and install"), ("c", "x", "nothing"), ("d", "İ", "café x"), ("e", None, None)]
    c = spark.createDataFrame(rows, "id string, title string, text string")
    got = {r["id"]: r["score"] for r in search.search_content(c, "install").collect()}
    assert got == {"a": 5, "b": 2}
    assert {r["id"]: r["score"] for r in search.search_content(c, "install install").collect()} == {"a": 10, "b": 4}
    assert search.terms("a B") == ["a", "b"]
    with pytest.raises(ValueError):
        search.terms("   ")
    cut = lambda s, n: spark.createDataFrame([(s,)], "s string").select(search.excerpt(F.col("s"), n)).first()[0]
    assert cut("a" * 200, 140) == "a" * 140 + "…"
    assert cut("line one\nline two", 140) == "line one line two"
    assert cut("é" * 150, 140) == "é" * 140 + "…"


def test_top_fifteen(spark):
    c = spark.createDataFrame([(f"t{i:02}", "w", "widgets") for i in range(20)] * 2, "id string, title string, text string")
    rows = search.search_content(c, "widgets").orderBy("rank").collect()
    assert [r["id"] for r in rows] == [f"t{i:02}" for i in range(15)] and rows[0]["n_matches"] == 20
    assert search.search_content(c.limit(0), "x").count() == 0


def test_suggestions(spark):
    ns = nodes(spark, node("ID--topics-x.dita"), node("first--shared-tail"), node("second--shared-tail"), node("a--b--c"))
    asked = spark.createDataFrame([("topics-x.dita",), ("other",), ("shared-tail",), ("b--c",), ("a--b--c",)], "id string")
    assert {tuple(r) for r in lookup.suggest_ids(ns, asked).collect()} == {("topics-x.dita", "ID--topics-x.dita"), ("b--c", "a--b--c")}


def test_validation(spark):
    ns = nodes(spark, node("a"), node("b"), node("b"), node("m", kind="map"))
    es = edges(spark, ("a", "b", "requires"), ("a", "b", "references"), ("a", "gone", "requires"), ("b", "a", "requires"))
    f = {(r["severity"], r["rule"], r["subject"]) for r in check.findings(ns, es).collect()}
    assert f == {("error", "duplicate-id", "b"), ("error", "dangling-link", "a -> gone"), ("warning", "redundant-link", "a -> b")}


def test_secrets(spark):
    planted = ["AK" + "IA" + "ABCDEFGHIJKLMNOP", "-----BEGIN " + "RSA PRIVATE KEY-----", "gh" + "p_" + "a" * 36, "xo" + "xb-" + "1234567890ab"]
    rows = [(f"f{i}", f"text {s} text") for i, s in enumerate(planted)] + [("clean", "How to reset your password"), ("null", None)]
    got = {tuple(r) for r in check.secret_scan(spark.createDataFrame(rows, "file string, content string"), "file", "content").collect()}
    assert got == {("f0", "aws-access-key-id"), ("f1", "pem-private-key"), ("f2", "github-token"), ("f3", "slack-token")}


def test_disambiguation(spark):
    t = spark.createDataFrame([("ID", "a.dita", 0), ("ID", "topics/second.dita", 1), ("ID--topics-second.dita", "z.dita", 2)], "id string, path string, ord long")
    got, notes = disambiguate(t)
    # the second topic claims its new id before the third comes, whose own id that is
    assert {r["path"]: r["id"] for r in got.collect()} == {"a.dita": "ID", "topics/second.dita": "ID--topics-second.dita", "z.dita": "ID--topics-second.dita--z.dita"}
    notes = {r["subject"]: r["message"] for r in notes.collect()}
    assert set(notes) == {"topics/second.dita", "z.dita"} and "first in a.dita" in notes["topics/second.dita"] and "first in topics/second.dita" in notes["z.dita"]


def one_by_one(rows):
    """Ids as they are claimed in order."""
    owner, out = {}, {}
    for i, path, ord_ in sorted(rows, key=lambda r: r[2]):
        new, n = i, 1
        while new in owner:
            new = f"{i}--{path.replace('/', '-')}" + (f"-{n}" if n > 1 else "")
            n += 1
        owner[new] = path
        out[path] = new
    return out


def test_disambiguation_is_that_of_claiming_one_by_one(spark):
    cases = [
        [("x", "q", 0), ("x", "a/b", 1), ("x--a-b", "c", 2), ("x--a-b-2", "d", 3)],
        [("x--a-b", "c", 0), ("x--a-b-2", "d", 1), ("x", "q", 2), ("x", "a/b", 3), ("x", "a-b", 4)],
        [("x", f"f{i}/index", i) for i in range(40)],
        [(f"x--{'a-' * (i % 3)}b" if i % 2 else "x", f"{'a/' * (i % 4)}b{i % 5}", i) for i in range(25)],
    ]
    for rows in cases:
        rows = list({r[1]: r for r in rows}.values())
        got, notes = disambiguate(spark.createDataFrame([(*r, "kept") for r in rows], "id string, path string, ord long, level string").repartition(3))
        want = one_by_one(rows)
        assert {r["path"]: r["id"] for r in got.collect()} == want and got.columns == ["id", "path", "ord", "level"]
        assert notes.count() == sum(want[p] != i for i, p, _ in rows)
    assert disambiguate(spark.createDataFrame([], "id string, path string, ord long"))[0].count() == 0


def test_resolution_keeps_repeated_containment_only(spark):
    ids = spark.createDataFrame([("a.dita", "a"), ("b.dita", "b")], "path string, id string")
    raw = spark.createDataFrame([(None, "a.dita", 0), (None, "a.dita", 1), ("a.dita", "b.dita", 2), ("zz.dita", "b.dita", 3), (None, "no.dita", 4)], "src_path string, target_path string, ord int")
    e, notes = resolve_containment(raw, ids, "map")
    assert sorted((r["src"], r["dst"]) for r in e.collect()) == [("a", "b"), ("map", "a"), ("map", "a")]
    assert [r["id"] for r in notes.collect()] == ["010W"]
    raw = spark.createDataFrame([("a.dita", "b.dita", "requires", 0), ("a.dita", "b.dita", "requires", 1), ("a.dita", "b.dita", "references", 2), ("a.dita", "a.dita", "references", 3), ("a.dita", "no", "references", 4)], "src_path string, target_path string, relation string, ord int")
    e, notes = resolve_links(raw, ids)
    assert sorted((r["relation"], r["ord"]) for r in e.collect()) == [("references", 2), ("requires", 0)]
    assert notes.count() == 1


def test_sections_in_first_seen_order(spark):
    ns = nodes(spark, node("a"), node("b", title="B"))
    es = edges(spark, ("a", "b", "requires"), ("a", "x", "contains"), ("a", "b", "requires"))
    got = [(r["section"], r["relation"], r["dst"], r["title"]) for r in lookup.sections(ns, es).orderBy("section", "edge_ord").collect()]
    assert got == [(1, "requires", "b", "B"), (1, "requires", "b", "B"), (2, "contains", "x", "x")]
    assert [(r["relation"], r["target"]) for r in lookup.listed_relations(es).orderBy("edge_ord").collect()] == [("requires", "b"), ("contains", "x"), ("requires", "b")]

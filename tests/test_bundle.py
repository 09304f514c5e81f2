"""XML extraction, model files, publishing, and the query server."""

import io
import json
import os

import pytest

from pyspark.sql import functions as F

from weftgraph import serve as server
from weftgraph import session
from weftgraph.__main__ import main
from weftgraph.sinks import bundle as sink
from weftgraph.sinks.bundle import file_name, file_name_of, publish, scalar
from weftgraph.sources import job, model, xml_parse


def write_job(root, files, manifest=".job.xml"):
    """files: path -> (format, xml); the first map is the input."""
    rows, first = [], True
    for path, (fmt, xml) in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(xml, encoding="utf-8")
        extra = ' input="true"' if fmt == "ditamap" and first else ""
        first = first and fmt != "ditamap"
        rows.append(f'<file src="file:/src/{path}" path="{path}" format="{fmt}"{extra}/>')
    (root / manifest).write_text(f"<job><files>{''.join(rows)}</files></job>", encoding="utf-8")
    return str(root)


MAP = '<map id="user-guide"><title>User Guide</title>{}</map>'


def run(spark, root, **kw):
    n, e, d = job.extract(spark, root, **kw)
    nodes = {r["id"]: r for r in n.collect()}
    es = [(r["src"], r["relation"], r["dst"]) for r in e.orderBy("edge_ord").collect()]
    return nodes, es, [(r["id"], r["message"]) for r in d.collect()]


def topic(i, body="", kind="topic", tag="body", attrs="", head=""):
    return f'<!DOCTYPE {kind} SYSTEM "nowhere.dtd"><{kind} id="{i}" {attrs}><title> T {i} </title>{head}<{tag}>{body}</{tag}></{kind}>'


def test_nesting_depth_and_transparent_containers(spark, tmp_path):
    refs = (
        '<topichead><topicref href="t/grouped.dita"/></topichead><topicref href="t/chapter.dita" keys=" k1 k2 "><topicref href="t/section.dita"/></topicref>'
        '<topicref href="https://x.org" scope="external"><topicref href="t/another.dita"/></topicref><mapref href="m.ditamap"><topicref href="t/no.dita"/></mapref>'
        '<navref mapref="nav.ditamap"/><topicref href="t/lost.dita"/>'
    )
    files = {"g.ditamap": ("ditamap", MAP.format(refs))}
    for t in ("grouped", "chapter", "section", "another"):
        files[f"t/{t}.dita"] = ("dita", topic(t))
    root = write_job(tmp_path, files)
    nodes, es, notes = run(spark, root)
    assert es == [("user-guide", "contains", "grouped"), ("user-guide", "contains", "chapter"), ("user-guide", "contains", "another"), ("chapter", "contains", "section")]
    assert len(nodes) == 5 and nodes["chapter"]["keys"] == ["k1", "k2"] and nodes["chapter"]["title"] == "T chapter"
    assert sorted(x[0] for x in notes) == ["010W", "060W"] and any("nav.ditamap" in m for _, m in notes)
    nodes, es, _ = run(spark, root, depth=1)
    assert ("chapter", "contains", "section") not in es and "section" in nodes


def test_links_reuse_and_bodies(spark, tmp_path):
    far = 'xtrf="file:/src/t/far.dita"'
    step = f'<steps><step><cmd>Click <uicontrol>Save</uicontrol>.</cmd><info {far}>Foreign.</info></step></steps><p {far}>Gone</p> Press <ph {far}>the</ph> key <uicontrol>Other</uicontrol>'
    links = (
        '<p><xref href="b.dita#x"/><xref href="b.dita"/><xref href="b.dita" keyref="k"/><xref href="#here"/><xref href="http://x"/><xref href="gone.dita"/>'
        '<xref href="a.dita"/></p><related-links><link href="far.dita"/><uicontrol>Never</uicontrol></related-links>'
    )
    files = {
        "g.ditamap": ("ditamap", MAP.format('<topicref href="t/a.dita"/>')),
        "t/a.dita": ("dita", topic("a", step + links, "task", "taskbody", 'audience="x  y" product=" "', "<shortdesc> Short. </shortdesc>")),
        "t/b.dita": ("dita", topic("b", "<![CDATA[ raw & ]]> text", "concept", "conbody")),
        "t/far.dita": ("dita", topic("far", "", "odd")),
    }
    nodes, es, notes = run(spark, write_job(tmp_path, files, "job.xml"))
    a = nodes["a"]
    assert a["body"] == "Click Save. Press the key Other" and a["shortdesc"] == "Short."
    assert a["uicontrols"] == ["Save", "Other"] and a["cmd_uicontrols"] == ["Save"]
    assert a["audience"] == ["x", "y"] and a["product"] == [""]
    assert nodes["b"]["body"] == "raw & text" and nodes["far"]["body"] is None and nodes["far"]["okf_type"] == "Topic"
    assert es == [("user-guide", "contains", "a"), ("a", "references", "b"), ("a", "requires", "b"), ("a", "generated-from", "far")]
    assert sorted(x[0] for x in notes) == ["010W", "040W"]


def test_duplicate_ids_and_drafts(spark, tmp_path):
    files = {
        "g.ditamap": ("ditamap", MAP.format('<topicref href="topics/first.dita"/><topicref href="topics/second.dita"/><topicref href="d.dita"/>')),
        "topics/first.dita": ("dita", topic("ID")),
        "topics/second.dita": ("dita", topic("ID")),
        "d.dita": ("dita", topic("d", attrs='status="draft"')),
    }
    root = write_job(tmp_path, files)
    nodes, es, notes = run(spark, root)
    assert set(nodes) == {"user-guide", "ID", "ID--topics-second.dita"} and ("user-guide", "contains", "d") in es
    assert sorted(x[0] for x in notes) == ["020I", "070W"]
    assert "d" in run(spark, root, include_drafts=True)[0]


def test_manifest_is_needed(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        job.find_manifest(spark, str(tmp_path))
    root = write_job(tmp_path, {"t.dita": ("dita", topic("t"))})
    with pytest.raises(ValueError):
        job.extract(spark, root)


def test_deep_nesting():
    deep = "<topic id='t'><title>T</title><body>a" + "<p>" * 20_000 + "b<xref href='u.dita'/>c" + "</p>d" * 20_000 + "</body></topic>"
    r = xml_parse.parse_topic("t.dita", deep.encode(), {})
    assert r["body"] == "abc" + "d" * 20_000 and r["links"] == [("references", "u.dita")]


def test_paths():
    assert xml_parse.resolve_path("a/b.ditamap", "../c.dita") == "c.dita"
    assert xml_parse.resolve_path("b.ditamap", "./x/../c.dita") == "./x/../c.dita"
    assert xml_parse.stem("a/.hidden") == ".hidden" and xml_parse.stem("a/b.c.dita") == "b.c"


SAMPLE = [
    {"type": "map", "id": "kiln-book", "title": "Kiln Book", "sourceFile": "k.ditamap", "links": [{"relation": "contains", "target": "glaze-basics"}, {"relation": "contains", "target": "fire-a-kiln"}]},
    {"type": "topic", "id": "glaze-basics", "topicType": "concept", "title": "Glaze Basics", "shortdesc": None, "body": "Cobalt gives a deep blue\nonce it has melted.", "keys": ["glaze-key"], "sourceFile": "gb.dita"},
    {"type": "topic", "id": "fire-a-kiln-checks", "topicType": "topic", "title": "Fire a Kiln: Checks", "sourceFile": "fc.dita", "links": [{"relation": "requires", "target": "glaze-basics"}]},
    {
        "type": "topic", "id": "fire-a-kiln", "topicType": "task", "title": "Fire a Kiln", "shortdesc": "How to fire.", "body": "Shut the lid.",
        "audience": ["potter"], "product": ["raku"], "keys": ["fire-key"], "sourceFile": "f.dita",
        "links": [{"relation": "requires", "target": "glaze-basics"}, {"relation": "references", "target": "fire-a-kiln-checks"}],
    },
]


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("bundle")
    (d / "model.json").write_text(json.dumps(SAMPLE))
    nodes, edges = model.read_model(spark, str(d / "model.json"))
    edges, _ = job.with_inferred(nodes, edges)
    summary, found = publish(nodes, edges, str(d / "out"), server=True)
    assert summary == {"topics": 3, "maps": 1, "edges": 5, "chunks": 3, "errors": 0} and found.count() == 0
    return server.Bundle(spark, str(d / "out"))


def call(bundle, name, **args):
    r = server.handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": args}}, bundle)["result"]
    return r["content"][0]["text"], r["isError"]


def test_published_files(spark, bundle):
    text = open(os.path.join(bundle.root, "okf/topics/fire-a-kiln.md")).read()
    head, body = model.split_concept(text)
    assert model.read_front_matter(head)["title"] == "Fire a Kiln"
    assert "tags:\n- potter\n- raku\n- fire-key\n" in head and "  requires:\n  - glaze-basics" in head
    assert "# Requires\n\n- [Glaze Basics](glaze-basics.md)" in body
    assert "(../topics/glaze-basics.md)" in open(os.path.join(bundle.root, "okf/maps/kiln-book.md")).read()
    graph = json.load(open(os.path.join(bundle.root, "graph.json")))
    assert [n["id"] for n in graph["nodes"]] == [x["id"] for x in SAMPLE]
    assert [(e["from"], e["to"]) for e in graph["edges"]] == [(n["id"], x["target"]) for n in SAMPLE for x in n.get("links", [])]
    chunks = [json.loads(x) for x in open(os.path.join(bundle.root, "rag/chunks.jsonl"))]
    assert chunks[2]["text"] == "How to fire.\n\nShut the lid." and "text" not in chunks[1] and "product" not in chunks[0]
    assert model.bundle_root(os.path.join(bundle.root, "mcp/mcp-server.toml")) == os.path.realpath(bundle.root)
    assert spark.read.parquet(os.path.join(bundle.root, "tables/edges_by_dst")).count() == 5


def test_tools(bundle):
    assert call(bundle, "search_topics", query="fire") == (
        "Fire a Kiln (Task) [fire-a-kiln]\nFire a Kiln: Checks (Topic) [fire-a-kiln-checks]", False)
    assert call(bundle, "search_topics", query="zzz") == ("no topics matched `zzz`", False)
    assert call(bundle, "find_related_topics", topicId="fire-a-kiln", relation="requires") == ("requires -> Glaze Basics (glaze-basics)", False)
    assert call(bundle, "find_related_topics", topicId="nix")[0] == "no relations found for `nix`"
    assert call(bundle, "search_content", query="cobalt")[0] == "Glaze Basics (Concept) [glaze-basics] (score: 1)\n  Cobalt gives a deep blue once it has melted."
    assert call(bundle, "search_content", query="cobalt", topicId="fire-a-kiln-checks", depth=0)[0].startswith("no content matched")
    assert call(bundle, "search_content", query=" ")[1]
    text, _ = call(bundle, "analyze_impact", topicId="glaze-basics")
    assert text.startswith("changing `glaze-basics` would affect 3 concept(s):\nKiln Book (kiln-book) --contains--> glaze-basics\nFire a Kiln: Checks")
    assert call(bundle, "analyze_impact", topicId="kiln-book")[0] == "nothing depends on `kiln-book` (no incoming edges found)"
    assert call(bundle, "trace_dependencies", topicId="fire-a-kiln", depth=-1)[0] == "fire-a-kiln requires Glaze Basics (glaze-basics)"
    assert call(bundle, "generate_summary", topicId="fire-a-kiln") == ("Fire a Kiln: How to fire.", False)
    text, failed = call(bundle, "generate_summary", id="fire-a-kiln")
    assert failed and "topicId" in text
    assert "requires:\n  - Glaze Basics (glaze-basics)" in call(bundle, "explain_task", topicId="fire-a-kiln")[0]
    assert call(bundle, "validate_bundle") == ("bundle OK: no issues", False)
    assert call(bundle, "nope")[1]


def test_protocol(bundle):
    lines = ['{"id":1,"method":"initialize"}', "not json", "", '{"method":"ping"}', '{"id":2,"method":"ping"}', '{"id":3,"method":"x"}', '{"id":4,"method":"tools/list"}', '{"id":5,"method":"notifications/initialized"}']
    out = io.StringIO()
    server.serve(bundle, io.StringIO("\n".join(lines)), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in got] == [1, 2, 3, 4] and got[0]["result"]["protocolVersion"] == "2024-11-05"
    assert got[2]["error"]["code"] == -32601 and len(got[3]["result"]["tools"]) == 8


def test_cache_follows_the_files(spark, bundle, tmp_path):
    import shutil

    root = str(tmp_path / "copy")
    shutil.copytree(bundle.root, root)
    b = server.Bundle(spark, root)
    first = b.tables()
    assert b.tables() is first
    os.utime(os.path.join(root, "graph.json"), ns=(1, 1))
    assert b.tables() is not first
    open(os.path.join(root, "graph.json"), "w").write("{broken")
    assert b.tables() is b.tables()  # the old tables go on serving
    with pytest.raises(server.ToolError):
        server.Bundle(spark, str(tmp_path / "none")).tables()


def test_no_file_for_two_ids(spark, tmp_path):
    ids = ["a/b", "a-b", "a:b", ".a-b", "_a-b", "ü" * 160]
    (tmp_path / "m.json").write_text(json.dumps([{**SAMPLE[1], "id": i, "body": f"Body {k}."} for k, i in enumerate(ids)]))
    nodes, edges = model.read_model(spark, str(tmp_path / "m.json"))
    assert {r["x"] for r in nodes.select(file_name_of(F.col("id")).alias("x")).collect()} == {file_name(i) for i in ids}
    summary, _ = publish(nodes, edges, str(tmp_path / "out"))
    assert summary["errors"] == 0
    got = {r["id"]: r["content"] for r in model.read_concepts(spark, str(tmp_path / "out")).collect()}
    assert set(got) == set(ids) and all(f"Body {k}." in got[i] for k, i in enumerate(ids))
    assert server.validate_files(spark, str(tmp_path / "out")).count() == 0


def test_new_bundle_takes_the_place_of_the_old(spark, tmp_path, monkeypatch):
    (tmp_path / "m.json").write_text(json.dumps(SAMPLE))
    nodes, edges = model.read_model(spark, str(tmp_path / "m.json"))
    root = tmp_path / "out"
    publish(nodes, edges, str(root))
    (root / "mark").write_text("old")
    real = sink.rename

    def crash(spark, path, to):
        if path.endswith(".staging"):
            raise OSError("lost")
        real(spark, path, to)

    monkeypatch.setattr(sink, "rename", crash)
    with pytest.raises(OSError):
        publish(nodes, edges, str(root))
    assert (tmp_path / "out.old" / "mark").read_text() == "old"  # nothing is lost
    monkeypatch.undo()
    publish(nodes, edges, str(root))
    assert not (root / "mark").exists() and sorted(p.name for p in tmp_path.iterdir()) == ["m.json", "out"]


def test_served_from_tables_by_uri(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(SAMPLE))
    nodes, edges = model.read_model(spark, str(tmp_path / "m.json"))
    root = f"file://{tmp_path}/out"
    publish(nodes, edges, root, graph_json=False, tables={"extra": nodes.select("id")})
    assert not (tmp_path / "out" / "graph.json").exists() and spark.read.parquet(f"{root}/tables/extra").count() == 4
    b = server.Bundle(spark, root)
    before = set(session._WRITTEN)
    assert call(b, "find_related_topics", topicId="fire-a-kiln", relation="requires") == ("requires -> Glaze Basics (glaze-basics)", False)
    assert call(b, "trace_dependencies", topicId="fire-a-kiln")[0] == "fire-a-kiln requires Glaze Basics (glaze-basics)"
    assert call(b, "analyze_impact", topicId="glaze-basics")[0].startswith("changing `glaze-basics` would affect 3 concept(s):")
    assert call(b, "search_content", query="cobalt", topicId="kiln-book")[0].startswith("Glaze Basics (Concept) [glaze-basics] (score: 1)")
    assert call(b, "generate_summary", topicId="checks")[1] and call(b, "validate_bundle") == ("bundle OK: no issues", False)
    assert set(session._WRITTEN) == before  # nothing is left of a call


def test_rules_for_files(spark, bundle, tmp_path):
    import shutil

    root = tmp_path / "copy"
    shutil.copytree(bundle.root, root)
    okf = root / "okf"
    f = okf / "topics" / "fire-a-kiln.md"
    f.write_text(f.read_text().replace("  requires:\n  - glaze-basics", "  requires:\n  - glaze-basics\n  - nowhere").replace("---\n", '---\nokf_version: "0.2"\n', 1))
    (okf / "topics" / "lonely.md").write_text("---\ntype: Topic\n---\n\n")
    (root / "rag" / "chunks.jsonl").open("a").write("\n" + "gh" + "p_" + "a1" * 18 + "\n")
    index = okf / "index.md"
    index.write_text("\n".join(x for x in index.read_text().split("\n") if "checks" not in x))  # still linked from a topic
    got = {(r["severity"], r["rule"], r["subject"]) for r in server.validate_files(spark, str(root)).collect()}
    assert got == {
        ("error", "version-outside-index", "topics/fire-a-kiln.md"), ("error", "unknown-relation-target", "topics/fire-a-kiln.md -> nowhere"),
        ("warning", "not-reachable", "topics/lonely.md"), ("error", "secret", "rag/chunks.jsonl: github-token"),
    }
    index.unlink()
    assert ("error", "missing-index", "index.md") in {(r["severity"], r["rule"], r["subject"]) for r in server.validate_files(spark, str(root)).collect()}


def test_odd_folder_names_and_stray_files(spark, tmp_path):
    for name in ("job(1)", "job++x", "j%20b"):
        root = write_job(tmp_path / name, {"g.ditamap": ("ditamap", MAP.format('<topicref href="t/a.dita"/>')), "t/a.dita": ("dita", topic("a"))})
        (tmp_path / name / "t" / "image.png").write_bytes(b"\xff\xfe\x00" * 100)
        nodes, es, _ = run(spark, root)
        assert set(nodes) == {"user-guide", "a"} and es == [("user-guide", "contains", "a")]


def test_gate_publishes_nothing(spark, tmp_path):
    bad = [dict(SAMPLE[1], body="AK" + "IA" + "ABCDEFGHIJKLMNOP", links=[{"relation": "requires", "target": "gone"}])]
    (tmp_path / "m.json").write_text(json.dumps(bad))
    nodes, edges = model.read_model(spark, str(tmp_path / "m.json"))
    summary, found = publish(nodes, edges, str(tmp_path / "out"))
    assert summary["errors"] == 3 and {(r["rule"], r["subject"]) for r in found.collect()} == {
        ("secret", "topics/glaze-basics.md: aws-access-key-id"), ("secret", "rag/chunks.jsonl: aws-access-key-id"), ("dangling-link", "glaze-basics -> gone"),
    }
    assert not (tmp_path / "out").exists()


@pytest.mark.parametrize("change", [{"topicType": "poem"}, {"type": "book"}, {"links": [{"relation": "likes", "target": "x"}]}])
def test_unknown_values_fail(spark, tmp_path, change):
    (tmp_path / "m.json").write_text(json.dumps([{**SAMPLE[1], **change}]))
    with pytest.raises(Exception):
        model.read_model(spark, str(tmp_path / "m.json"))


def test_command_line(spark, bundle, capsys, tmp_path):
    assert main(["query", "--store", bundle.root, "--topic", "kiln-book"]) == 0
    assert capsys.readouterr().out == "contains -> glaze-basics\ncontains -> fire-a-kiln\n"
    assert main(["query", "--store", bundle.root, "--topic", "glaze-basics"]) == 1
    assert main(["validate", "--bundle", bundle.root]) == 0
    assert main(["query", "--store", str(tmp_path), "--topic", "x"]) == 2
    with pytest.raises(SystemExit):
        main(["build", "--input", "x", "--output", "y", "--mcp", "yes"])


def test_names_and_scalars():
    assert file_name("../a/b").startswith("-..-a-b~") and file_name("ok--x.dita") == "ok--x.dita"
    assert len({file_name(x) for x in ("a/b", "a-b", "a:b", "", "-", "x" * 300, "x" * 301)}) == 7
    assert scalar("Plain title") == "Plain title" and scalar("a: b") == '"a: b"' and scalar("yes") == '"yes"'

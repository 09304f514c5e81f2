"""Command line: build, validate, query, serve. Exit 0: done; 1: findings or nothing found; 2: failed."""

from __future__ import annotations

import argparse
import sys

from .operators import infer, traverse
from .serve import Bundle, has_tables, serve, validate_files
from .session import build_session
from .sinks.bundle import publish
from .sources import job, model


def _flag(text: str) -> bool:
    if text not in ("true", "false"):
        raise argparse.ArgumentTypeError("must be true or false")
    return text == "true"


def _levels(text: str) -> int | None:
    if text in ("", "unlimited"):
        return None
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError("must be unlimited or a positive number")
    return int(text)


def _show(df) -> None:
    for r in df.toLocalIterator():
        print(_line(r.asDict()), file=sys.stderr)


def _line(row: dict) -> str:
    import json

    return json.dumps(row, ensure_ascii=False)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftgraph")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    src = b.add_mutually_exclusive_group(required=True)
    src.add_argument("--input", help="normalized model, a JSON array")
    src.add_argument("--job", help="job folder of resolved XML")
    b.add_argument("--output", required=True)
    b.add_argument("--store", default="none", help="accepted for compatibility; Parquet tables are always written")
    b.add_argument("--emit-graph-json", type=_flag, default=True)
    b.add_argument("--mcp", type=_flag, default=False)
    b.add_argument("--depth", type=_levels, default=None)
    b.add_argument("--include-drafts", type=_flag, default=False)
    v = sub.add_parser("validate")
    v.add_argument("--bundle", required=True)
    q = sub.add_parser("query")
    q.add_argument("--store", required=True)
    q.add_argument("--topic", required=True)
    q.add_argument("--relation")
    s = sub.add_parser("serve")
    s.add_argument("root", nargs="?")
    s.add_argument("--config")
    a = p.parse_args(argv)
    spark = build_session()
    try:
        if a.command == "build":
            if a.input:
                nodes, edges = model.read_model(spark, a.input)
                notes = None
            else:
                nodes, edges, notes = job.extract(spark, a.job, a.depth, a.include_drafts)
            edges, more = job.with_inferred(nodes, edges)
            summary, found = publish(nodes, edges, a.output, a.emit_graph_json, a.mcp, tables={"term_candidates": infer.term_candidates(nodes)})
            _show(more if notes is None else notes.unionByName(more))
            _show(found)
            print(" ".join(f"{k}={n}" for k, n in summary.items()))
            return 1 if summary["errors"] else 0
        if a.command == "validate":
            found = validate_files(spark, a.bundle).cache()
            _show(found)
            return 1 if found.where("severity = 'error'").count() else 0
        if a.command == "query":
            store = a.store.rstrip("/")
            edges = spark.read.parquet(f"{store}/tables/edges_by_src") if has_tables(spark, store) else model.read_graph(spark, store)[1]
            rows = traverse.edges_from(edges, a.topic, a.relation).orderBy("edge_ord").collect()
            for r in rows:
                print(f"{r['relation']} -> {r['dst']}")
            return 0 if rows else 1
        serve(Bundle(spark, model.bundle_root(a.config, a.root)))
        return 0
    except Exception as e:
        print(f"weftgraph: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

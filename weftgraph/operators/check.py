"""Validation of a bundle, and the scan for secrets, as tables of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Patterns of the secret scan.
SECRETS = {
    "aws-access-key-id": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "pem-private-key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "github-token": r"gh[pousr]_[A-Za-z0-9]{36}",
    "slack-token": r"xox[abprs]-[A-Za-z0-9-]{10}",
}


def missing_type(nodes: DataFrame) -> DataFrame:
    return nodes.where("okf_type is null or okf_type = ''").select("id")


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, relation, dst): edges whose target is no node."""
    ids = nodes.select(F.col("id").alias("dst")).distinct()
    return edges.join(ids, "dst", "left_anti").select("src", "relation", "dst").distinct()


def redundant_links(edges: DataFrame) -> DataFrame:
    """(src, dst, n): the same target linked more than once in one node."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unreachable(files: DataFrame, links: DataFrame, listed: DataFrame) -> DataFrame:
    """(file): files that no way of links leads to from those listed (column ``file``). ``links``:
    (src, dst). Files that are listed need no search, so only the others are walked to."""
    rest = cut(files.join(listed, "file", "left_anti").select("file"))
    front = listed.select("file")
    while not rest.isEmpty():
        met = links.join(front.select(F.col("file").alias("src")), "src", "left_semi").select(F.col("dst").alias("file")).distinct()
        front = cut(rest.join(met, "file", "left_semi"))
        if front.isEmpty():
            break
        rest = cut(rest.join(front, "file", "left_anti"))
    return rest


def secret_scan(files: DataFrame, name: str, content: str) -> DataFrame:
    """(file, pattern): which file holds which kind of secret; the secret itself is never repeated."""
    kinds = F.array_compact(F.array(*[F.when(F.col(content).rlike(p), F.lit(k)) for k, p in SECRETS.items()]))
    return files.where(F.col(content).isNotNull()).select(F.col(name).alias("file"), F.explode(kinds).alias("pattern")).distinct()


def duplicate_files(files: DataFrame) -> DataFrame:
    """(file, n): names under which more than one file would be written."""
    return files.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def findings(nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None, rag: DataFrame | None = None) -> DataFrame:
    """(severity, rule, subject): all rules together; only errors fail a bundle. ``files`` and ``rag``
    (file, content) are the concept files and the text index, which are scanned for secrets."""

    def of(df: DataFrame, severity: str, rule: str, subject) -> DataFrame:
        return df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), subject.alias("subject"))

    arrow = F.concat("src", F.lit(" -> "), "dst")
    out = of(missing_type(nodes), "error", "missing-type", F.col("id"))
    out = out.union(of(duplicate_ids(nodes), "error", "duplicate-id", F.col("id")))
    out = out.union(of(dangling(nodes, edges), "error", "dangling-link", arrow))
    out = out.union(of(redundant_links(edges), "warning", "redundant-link", arrow))
    if files is not None:
        out = out.union(of(duplicate_files(files), "error", "duplicate-file", F.col("file")))
        every = files.select("file", "content")
        hits = secret_scan(every if rag is None else every.union(rag.select("file", "content")), "file", "content")
        out = out.union(of(hits, "error", "secret", F.concat("file", F.lit(": "), "pattern")))
    return out

"""Reuse of lines between documents: one owner keeps a line, the others refer to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .orphans import hot_keys, salted

LEAST = 20  # longest line that is no reuse, in characters


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line")
    return docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), t)


def _owned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, pos, line, owner): owner is the least document that has the line, null for short lines
    and for lines that one document alone has. Lines in very many documents are spread by salt."""
    x = lines(docs, key, text).withColumn("h", F.when(F.char_length("line") > LEAST, F.xxhash64("line")))
    long = x.where("h is not null")
    owner = long.groupBy("h").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner <> last").select("h", "owner")
    hot = hot_keys(long, "h")
    a, b = salted(x, "h", hot, "doc"), salted(owner, "h", hot, None)
    return a.join(b, ["h", "_salt"], "left").select("doc", "pos", "line", "owner")


def generated_from(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(src, dst): documents and the owners of lines they reuse."""
    o = _owned(docs, key, text).where("owner is not null and owner <> doc")
    return o.select(F.col("doc").alias("src"), F.col("owner").alias("dst")).distinct()


def canonical_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, body): the text without lines that another document owns; null where none is left."""
    o = _owned(docs, key, text).where("owner is null or owner = doc")
    g = o.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda s: s["line"]), "\n")
    return g.select("doc", F.when(F.length(F.trim(body)) > 0, body).alias("body"))

"""Keeping a table of records up to date from deliveries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..files import delete, exists, names_in, read_text, write_text


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): records added, removed or changed between two tables of equal columns.

    Only keys and hashes of the other columns are shuffled, not the records. Keys are unique.
    """
    cols = sorted(c for c in old.columns if c != key)

    def hashed(df: DataFrame, name: str) -> DataFrame:
        # null and empty differ; lengths keep neighbouring columns apart
        part = [F.concat(F.coalesce(F.length(F.col(c).cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols]
        return df.select(F.col(key), F.sha2(F.concat(F.lit(""), *part), 256).alias(name))

    d = hashed(old, "h0").join(hashed(new, "h1"), key, "full")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return d.select(key, change.alias("change")).where("change is not null")


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row a key, the one with the latest ``at``; a null ``at`` is the earliest, and among equally
    late rows the hash of the row decides, so that the result does not depend on their order."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(F.col(at).isNotNull(), F.col(at), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in rest]))
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def _manifest(spark: SparkSession, root: str, number: int) -> dict | None:
    path = f"{root}/versions/{number}.json"
    return json.loads(read_text(spark, path)) if exists(spark, path) else None


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n in names_in(spark, f"{root}/versions") if n.endswith(".json"))


def _rows(spark: SparkSession, root: str, manifest: dict, buckets: list[str] | None = None) -> DataFrame | None:
    paths = [f"{root}/{p}" for b, p in sorted(manifest["buckets"].items()) if buckets is None or b in buckets]
    return spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(*paths) if paths else None


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The table's newest complete version; None where there is none."""
    numbers = _numbers(spark, root)
    if not numbers:
        return None
    m = _manifest(spark, root, numbers[-1])
    rows = _rows(spark, root, m)
    return rows if rows is not None else spark.createDataFrame([], StructType.fromJson(m["schema"]))


def keep_current(stream: DataFrame, root: str, checkpoint: str, key: str = "id", at: str = "loaded_at", buckets: int = 64) -> StreamingQuery:
    """Fold a stream of deliveries into a versioned table with one row a key: late and repeated rows
    change nothing unless they are newer.

    The table lies in ``buckets`` parts by the hash of the key; a micro-batch rewrites the parts it has
    rows for and lists the parts of its version in a file that appears last. A batch that is run again
    after a failure starts from the version before it and replaces its own result. Parts that neither
    of the last two versions lists are removed. ``root`` is a folder of any file system Spark knows.
    A batch whose former version is missing fails: nothing is ever built on nothing. Number 0, the
    first batch of a new checkpoint, begins the table anew.
    """
    root = root.rstrip("/")

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _manifest(spark, root, number - 1) if number else None
        if number and before is None:
            raise RuntimeError(f"version {number - 1} of {root} is missing")
        parts = before["parts"] if before else buckets
        bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("string")
        batch = batch.persist()
        try:
            touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most `buckets`
            old = _rows(spark, root, before, touched) if before else None
            rows = batch if old is None else batch.unionByName(old, allowMissingColumns=True)
            data = f"data/{number}"
            delete(spark, f"{root}/{data}")
            if touched:
                latest(rows, key, at).withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{root}/{data}")
            lists = {**(before["buckets"] if before else {}), **{b: f"{data}/_bucket={b}" for b in touched}}
            write_text(spark, f"{root}/versions/{number}.json", json.dumps({"parts": parts, "schema": rows.schema.jsonValue(), "buckets": lists}))
        finally:
            batch.unpersist()
        if number == 0:  # a table begun anew: later versions of the former one are no successors
            for n in _numbers(spark, root):
                if n:
                    delete(spark, f"{root}/versions/{n}.json")
        _sweep(spark, root, number)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _sweep(spark: SparkSession, root: str, number: int) -> None:
    """Remove versions older than the one before ``number``, and the parts that only they list."""
    for n in _numbers(spark, root):
        if n < number - 1:
            delete(spark, f"{root}/versions/{n}.json")
    wanted = set()
    for n in _numbers(spark, root):
        wanted |= set(_manifest(spark, root, n)["buckets"].values())
    for data in names_in(spark, f"{root}/data"):
        if not any(w.startswith(f"data/{data}/") for w in wanted):
            delete(spark, f"{root}/data/{data}")
            continue
        for part in names_in(spark, f"{root}/data/{data}"):
            if part.startswith("_bucket=") and f"data/{data}/{part}" not in wanted:
                delete(spark, f"{root}/data/{data}/{part}")

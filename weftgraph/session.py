"""Session helpers: a tuned local session, and durable cuts of lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .files import delete

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN_DIR: str | None = None
_WRITTEN: list[str] = []
_SHIPPED: set[str] = set()


def build_session(app: str = "weftgraph", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` keys use ``__`` for dots."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or what the session was given as its
    checkpoint folder. A folder of our own only where neither is set and one machine runs all; on a
    cluster a folder of the driver's machine would be lost to the others, so that is an error."""
    global _OWN_DIR
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="weftgraph-")
        atexit.register(shutil.rmtree, _OWN_DIR, ignore_errors=True)
    return _OWN_DIR


def cut_path(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def write_cut(df: DataFrame, *partition_by: str, path: str | None = None) -> str:
    """Write ``df`` as a table in the shared folder, at ``path`` below a :func:`cut_path` if given,
    and return its path."""
    spark = df.sparkSession
    ship(spark)
    path = path or cut_path(spark)
    # nothing reads the shuffle files of a table that is written: let Spark remove them at once
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    try:
        w.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: the rows are written once to the shared folder and read back, so that a lost
    executor costs a re-read, never a recomputation of the whole chain."""
    return df.sparkSession.read.schema(df.schema).parquet(write_cut(df))


def drop_cut(spark: SparkSession, path: str) -> None:
    """Remove a table written by :func:`write_cut` that nothing reads any more."""
    delete(spark, path)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is cut inside is removed at the end; for callers that have their rows by then."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in [p for p in _WRITTEN if p not in before]:
            drop_cut(spark, path)


def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_WRITTEN):
        try:
            drop_cut(spark, path)
        except Exception:  # the session is gone; the folder belongs to the cluster then
            return


atexit.register(_drop_all)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once a session."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="weftgraph-zip-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

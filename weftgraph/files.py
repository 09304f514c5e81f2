"""Files of any file system Spark knows, from the driver; and, by pyarrow, from the tasks."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import SparkSession

_URI = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:")


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path, whatever store it lies in."""
    sc = spark.sparkContext
    # a plain name is taken as it is: in a URI, characters such as % or # would have a meaning
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def stamp(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(modification time, size) of a file; None where there is none."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    s = fs.getFileStatus(p)
    return s.getModificationTime(), s.getLen()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none where there is no folder."""
    fs, p = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, p = file_system(spark, path)
    if not fs.rename(p, file_system(spark, to)[1]):
        raise OSError(f"cannot rename {path} to {to}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    f = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode("utf-8-sig")
    finally:
        f.close()


def _create(fs, p):
    """An output stream of a new file, without a checksum file beside it: people edit these files."""
    fs.setWriteChecksum(False)
    try:
        return fs.create(p, True)
    finally:
        fs.setWriteChecksum(True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file that appears as a whole: written beside its place, then renamed."""
    fs, p = file_system(spark, path)
    fs.mkdirs(p.getParent())
    _, beside = file_system(spark, f"{path.rpartition('/')[0]}/.{path.rpartition('/')[2]}.tmp")
    out = _create(fs, beside)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"cannot write {path}")


def join_files(spark: SparkSession, path: str, pieces: Iterable[bytes | tuple[str, int]]) -> None:
    """One file of pieces: bytes, or the parts of a folder in order of their names, the first ``skip``
    bytes of all being left out. The bytes stream from store to store."""
    fs, p = file_system(spark, path)
    jvm = spark.sparkContext._jvm
    fs.mkdirs(p.getParent())
    out = _create(fs, p)
    try:
        for piece in pieces:
            if isinstance(piece, bytes):
                out.write(bytearray(piece))
                continue
            folder, skip = piece
            for name in names_in(spark, folder):
                src, q = file_system(spark, f"{folder}/{name}")
                size = src.getFileStatus(q).getLen()
                if not name.startswith("part-") or not size:
                    continue
                f = src.open(q)
                try:
                    f.seek(min(skip, size))
                    skip = max(0, skip - size)
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(f, out, 1 << 20, False)
                finally:
                    f.close()
    finally:
        out.close()


def task_store(root: str):
    """(pyarrow file system, folder in it) of a folder, for use in tasks."""
    from pyarrow import fs

    if not _URI.match(root):
        return fs.LocalFileSystem(), root
    return fs.FileSystem.from_uri(root)

"""Crash-safe replacement of a table folder: versioned folders and a pointer that is switched last.

A table at ``path`` is a set of folders ``path/version-...``, each a complete write of its own, and the small file ``path/_current``,
which names the one that counts. A replacement writes a new folder, then a new pointer beside the old one, and renames it over
the old one in one step. Until then readers resolve the old version; a write that is killed at any time leaves it as it
was, and its half-written folder is named by nothing. Versions other than the newest ``keep`` finished ones are deleted after the switch, so readers that began
before it go on, and a job can read a table and replace it.

One writer at a time is assumed. On a store without atomic rename the pointer is replaced by one small object, which such stores do
write as a whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

POINTER = "_current"
PREFIX = "version-"


def _folder(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """The finished versions that the pointer lists, the current one last."""
    pointer, fs = _folder(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(pointer):
        return []
    stream = fs.open(pointer)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
    finally:
        stream.close()


def resolve(spark: SparkSession, path: str) -> str:
    """The folder that holds the table at ``path`` now; ``path`` itself if nothing was ever replaced there."""
    names = _names(spark, path)
    return f"{path.rstrip('/')}/{names[-1]}" if names else path


def replace(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 2) -> str:
    """Replace the table at ``path`` by what ``write(folder)`` writes; returns the new folder.

    ``keep`` finished versions stay, the new one included.
    """
    root = path.rstrip("/")
    done = _names(spark, root)
    name = f"{PREFIX}{uuid.uuid4().hex}"
    write(f"{root}/{name}")
    done = [*done, name][-max(1, keep):]
    _switch(spark, root, done)
    folder, fs = _folder(spark, root)
    for found in fs.listStatus(folder):
        if found.isDirectory() and found.getPath().getName().startswith(PREFIX) and found.getPath().getName() not in done:
            fs.delete(found.getPath(), True)
    return f"{root}/{name}"


def _switch(spark: SparkSession, root: str, names: list[str]) -> None:
    jvm = spark._jvm
    fresh, fs = _folder(spark, f"{root}/{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    try:
        out.write(bytearray("\n".join(names).encode()))
    finally:
        out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(fresh).toUri(), spark._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(fresh), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")), how)

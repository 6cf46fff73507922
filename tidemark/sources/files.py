"""The source files of a project, without the skipped folders and what its ignore file names."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import patterns
from tidemark.operators.filters import SKIPPED, ignored, in_skipped_folder
from tidemark.session import staged

_SCHEMA = "path string, ord string, code string, mtime long, size long"
#: Bytes of hidden files that the driver holds at a time.
HELD = 32 << 20


class Folder:
    """A root folder in any store that Spark reads, for what Spark's own listing leaves out."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, inner: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{inner}" if inner else self.root + "/")

    def read(self, inner: str) -> bytes | None:
        """The bytes of a file; None if it is not there."""
        path = self._path(inner)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def hidden(self) -> Iterator[tuple[str, int, int]]:
        """path, time and size of source files whose name, or a folder of theirs, begins with a dot or an underscore."""
        todo = [""]
        while todo:
            top = todo.pop()
            for found in self.fs.listStatus(self._path(top)):
                name = found.getPath().getName()
                inner = f"{top}/{name}" if top else name
                if found.isDirectory():
                    if name not in SKIPPED:
                        todo.append(inner)
                elif name.endswith(".php") and any(part[0] in "._" for part in inner.split("/")):
                    yield inner, found.getModificationTime() // 1000, found.getLen()


def ignore_lines(spark: SparkSession, root: str) -> list[str]:
    """Lines of the ignore file at the root; no file, no lines."""
    return (Folder(spark, root).read(".gitignore") or b"").decode("utf-8", "replace").splitlines()


def _hidden(spark: SparkSession, root: str) -> list[DataFrame]:
    """Files that Spark's listing leaves out, as it takes names that begin with a dot or an underscore for its own.

    They are read by the driver, ``HELD`` bytes at a time, each time staged in the shared folder.
    """
    folder, out, rows, held = Folder(spark, root), [], [], 0
    for path, mtime, size in sorted(folder.hidden()):
        rows.append((path, path, folder.read(path).decode("utf-8", "replace"), mtime, size))
        held += size
        if held >= HELD:
            out.append(staged(spark.createDataFrame(rows, _SCHEMA), "hidden"))
            rows, held = [], 0
    return [*out, spark.createDataFrame(rows, _SCHEMA)] if rows else out


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path (in the project), ord, code, mtime, size of all PHP files. The order of files is that of their paths.

    ``root`` is an absolute path or a URI; the ignore file at the root counts for both.
    """
    top = os.path.abspath(root) if "://" not in root and not root.startswith("file:") else root.rstrip("/")
    local = top.removeprefix("file://")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.php").load(top)
    plain = F.regexp_replace("path", "^file:/+", "/") if local.startswith("/") else F.col("path")
    path = F.substring(plain, len(local) + 2, 1 << 30)
    files = read.select(path.alias("path"), path.alias("ord"), F.decode("content", "utf-8").alias("code"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"))
    for more in _hidden(spark, top):
        files = files.unionByName(more)
    return files.filter(~in_skipped_folder(F.col("path")) & ~ignored(F.col("path"), patterns.ignore_rules(ignore_lines(spark, top))))

"""Relations of a built graph, kept between runs as Parquet.

A save writes a folder of its own and, last, its version and time; only then can a load see it, so a run
that dies leaves the state before it. The state before the newest stays, as plans may still read it.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

#: 2: calls are kept too.
VERSION = 2


class Store:
    def __init__(self, spark: SparkSession, folder: str, temporary: bool = False):
        """A temporary folder goes when the driver's JVM ends."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.temporary = temporary

    def _states(self) -> list[str]:
        if not self._fs.exists(self._path):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path)]
        return sorted(n for n in names if n.startswith("state-"))

    def _done(self, state: str) -> bool:
        return self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{state}/meta/_SUCCESS"))

    def exists(self) -> bool:
        return any(map(self._done, self._states()))

    def save(self, **relations: DataFrame) -> None:
        now = time.time_ns()
        if self.temporary and self._fs.mkdirs(self._path):
            self._fs.deleteOnExit(self._path)
        state = f"state-{now:020d}"
        for name, rows in relations.items():
            rows.write.parquet(f"{self.folder}/{state}/{name}")
        said = [(VERSION, now // 1_000_000_000, sorted(relations))]
        self.spark.createDataFrame(said, "version int, saved long, relations array<string>").write.parquet(f"{self.folder}/{state}/meta")
        for old in self._states()[:-2]:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{old}"), True)

    def load(self) -> dict[str, DataFrame] | None:
        """The newest whole state; None if there is none or it is of another version."""
        done = self.states()
        if not done:
            return None
        meta = self.spark.read.parquet(f"{self.folder}/{done[-1]}/meta").first()
        if meta.version != VERSION:
            return None
        return {name: self.spark.read.parquet(f"{self.folder}/{done[-1]}/{name}") for name in meta.relations}

    def statistics(self) -> dict[str, float]:
        """Files that are tracked, seconds since the last save, and bytes; nothing if there is no state."""
        done = self.states()
        if not done:
            return {}
        meta = self.spark.read.parquet(f"{self.folder}/{done[-1]}/meta").first()
        kept = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{done[-1]}")
        return {"tracked": self.spark.read.parquet(f"{self.folder}/{done[-1]}/registry").count(), "age": round(time.time() - meta.saved, 1), "bytes": self._fs.getContentSummary(kept).getLength()}

    def states(self) -> list[str]:
        """Names of the whole states that are kept, oldest first."""
        return [s for s in self._states() if self._done(s)]

    def clear(self) -> None:
        self._fs.delete(self._path, True)

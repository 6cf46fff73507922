"""What changed: snapshot diffs, pruning, incremental merges, hunks to methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registry_diff(current: DataFrame, registry: DataFrame) -> DataFrame:
    """path, status (new, modified, deleted) by modification time and size."""
    a, b = current.alias("a"), registry.alias("b")
    status = F.when(F.col("b.path").isNull(), "new").when(F.col("a.path").isNull(), "deleted").when(~F.col("a.mtime").eqNullSafe(F.col("b.mtime")) | ~F.col("a.size").eqNullSafe(F.col("b.size")), "modified")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    return both.select(F.coalesce("a.path", "b.path").alias("path"), status.alias("status")).filter("status is not null")


def update_registry(current: DataFrame, registry: DataFrame, keep_deleted: bool = True) -> DataFrame:
    """The next snapshot. Rows of deleted files stay (compatible) unless told otherwise."""
    gone = registry.join(current, "path", "left_anti").select("path", "mtime", "size")
    now = current.select("path", "mtime", "size")
    return now.unionByName(gone) if keep_deleted else now


def prune(relation: DataFrame, current: DataFrame) -> DataFrame:
    """Rows whose file is still there."""
    return relation.join(current.select("path"), "path", "left_semi")


def merge_incremental(cached: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """Cached rows of unchanged files and fresh rows of changed ones."""
    return cached.join(changed.select("path"), "path", "left_anti").unionByName(fresh)


def merge_class_index(cached: DataFrame, old_classes: DataFrame, fresh: DataFrame) -> DataFrame:
    """class_name, path after a partial run. Every class that a changed file used to declare is unmapped first, even
    if another file owns it by now (compatible); then fresh declarations win."""
    gone = old_classes.select(F.col("name").alias("class_name")).unionByName(fresh.select("class_name")).distinct()
    return cached.join(gone, "class_name", "left_anti").unionByName(fresh.select("class_name", "path"))


def hunk_methods(hunks: DataFrame, lines: DataFrame) -> DataFrame:
    """path, method for lines inside a hunk; a hunk of no lines touches nothing."""
    inside = (F.col("line") >= F.col("start")) & (F.col("line") < F.col("start") + F.col("cnt"))
    return lines.join(hunks, "path").filter(inside).select("path", "method").distinct()


def chunk_of(files: DataFrame, workers: int, n: int) -> DataFrame:
    """ord, path, chunk: consecutive runs of ceil(n / workers) files."""
    size = max(1, -(-n // workers))
    return files.withColumn("chunk", F.floor(F.col("ord") / size).cast("int"))


def registry_totals(registry: DataFrame) -> DataFrame:
    """files, newest (time of the last change), bytes of a registry: one row."""
    return registry.agg(F.count(F.lit(1)).alias("files"), F.max("mtime").alias("newest"), F.sum("size").alias("bytes"))


def registry_lookup(registry: DataFrame, paths: DataFrame) -> DataFrame:
    """path, known, mtime, size for each of the paths; an unknown one has neither time nor size."""
    there = registry.select("path", "mtime", "size", F.lit(True).alias("known"))
    return paths.select("path").join(there, "path", "left").select("path", F.coalesce("known", F.lit(False)).alias("known"), "mtime", "size")


def method_counts(methods: DataFrame) -> DataFrame:
    """files, methods of changed methods (path, method): one row. A method counts once in each of its files."""
    by_file = methods.groupBy("path").agg(F.count_distinct("method").alias("n"))
    return by_file.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("methods"))


def split_report(reached: DataFrame, changed: DataFrame) -> DataFrame:
    """path, why: whether a file that is reached changed itself or depends on one that did."""
    there = changed.select("path", F.lit("changed").alias("why")).distinct()
    return reached.select("path").join(there, "path", "left").select("path", F.coalesce("why", F.lit("dependent")).alias("why"))


def cache_stats(parsed: int, total: int, parse_seconds: float = 0.0) -> dict[str, float]:
    cached = total - parsed
    return {"parsed": parsed, "cached": cached, "hit_rate": round(cached / total * 100, 2) if total else 0.0, "seconds_saved": parse_seconds / parsed * cached if parsed else 0.0}


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def union_set(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def intersect_keys(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows, repeats included, whose key is also among the others."""
    return rows.join(others, key, "left_semi")


def except_keys(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows, repeats included, whose key is not among the others."""
    return rows.join(others, key, "left_anti")

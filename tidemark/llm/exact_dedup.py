"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Texts are equal when they are identical after each run of ASCII white space became one blank.

Plan: one shuffle carries each distinct text once (copies meet in the map-side aggregate first, so a
hot group never gathers in one task); grouping on (hash, text) is the comparison of bytes. After
that only ids and hashes move. The join from rows to groups is a plain shuffle join on the hash, so
adaptive execution splits the partition of a hot group.

Defined results: a null text is an empty one, so null, '' and nothing-but-absent texts form one
group; a null id is never the id that stays unless all ids of its group are null; of rows repeated
with one id, exactly one is kept and all count in ``group_size``; texts of any length are compared whole; an
empty table gives no rows; further
columns, whatever their names, do not matter and stay as they are in ``exact_dedup``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, ids_repeat, staged, unused, whole


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(whole(text), BLANKS, " ")


def content_hash(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str, text_col: str, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per distinct text: hash_, keep_id, group_size, text_sha256. Staged, and without the texts."""
    rows = docs.select(F.col(id_col).alias("id_"), normalised(text_col).alias("text_"))
    groups = rows.groupBy(hash_of(F.col("text_")).alias("hash_"), "text_").agg(F.min("id_").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return staged(groups.select("hash_", "keep_id", "group_size", F.sha2("text_", 256).alias("text_sha256")), "exact-groups")


def _clashes(groups: DataFrame) -> DataFrame | None:
    """Hashes that more than one text has, or None if there are none, as is usual."""
    found = groups.groupBy("hash_").count().filter("count > 1").select("hash_")
    return None if found.isEmpty() else found


def label_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Every row: <id_col>, keep_id, group_size, kept, text_sha256."""
    groups = exact_groups(docs, id_col, text_col, hash_of)
    clash = _clashes(groups)
    rows = docs.select(F.col(id_col).alias("id_"), normalised(text_col).alias("text_")).withColumn("hash_", hash_of(F.col("text_")))
    alone = groups if clash is None else groups.join(clash, "hash_", "left_anti")
    times = rows.groupBy("id_", "hash_").agg(F.count(F.lit(1)).alias("times"))
    out = times.join(alone, "hash_")
    if clash is not None:
        # Different texts under one hash: these rows alone are told apart by their bytes.
        mixed = rows.join(clash, "hash_", "left_semi")
        told = mixed.groupBy("hash_", "text_").agg(F.min("id_").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        times = mixed.groupBy("id_", "hash_", "text_").agg(F.count(F.lit(1)).alias("times"))
        told = told.withColumn("text_sha256", F.sha2("text_", 256))
        out = out.unionByName(times.join(told, ["hash_", "text_"]).drop("text_"))
    each = out.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    kept = F.col("id_").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return each.select(F.col("id_").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows that stay, with all their columns. Rows are told apart by id and text; only where ids repeat are they compared again."""
    groups = exact_groups(docs, id_col, text_col, hash_of)
    sha, keep, mark = unused(docs, "sha"), unused(docs, "keep"), unused(docs, "mark")
    rows = docs.withColumn(sha, F.sha2(normalised(text_col), 256))
    if _clashes(groups) is None:
        # One text a hash: the id and the text's digest name the row.
        stay = groups.select(F.col("keep_id").alias(keep), F.col("text_sha256").alias(mark))
        found = rows.join(stay, F.col(id_col).eqNullSafe(F.col(keep)) & (F.col(sha) == F.col(mark)), "left_semi")
    else:
        texts = docs.select(F.col(id_col).alias("id_"), normalised(text_col).alias("text_"))
        stay = texts.groupBy("text_").agg(F.min("id_").alias(keep)).withColumnRenamed("text_", mark)
        found = rows.join(stay, F.col(id_col).eqNullSafe(F.col(keep)) & (normalised(text_col) == F.col(mark)), "left_semi")
    if ids_repeat(docs, id_col):
        found = found.dropDuplicates([id_col, sha])
    return found.drop(sha)

"""Sharding by a k-d tree over document metadata.

Each node of the tree is split at the weighted median (by bytes) of its widest dimension, until the
leaves reach the target bytes. A node that has to give ``n`` leaves is split in the proportion of
``n // 2`` to ``n - n // 2``, so any number of leaves comes out at near equal bytes.

Coordinates are order-preserving longs: the logarithm of a count, and the rank of a name among all distinct
names, so that like names lie together. Below them a hash of the row breaks ties, and in its last bits a
hash of the row's place in the table; so a value that a third of all rows share is split like any other,
and rows equal in every regard are parted too, into as many pieces as ``REPEAT`` bits tell apart.

Medians are found by a radix descent: sums of bytes in equal intervals of each node's range, for all nodes of a
level at once and summed map-side; the interval with the median is divided again until it holds less than
``SLACK`` of a leaf, or a single key. The driver keeps the tree, which has an entry for each leaf, and sees
at most ``SUMS`` sums in a round, or 16 for each node: with many nodes intervals are fewer and rounds more. Rows find their
node by joins with the cuts of each level, which are broadcast up to ``SMALL`` rows. No row moves until the
leaves are numbered.

Defined results: null metadata come first in their dimension; a null text counts 1 byte, and texts of any length
count whole; null ids are ids like others; repeated rows are placed each; an empty table gives no rows; fewer
rows than shards leave shards empty; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small_table, staged, whole

SLACK = 0.001
#: Sums that the driver sees in a round; intervals of a node's range at most and at least.
SUMS, BINS, FEWEST = 1 << 17, 4096, 16
#: Bits of a coordinate and of the tie breaker below it.
COORD, TIE = 31, 31
#: Bits of the tie breaker that tell repeated rows apart.
REPEAT = 11
#: Rows up to which a counted table is broadcast.
SMALL = 1_000_000


@dataclass
class Node:
    leaves: int
    first: int  # of the leaves; the node's number among those of its level
    bytes: int
    dim: int = -1
    cut: int = 0  # keys below it go left
    left: Node | None = None
    right: Node | None = None


def _numeric(col: Column) -> Column:
    """31 bits that grow with the logarithm of a count."""
    return F.coalesce(F.least(F.log2(F.greatest(col.cast("double"), F.lit(0.0)) + 1) * (1 << 25), F.lit(float((1 << COORD) - 1))).cast("long"), F.lit(0))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _ranked(meta: DataFrame, col: str) -> DataFrame:
    """``col`` replaced by the rank of its value among all distinct ones, from 1 on; null by 0."""
    values = staged(meta.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col).select(col, F.monotonically_increasing_id().alias("place")), "ranks")
    # The place is the number of a range of values and the row in it; ranges are few.
    counts = {r.part: r.n for r in values.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    rank = F.get(F.array(*map(F.lit, before)), F.shiftright("place", 33).cast("int")) + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1 if before else F.lit(1)
    ranks = values.select(F.col(col).alias("value"), rank.cast("long").alias("rank"))
    return meta.join(_small(ranks, total), F.col(col) == F.col("value"), "left").withColumn(col, F.coalesce("rank", F.lit(0)).cast("long")).drop("value", "rank")


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numeric: tuple[str, ...] = ("n_chars",), categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """id_, size, crc, the coordinates c0, c1, ... and tie of every row. Staged."""
    text = whole(text_col)
    coords = [_numeric(F.col(c)) for c in numeric] + [F.col(c).cast("string") for c in categories]
    meta = docs.select(
        F.col(id_col).alias("id_"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        *[c.alias(f"c{k}") for k, c in enumerate(coords)],
    )
    tie = F.pmod(F.xxhash64("id_", "crc", "size"), F.lit(1 << (TIE - REPEAT))) * (1 << REPEAT)
    tie = tie + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << REPEAT))
    meta = staged(meta.withColumn("tie", tie), "shard-texts")
    ranked = meta
    for k in range(len(numeric), len(coords)):
        ranked = _ranked(ranked, f"c{k}")
    return staged(ranked, "shard-meta") if categories else meta


def _key(dims: int) -> Column:
    """The key of a row in the dimension ``dim``."""
    return F.get(F.array(*[F.col(f"c{k}") for k in range(dims)]), F.col("dim")) * (1 << TIE) + F.col("tie")


def _open(tree: Node) -> list[Node]:
    todo, out = [tree], []
    while todo:
        node = todo.pop()
        if node.left is not None:
            todo += [node.right, node.left]
        elif node.leaves > 1:
            out.append(node)
    return out


def _descend(at: DataFrame, dims: int, nodes: list[Node]) -> DataFrame:
    """``at`` with the node of the next level in place of each of ``nodes``."""
    cuts = small_table(at.sparkSession, [(n.first, n.dim, n.cut, n.right.first) for n in nodes], "node int, dim int, cut long, right_ int")
    right = F.col("cut").isNotNull() & (_key(dims) >= F.col("cut"))
    return at.join(_small(cuts, len(nodes)), "node", "left").withColumn("node", F.when(right, F.col("right_")).otherwise(F.col("node"))).drop("dim", "cut", "right_")


def build_tree(meta: DataFrame, dims: int, leaves: int) -> tuple[Node, DataFrame]:
    """The tree, and ``meta`` (size, tie and c0 to c<dims - 1>) with the leaf of each row as ``node``."""
    spread = [x for k in range(dims) for x in (F.min(f"c{k}").alias(f"lo{k}"), F.max(f"c{k}").alias(f"hi{k}"))]
    total = meta.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), *spread).first()
    tree, at, level = Node(leaves, 0, total.bytes), meta.withColumn("node", F.lit(0)), 0
    if not total.bytes:
        return tree, at
    whole_range = [max(1, total[f"hi{k}"] - total[f"lo{k}"]) for k in range(dims)]
    while todo := _open(tree):
        num = {node.first: node for node in todo}
        spans = small_table(at.sparkSession, [(n,) for n in num], "node int")
        rows = {r.node: r for r in at.join(_small(spans, len(num)), "node").groupBy("node").agg(F.sum("size").alias("bytes"), *spread).collect()} if level else {0: total}
        state = {}
        for first, node in num.items():
            if first not in rows:  # no rows: any split will do
                _split(node, 0, 0, 0)
                continue
            r = rows[first]
            dim = max(range(dims), key=lambda k: (r[f"hi{k}"] - r[f"lo{k}"]) / whole_range[k])
            lo, hi = r[f"lo{dim}"] << TIE, (r[f"hi{dim}"] + 1) << TIE
            state[first] = [dim, lo, hi, 0, r.bytes * (node.leaves // 2) / node.leaves]
        while state:
            bins = max(FEWEST, min(BINS, SUMS // len(state)))
            width = {n: max(1, -(-(s[2] - s[1]) // bins)) for n, s in state.items()}
            ranges = small_table(at.sparkSession, [(n, s[0], s[1], s[2], width[n]) for n, s in state.items()], "node int, dim int, lo long, hi long, width long")
            part = at.join(_small(ranges, len(state)), "node").select("node", "size", "lo", "hi", "width", _key(dims).alias("key")).filter("key >= lo and key < hi")
            sums: dict[int, list] = {}
            for r in part.groupBy("node", F.expr("(key - lo) div width").alias("bin")).agg(F.sum("size").alias("bytes")).collect():
                sums.setdefault(r.node, []).append((r.bin, r.bytes))
            for n, (dim, lo, hi, below, want) in list(state.items()):
                w = width[n]
                for b, got in sorted(sums[n]):
                    if below + got >= want:
                        break
                    below += got
                lo, hi = lo + b * w, min(hi, lo + (b + 1) * w)
                state[n][1:4] = lo, hi, below
                if w == 1 or got <= SLACK * total.bytes / leaves:
                    near = hi if below + got - want <= want - below else lo
                    _split(num[n], dim, near, below + (got if near == hi else 0))
                    del state[n]
        at, level = _descend(at, dims, todo), level + 1
        if level % 4 == 0:
            at = staged(at, "shard-nodes")  # keeps the plan short
    return tree, at


def _split(node: Node, dim: int, cut: int, left_bytes: int) -> None:
    half = node.leaves // 2
    node.dim, node.cut = dim, cut
    node.left, node.right = Node(half, node.first, left_bytes), Node(node.leaves - half, node.first + half, node.bytes - left_bytes)


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", numeric: tuple[str, ...] = ("n_chars",), categories: tuple[str, ...] = ("lang", "source"), bucket_rows: int = 50_000) -> DataFrame:
    """<id_col>, size, text_crc32, shard, slot of every row; slots are gapless from 0 in each shard.

    Give the number of shards, or the bytes that a shard should have.
    """
    meta = metadata(docs, id_col, text_col, numeric, categories)
    if shards is None:
        total = meta.agg(F.sum("size")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    _, placed = build_tree(meta, len(numeric) + len(categories), shards)
    placed = placed.select("id_", "size", "crc", "tie", F.col("node").alias("shard"))

    # Slots: rows are numbered in buckets of about bucket_rows, and bucket counts are summed up before them.
    n = meta.count()
    buckets = max(1, min(4096, math.ceil(n / shards / bucket_rows)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("tie"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id_", "crc", "size")
    slot = placed.withColumn("nth", F.row_number().over(inside)).join(_small(start, shards * buckets), ["shard", "bucket"])
    return slot.select(F.col("id_").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"))

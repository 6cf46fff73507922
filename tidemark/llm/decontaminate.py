"""Benchmark decontamination in SQL functions: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Words are lower-cased runs of letters and digits; shingles have five words (an item of fewer words
is one shingle of its own length). A window has as many shingles as the item it is held against, or all that
the text has. Item and window match if the weighted Jaccard similarity of their shingles, each weighing its
number of repeats, is at least ``THRESHOLD``.

1. One pass over the texts. A bitmap of all items' shingles, and of these with their items' sizes, marks the
   positions of a text that may hold one, and one of an item of some size. A window with similarity t to an item has at least t (a + b) / (1 + t) positions with shingles of it, a and
   b being their numbers of shingles; so for each size that items have, only windows with that many marked
   positions are fingerprinted, which loses none that can match. Of a run of such windows every ``m / GRID``-th
   start is taken (all of them for items of under 2 ``GRID`` shingles): a window that matches lies no further
   than two steps from one that is taken. What leaves the pass is small: 64-bit SimHashes of windows,
   and marked positions with their shingles; texts do not move.
2. With ``RADIUS`` + 1 disjoint blocks of bits, fingerprints within the radius agree in a block; the join on
   (size, block, bits) with the items' fingerprints yields all such pairs, and so which item a window is held to.
3. The pairs of rows and items that are left are held to the exact similarity, at all starts at once: a shingle at
   position i counts in windows from its c-th occurrence back (c: its repeats in the item) or i - m + 1 up to i, so
   the weighted intersections of all windows are running sums over two events for each position.

The radius is wide: a similarity of 0.8 between many different shingles differs in 10 bits of 64 on average, and
shifted windows in 12. The farthest of such pairs lie beyond ``RADIUS``, but windows next to a
match that are tried too rarely all do; tests hold the whole to brute force
by length of item, with very short and with repetitive ones.

The bitmap has about ``BITS`` bits a shingle and 64 MB at most; beyond that more positions are marked, and none is lost.
Benchmark tables are broadcast only after their rows were counted (``SMALL``); larger ones are joined by shuffles.

Defined results: null or empty items and texts match nothing; equal items are matched each, those of one id or without an id told
as one; items of any length are matched; an empty table on either side gives no match; rows are compared one by one, so those repeated
with one id, or without an id, do not mix; the results of ``contaminated`` are then told by id, null ids as one;
``decontaminate`` tells rows apart by id and text, so only rows that themselves hold an item go; further
columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged, unused, whole
from tidemark.llm.exact_dedup import content_hash

SHINGLE, THRESHOLD, RADIUS, GRID = 5, 0.8, 23, 32
#: Rows up to which a counted table is broadcast; shingles that a 16-bit lane of a counter can hold.
SMALL, LANE = 200_000, 32_767
#: Bits of the bitmap for each shingle, and its largest size as a power of two.
BITS, MOST = 32, 29


def words_of(text: str | Column) -> Column:
    bare = F.trim(F.regexp_replace(F.lower(whole(text)), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(bare, " "), lambda w: w != "")


def shingles_of(words: Column, k: int) -> Column:
    """Hashes of the runs of k words; none if there are fewer. Words are taken one by one: slice() copies the whole array."""
    n = F.size(words) - (k - 1)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column, n: Column, wide: bool = False) -> Column:
    """64 bits, each set if it is set in over half of the n hashes; counted in lanes of 16 bits, or 32 if ``wide``."""
    lane, lanes = (32, 2) if wide else (16, 4)
    mask = sum(1 << (lane * x) for x in range(lanes))
    out = F.lit(0).cast("bigint")
    for j in range(lane):
        sums = F.aggregate(shingles, F.lit(0).cast("bigint"), lambda acc, h: acc + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(mask)))  # noqa: B023
        over = lambda s, x: F.shiftrightunsigned(s, lane * x).bitwiseAND(F.lit((1 << lane) - 1)) * 2 > n
        bit = lambda s, x: F.when(over(s, x), F.shiftleft(F.lit(1).cast("bigint"), lane * x + j)).otherwise(F.lit(0).cast("bigint"))  # noqa: B023, E731

        def bits(s):
            made = bit(s, 0)  # noqa: B023
            for x in range(1, lanes):
                made = made.bitwiseOR(bit(s, x))  # noqa: B023
            return made

        out = out.bitwiseOR(F.transform(F.array(sums), bits)[0])
    return out


def _blocks(radius: int) -> list[tuple[int, int]]:
    """Offset and width in bits of each of radius + 1 disjoint blocks."""
    n, at, out = radius + 1, 0, []
    for k in range(n):
        wide = 64 // n + (k < 64 % n)
        out.append((at, wide))
        at += wide
    return out


def block_values(fp: Column, radius: int = RADIUS) -> Column:
    """The bits of each block."""
    return F.array(*[F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << wide) - 1)) for at, wide in _blocks(radius)])


def _items(benchmark: DataFrame, k: int, exact: bool) -> DataFrame:
    """item_ (a number of its own), item_id, m, sh of the items whose shingles have k words."""
    words = benchmark.select("item_id", words_of("text").alias("w"))
    words = words.filter(F.size("w") == k if exact else F.size("w") >= k)
    return staged(words.select("item_id", shingles_of(F.col("w"), k).alias("sh")).select(F.monotonically_increasing_id().alias("item_"), "item_id", F.size("sh").alias("m"), "sh"), "items")


def _places(h: Column, words: int) -> list[tuple[Column, Column]]:
    """Word and bit of the two marks of a hash in a bitmap of so many words (a power of two)."""
    at = lambda by: F.shiftrightunsigned(h, by).bitwiseAND(F.lit(words - 1)).cast("int")
    return [(at(34), h.bitwiseAND(F.lit(63)).cast("int")), (at(12), F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(63)).cast("int"))]


def _marked(h: Column, words: int) -> Column:
    """Whether the bitmap may hold a hash; the second mark is looked at only if the first one is there."""
    hit = [F.call_function("shiftrightunsigned", F.get("bitmap", word), bit).bitwiseAND(F.lit(1)) == 1 for word, bit in _places(h, words)]
    return F.when(hit[0], hit[1]).otherwise(F.lit(False))


def _bitmap(shingles: DataFrame, words: int) -> DataFrame:
    """One row, bitmap: array<long> with the marks of all hashes."""
    marks = F.array(*[F.struct(word.alias("word"), bit.alias("bit")) for word, bit in _places(F.col("h"), words)])
    found = shingles.select(F.inline(marks)).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    every = shingles.sparkSession.range(words).select(F.col("id").cast("int").alias("word")).join(found, "word", "left").select("word", F.coalesce("mask", F.lit(0)).alias("mask"))
    row = every.agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("all"))
    return row.select(F.transform("all", lambda x: x["mask"]).alias("bitmap"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, item_id, similarity, windows: each document and item with a window that matches, and how many do."""
    docs = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    benchmark = benchmark.select("item_id", "text")
    lengths = {r[0] for r in benchmark.select(F.least(F.size(words_of("text")), F.lit(SHINGLE))).distinct().collect()} - {0}
    found = [_matches(docs, _items(benchmark, k, k < SHINGLE), k, threshold, radius) for k in sorted(lengths)]
    if not found:
        kind = benchmark.schema["item_id"].dataType
        return docs.select(F.col("id_").alias(id_col), F.lit(None).cast(kind).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("bigint").alias("windows")).filter(F.lit(False))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("id_", id_col)


def _fingerprinted(docs: DataFrame, items: DataFrame, k: int, threshold: float, most: int, shingles: int) -> DataFrame:
    """row_, id_, n, hits array<struct<pos, h>>, wins array<struct<m, fp>> of the rows with a window to look at.

    The row number, which is not deterministic, also keeps the optimizer from pushing conditions on what was
    computed below the place where it is computed, which would compute it twice.
    """
    size = 1 << min(MOST, max(10, (BITS * shingles - 1).bit_length())) - 6
    of = items.select("m", F.explode("sh").alias("h"))
    bitmap = _bitmap(of.select(F.explode(F.array("h", F.xxhash64("h", "m"))).alias("h")).distinct(), size)
    sizes = items.agg(F.array_sort(F.collect_set("m")).alias("sizes"))
    known = F.broadcast(staged(bitmap.crossJoin(sizes), "known"))  # one row of a bounded size
    need_of = lambda m, n: F.ceil(F.lit(threshold / (1 + threshold)) * (m + F.least(m, n)) - 1e-9).cast("int")

    words = docs.select(F.monotonically_increasing_id().alias("row_"), "id_", words_of("text_").alias("w"))
    rows = words.select("row_", "id_", F.when(F.col("row_") >= 0, shingles_of(F.col("w"), k)).alias("sh")).crossJoin(known)
    enough = need_of(F.get("sizes", F.lit(0)), F.col("n"))  # marks, for the smallest item
    rows = rows.select("*", F.size("sh").alias("n"), F.size(F.filter("sh", lambda h: _marked(h, size))).alias("marks"), F.monotonically_increasing_id().alias("again_"))
    rows = rows.filter((F.col("again_") >= 0) & (F.col("marks") >= F.greatest(enough, F.lit(1))))
    places = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: _marked(F.get("sh", i), size))
    rows = rows.select("row_", "id_", "sh", "bitmap", "sizes", "n", places.alias("p"), F.monotonically_increasing_id().alias("still_")).filter("still_ >= 0")

    def starts(m: Column, p: Column) -> Column:
        """Starts of windows of m shingles, given the positions marked for that size."""
        wide, need = F.least(m, F.col("n")), need_of(m, F.col("n"))
        step, last = F.greatest(F.floor(m / GRID).cast("int"), F.lit(1)), F.col("n") - wide
        lo = lambda x, j: F.greatest(F.lit(0), F.get(p, j + need - 1) - wide + 1)
        hi = lambda x: F.least(last, x)
        grid = lambda c: F.floor(c / step).cast("int")
        runs = F.transform(
            p,
            lambda x, j: F.when((j + need <= F.size(p)) & (F.get(p, j + need - 1) - x < wide) & (lo(x, j) <= hi(x)), F.sequence(grid(lo(x, j)), grid(hi(x)))).otherwise(F.array().cast("array<int>")),
        )
        return F.transform(F.array_distinct(F.flatten(runs)), lambda g: F.struct(m.alias("m"), F.least(g * step, last).alias("start")))

    fits = F.filter("sizes", lambda m: F.size("p") >= need_of(m, F.col("n")))
    marks = F.transform(fits, lambda m: F.struct(m.alias("m"), F.filter("p", lambda i: _marked(F.xxhash64(F.get("sh", i), m), size)).alias("p")))
    rows = rows.select("*", F.flatten(F.transform(marks, lambda x: starts(x["m"], x["p"]))).alias("at"), F.monotonically_increasing_id().alias("more_"))
    rows = rows.filter((F.col("more_") >= 0) & (F.size("at") > 0))
    cut = lambda w: F.array(F.slice("sh", w["start"] + 1, w["m"]))  # noqa: E731  in an array of its own, so as to be cut once
    prints = F.transform("at", lambda w: F.struct(w["m"].alias("m"), w["start"].alias("start"), F.transform(cut(w), lambda s: simhash(s, F.size(s), most > LANE))[0].alias("fp")))
    hits = F.transform("p", lambda i: F.struct(i.alias("pos"), F.get("sh", i).alias("h")))
    return staged(rows.select("row_", "id_", "n", hits.alias("hits"), prints.alias("wins")), "windows")


def _matches(docs: DataFrame, items: DataFrame, k: int, threshold: float, radius: int) -> DataFrame:
    size = items.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("shingles"), F.coalesce(F.max("m"), F.lit(0)).alias("most")).first()
    small = (lambda df: F.broadcast(df)) if size.shingles <= SMALL else (lambda df: df)
    rows = _fingerprinted(docs, items, k, threshold, size.most, size.shingles)

    # All pairs of fingerprints within the radius.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows = rows.select("row_", F.inline("wins")).repartition(parts, "row_", "m", "start")  # a given number is not coalesced: the work is in the rows, not in their bytes
    windows = windows.select("row_", "m", "fp", F.posexplode(block_values(F.col("fp"), radius)).alias("block", "bits"))
    other = items.select("item_", "m", simhash(F.col("sh"), F.col("m"), size.most > LANE).alias("item_fp"))
    other = other.select("item_", "m", "item_fp", F.posexplode(block_values(F.col("item_fp"), radius)).alias("block", "bits"))
    differing = F.col("fp").bitwiseXOR(F.col("item_fp"))
    pairs = windows.join(small(other), ["m", "block", "bits"]).filter(F.bit_count(differing) <= radius)
    pairs = staged(pairs.select("row_", "item_", "m").distinct(), "pairs")

    # Exact similarities of all windows of these pairs, as running sums.
    repeats = items.select("item_", F.explode("sh").alias("h")).groupBy("item_", "h").agg(F.count(F.lit(1)).cast("int").alias("c"))
    hits = pairs.join(rows.select("row_", "id_", "n", "hits"), "row_").select("row_", "id_", "item_", "m", "n", F.inline("hits"))
    lists = hits.join(small(repeats), ["item_", "h"]).groupBy("row_", "id_", "item_", "m", "n", "h", "c").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    wide = F.least("m", "n")
    lists = lists.withColumn("wide", wide).withColumn("last", F.col("n") - F.col("wide"))
    before = lambda j: F.when(j >= F.col("c"), F.get("p", F.greatest(j - F.col("c"), F.lit(0))) + 1).otherwise(F.lit(0))
    spans = F.transform("p", lambda x, j: F.struct(F.greatest(x - F.col("wide") + 1, before(j), F.lit(0)).alias("lo"), F.least(x, F.col("last")).alias("hi")))
    spans = F.filter(spans, lambda s: s["lo"] <= s["hi"])
    events = F.flatten(F.transform(spans, lambda s: F.array(F.struct(s["lo"].alias("at"), F.lit(1).alias("more")), F.struct((s["hi"] + 1).alias("at"), F.lit(-1).alias("more")))))
    key = ["row_", "id_", "item_", "m", "wide", "last"]
    steps = lists.select(*key, F.inline(events)).groupBy(*key, "at").agg(F.sum("more").alias("more"))
    order = Window.partitionBy("row_", "item_").orderBy("at")
    told = steps.select(*key, "at", F.sum("more").over(order).alias("both"), F.lead("at").over(order).alias("until"))
    told = told.withColumn("similarity", F.col("both") / (F.col("m") + F.col("wide") - F.col("both"))).filter((F.col("similarity") >= threshold) & (F.col("at") <= F.col("last")))
    told = told.join(small(items.select("item_", "item_id")), "item_")
    return told.groupBy("id_", "item_id").agg(F.max("similarity").alias("similarity"), F.sum(F.col("until") - F.col("at")).alias("windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without a match, with all their columns. Rows are told apart by their id and the digest of their text."""
    digest, bad_id, mark = unused(docs, "digest"), unused(docs, "bad"), unused(docs, "mark")
    hashed = content_hash(whole(text_col))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), hashed.alias("digest")).alias("row"), F.col(text_col).alias("text"))
    found = contaminated(rows, benchmark, threshold, id_col="row", text_col="text")
    found = staged(found.select(F.col("row")["id"].alias(bad_id), F.col("row")["digest"].alias(mark)).distinct(), "contaminated")
    bad = F.broadcast(found) if found.count() <= SMALL else found
    same = F.col(id_col).eqNullSafe(F.col(bad_id)) & (F.col(digest) == F.col(mark))
    return docs.withColumn(digest, hashed).join(bad, same, "left_anti").drop(digest)

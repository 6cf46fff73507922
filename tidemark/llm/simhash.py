"""SimHash near-dedup over an inverted index of byte positions with count filtering.

A fingerprint is eight bytes. Two fingerprints within ``RADIUS`` = 2 bits differ in two bytes at
most, so they share at least ``MIN_SHARED`` = 6 positional bytes. The posting list of a single
(position, byte) would hold 1/256 of all rows, so the index has a list for each set of six positions and
their bytes (28 sets): two fingerprints stand together in as many lists as they share six bytes, that is in
1, 7 or 28 for 6, 7 or 8 shared bytes. These common lists are counted for each pair, pairs below the
guaranteed minimum are dropped, and the Hamming distance is verified.

Copies with one fingerprint are one node from the start, so a list leaves two bytes open and holds 65,536
nodes at most. Two nodes within two bits agree in two of the four half bytes that are open, so each list is
dealt to parts of 256 nodes at most by two half bytes, and only nodes of one part are paired up. A node has
a bounded number of partners within two bits, whatever the size of the table.

Components come from alternating large and small stars, each round staged in the shared folder.

``near_dedup``, the stage of the pipeline, finds copies that are further apart than two of 64 bits. There a fingerprint
has 64 bytes and is taken over the distinct words of a text; the lists are those of ``WIDE_KEYS`` sets of
``WIDE_BYTES`` positions. The positional bytes that a pair of a list shares are counted, over all 64 positions; pairs
below ``WIDE_SHARED`` = 8 are dropped, and the Hamming distance is verified to be ``WIDE_RADIUS`` = 128 of 512 bits at
most. What is left has an exact check to pass: the cosine of the sets of five-word shingles, which is the similarity that
SimHash stands for, has to be ``SIMILAR`` = 0.8 or more. A pair that shares 7 bytes stands in a common list once in 200
times, so the minimum costs next to nothing beside the index. README has the share of all pairs of 0.8 or more
that is found, against brute force. Of a list, each node is first
held to the least one; then, in lists that still have several components, nodes outside the largest one to all nodes
of others, within tasks of at most two parts of ``TOGETHER`` shingles, which give only links between components. So a
list of copies of one text costs work in proportion to its length, its pairs never become rows, and none is left
undecided; many texts that share bytes but are no copies cost comparisons of each with all.

Defined results: a null or blank text has fingerprint zero and links like any other; null ids group
with the rest and are never the smallest id unless all are null; repeated rows come back repeated (``near_dedup``
keeps one); texts of any length are read whole, in pieces; an empty table gives no rows; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import random
import string
from hashlib import blake2b
from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, ids_repeat, map_batches, staged, unused, whole
from tidemark.llm.exact_dedup import content_hash

SEED, SHINGLE, RADIUS, MIN_SHARED = 42, 3, 2, 6
#: The stage: bytes of a fingerprint, sets of positions and their size, words of a shingle, least cosine.
WIDE, WIDE_KEYS, WIDE_BYTES, WIDE_SHINGLE, SIMILAR = 64, 80, 4, 5, 0.8
#: The stage: least number of positional bytes that a pair shares, and most bits in which it differs.
WIDE_SHARED, WIDE_RADIUS = 8, 128
#: The stage: shingles of a list that one task compares; longer lists are dealt to pairs of parts.
TOGETHER = 250_000
#: Rows up to which a counted table is broadcast.
SMALL = 200_000
#: Shingles whose bits are counted at a time.
CHUNK = 65536


def fingerprint(text: str | None) -> int:
    """Unsigned 64 bits; a bit is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(join, zip(words, words[1:], words[2:], strict=False)) if len(words) >= SHINGLE else iter([join(words)])
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        k = min(CHUNK, n - at)
        digests = np.fromiter((h(next(shingles), SEED) for _ in range(k)), np.uint64, k)
        counts += np.unpackbits(digests.astype(">u8").view(np.uint8).reshape(k, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """<id_col>, fp (the fingerprint as a signed long) and more columns as they are."""
    schema = ", ".join([f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}", "fp bigint", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in more)])

    def run(cols):
        return [cols[0], [_signed(fingerprint(t)) for t in cols[1]], *cols[2:]]

    return map_batches(docs.select(id_col, text_col, *more), run, schema)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def _sets() -> list[tuple[int, tuple[int, ...]]]:
    """For each set of six positions the mask of its bytes, and the offsets of the four half bytes beside it."""
    out = []
    for at in combinations(range(8), MIN_SHARED):
        mask = sum(0xFF << (8 * k) for k in at)
        out.append((_signed(mask), tuple(8 * k + half for k in range(8) if k not in at for half in (0, 4))))
    return out


def links(nodes: DataFrame) -> DataFrame:
    """Verified links between distinct fingerprints: a > b, shared (positional bytes)."""
    sets = _sets()
    postings = nodes.select("fp", F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col("fp").bitwiseAND(F.lit(mask)).alias("val")) for k, (mask, _) in enumerate(sets)])))
    lists = staged(postings.groupBy("key", "val").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "val"), "lists")
    shared = postings.join(_small(lists), ["key", "val"])

    def half(which: int) -> Column:
        offset = F.element_at(F.array(*[F.lit(halves[which]) for _, halves in sets]), F.col("key") + 1)
        return F.call_function("shiftrightunsigned", F.col("fp"), offset).bitwiseAND(F.lit(15))

    halves = F.array(*[F.struct(F.lit(4 * i + j).alias("which"), (half(i) * 16 + half(j)).alias("bits")) for i, j in combinations(range(4), 2)])
    parts = shared.select("key", "val", "fp", F.inline(halves)).groupBy("key", "val", "which", "bits").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = F.transform("fps", lambda x: F.struct(x.alias("a"), F.filter("fps", lambda y: y < x).alias("bs")))
    pairs = parts.select("key", F.inline(stars)).select("key", "a", F.explode("bs").alias("b")).distinct()

    common = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common")).filter(F.col("common") >= comb(MIN_SHARED, MIN_SHARED))
    close = common.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    told = F.when(F.col("common") >= comb(8, MIN_SHARED), 8).when(F.col("common") >= comb(7, MIN_SHARED), 7).otherwise(MIN_SHARED)
    return close.select("a", "b", told.alias("shared"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: for each node of a link the smallest node that it reaches."""
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(b, a) as decimal(20, 0)))")).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.filter("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, now = now, staged(small.filter("a <> b").distinct(), "small-star")
        discard(before, large)  # what came of a round stands on its own
    raise RuntimeError(f"the components did not settle in {rounds} rounds")


def label_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: <id_col>, fp, component_id."""
    rows = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))).alias("least")), "nodes")
    roots = components(links(nodes).select("a", "b"))
    member = staged(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "members")
    first = member.groupBy("root").agg(F.min("least")["id"].alias("component_id"))
    return rows.join(member.join(first, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


# ---- copies further apart ----


def _design() -> np.ndarray:
    """The sets of positions: random divisions of all positions, so that few sets share more than one."""
    rng, out = random.Random(SEED), []
    while len(out) < WIDE_KEYS:
        order = rng.sample(range(WIDE), WIDE)
        out += [order[k : k + WIDE_BYTES] for k in range(0, WIDE, WIDE_BYTES)]
    return np.array(out[:WIDE_KEYS])


def wide_fingerprint(text: str | None, known: dict[bytes, bytes]) -> np.ndarray:
    """64 bytes; a bit is set if it is set in over half of the hashes of the distinct words. ``known`` keeps hashes."""
    words = list({*(text or "").encode("utf-8", "surrogatepass").lower().split()})
    counts = np.zeros(8 * WIDE, np.int64)
    for at in range(0, len(words), 8192):
        digests = []
        for w in words[at : at + 8192]:
            d = known.get(w)
            if d is None:
                d = blake2b(w, digest_size=WIDE).digest()
                if len(w) <= 32:
                    if len(known) >= 20_000:
                        known.clear()
                    known[w] = d
            digests.append(d)
        counts += np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, WIDE), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(words))


def _wide_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest (of the text), fp (the fingerprint as eight longs) and keys (the bytes of each set of positions) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), content_hash(whole(text_col)).alias("digest"), F.col(text_col).alias("text"))
    sets, known = _design(), {}

    def run(cols):
        prints = [wide_fingerprint(t, known) for t in cols[2]]
        return [cols[0], cols[1], [p.view("<i8") for p in prints], [np.ascontiguousarray(p[sets]).view("<i4").ravel() for p in prints]]

    return map_batches(rows, run, f"id {docs.schema[id_col].dataType.simpleString()}, digest binary, fp array<bigint>, keys array<int>")


def _shingle_sets(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """node, sh: hashes of the distinct shingles of each node's text; a text of fewer words is one shingle."""
    rows = docs.select(content_hash(whole(text_col)).alias("digest"), whole(text_col).alias("text"))
    texts = rows.join(_small(nodes), "digest").groupBy("node").agg(F.first("text").alias("text"))
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("w") - (WIDE_SHINGLE - 1)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(WIDE_SHINGLE)]))
    made = texts.select("node", words.alias("w"), F.monotonically_increasing_id().alias("row")).filter("row >= 0")
    return staged(made.select("node", F.array_distinct(F.when(n > 0, runs).otherwise(F.array(F.xxhash64(F.array_join("w", " "))))).alias("sh")), "shingle-sets")


def _unlike(x: Column) -> Column:
    """How many of the eight bytes are not zero."""
    for by, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
        x = x.bitwiseOR(F.call_function("shiftrightunsigned", x, F.lit(by))).bitwiseAND(F.lit(mask))
    return F.bit_count(x)


def close_prints(pairs: DataFrame, prints: DataFrame, shared: int, radius: int) -> DataFrame:
    """The pairs a, b that share at least ``shared`` positional bytes and differ in ``radius`` bits at most."""
    a, b = prints.select(F.col("node").alias("a"), F.col("fp").alias("a_fp")), prints.select(F.col("node").alias("b"), F.col("fp").alias("b_fp"))

    def total(of) -> Column:
        return F.aggregate(F.zip_with("a_fp", "b_fp", lambda x, y: of(x.bitwiseXOR(y))), F.lit(0), lambda have, x: have + x)

    common = pairs.join(a, "a").join(b, "b").filter(WIDE - total(_unlike) >= shared)
    return common.filter(total(F.bit_count) <= radius).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose sets of shingles have a cosine of at least ``least``."""
    a, b = sets.select(F.col("node").alias("a"), F.col("sh").alias("a_sh")), sets.select(F.col("node").alias("b"), F.col("sh").alias("b_sh"))
    both = F.size(F.array_intersect("a_sh", "b_sh"))
    return pairs.join(a, "a").join(b, "b").filter(both >= least * F.sqrt(F.size("a_sh") * F.size("b_sh").cast("double")) - 1e-9).select("a", "b")


def similar_nodes(docs: DataFrame, nodes: DataFrame, text_col: str, least: float, shared_bytes: int = WIDE_SHARED, radius: int = WIDE_RADIUS) -> DataFrame:
    """node, root for the nodes (node, digest, fp, keys) that have a similar one."""
    prints = nodes.select("node", "fp")
    postings = nodes.select("node", F.posexplode("keys").alias("key", "val"))
    lists = staged(postings.groupBy("key", "val").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("center")).filter("n > 1").select("key", "val", "center"), "lists")
    shared = staged(postings.join(_small(lists), ["key", "val"]), "postings")
    sets = _shingle_sets(docs, nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "digest"), text_col)

    # Each node against the least one of its lists.
    stars = shared.filter("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    near = staged(_similar(close_prints(stars, prints, shared_bytes, radius), sets, least), "near")
    roots = components(near)

    # In lists of several components, nodes outside the largest one against all nodes of others.
    placed = staged(shared.join(roots, "node", "left").select("key", "val", "node", F.coalesce("root", "node").alias("root")), "placed")
    open_ = placed.groupBy("key", "val").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("n > 2 and lo <> hi").select("key", "val")
    rows = staged(placed.join(open_, ["key", "val"]).join(sets.join(prints, "node"), "node"), "open")
    sizes = rows.groupBy("key", "val").agg(F.ceil(F.sum(F.size("sh")) / TOGETHER).cast("int").alias("parts"))
    dealt = rows.join(sizes, ["key", "val"]).withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    alone = dealt.filter("parts = 1").withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0))
    beside = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    split = dealt.filter("parts > 1").select("*", beside.alias("other")).withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).drop("other")
    groups = alone.unionByName(split).groupBy("key", "val", "lo", "hi").agg(F.collect_list(F.struct("node", "root", "fp", "sh")).alias("members"))
    # Python takes one group at a time: the arrays of a batch are bounded by its groups, and these by TOGETHER.
    more = staged(groups.select("members").mapInArrow(_links_of_groups(shared_bytes, radius, least), "a long, b long").distinct(), "more")
    return components(near.unionByName(more))


def links_between(nodes: np.ndarray, roots: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], shared: int, radius: int, least: float) -> list[tuple[int, int]]:
    """Links between nodes of different components, one for each node and component.

    The fingerprints (rows of bytes) share ``shared`` positional bytes or more and differ in ``radius`` bits at most,
    and the cosine of the sets is at least ``least``.
    """
    every, largest = np.unique(roots, return_counts=True)
    main = every[largest.argmax()]
    sizes = np.array([len(x) for x in sets])
    owner, shingle = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(shingle, kind="stable")
    owner, shingle = owner[order], shingle[order]
    out = {}
    for k in np.flatnonzero(roots != main):
        others = np.flatnonzero(roots != roots[k])
        unlike = prints[others] ^ prints[k]
        common = (unlike == 0).sum(axis=1) >= shared
        others, unlike = others[common], unlike[common]
        others = others[np.bitwise_count(unlike).sum(axis=1, dtype=np.int64) <= radius]
        if not len(others):
            continue
        lo, hi = np.searchsorted(shingle, sets[k], "left"), np.searchsorted(shingle, sets[k], "right")
        wide = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(wide)[:-1]]), wide) + np.arange(wide.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for x in others[both[others] >= least * np.sqrt(sizes[others] * float(sizes[k])) - 1e-9]:
            out.setdefault((nodes[k], roots[x]), (int(nodes[k]), int(nodes[x])))
    return [*out.values()]


def _links_of_groups(shared: int, radius: int, least: float):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for members in batch.column(0):  # one list at a time
                flat = members.values
                sets, prints = flat.field("sh"), flat.field("fp").flatten().to_numpy()
                ends, values = sets.offsets.to_numpy(), sets.values.to_numpy()
                prints = np.ascontiguousarray(prints).view(np.uint8).reshape(-1, WIDE)
                found = links_between(flat.field("node").to_numpy(), flat.field("root").to_numpy(), prints, [values[a:b] for a, b in zip(ends, ends[1:])], shared, radius, least)
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, shared: int = WIDE_SHARED, radius: int = WIDE_RADIUS) -> DataFrame:
    """One row of each component, that with its smallest id, with all its columns.

    Rows are named by their id and the digest of their text, so rows without an id, or with different
    texts under one id, are told apart; of rows that agree in both one is kept.
    """
    digest, keep, mark = unused(docs, "digest"), unused(docs, "keep"), unused(docs, "mark")
    rows = staged(_wide_keys(docs, id_col, text_col), "fingerprints")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("least")
    nodes = staged(rows.groupBy("digest").agg(least, F.first("fp").alias("fp"), F.first("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = similar_nodes(docs, nodes.select("node", "digest", "fp", "keys"), text_col, similar, shared, radius)
    member = nodes.select("node", "least").join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    first = member.groupBy("root").agg(F.min("least").alias("least"))
    stay = staged(first.select(F.col("least")["id"].alias(keep), F.col("least")["digest"].alias(mark)), "stay")
    docs = docs.withColumn(digest, content_hash(whole(text_col)))
    found = docs.join(stay, F.col(id_col).eqNullSafe(F.col(keep)) & (F.col(digest) == F.col(mark)), "left_semi")
    if ids_repeat(rows, "id"):
        found = found.dropDuplicates([id_col, digest])
    return found.drop(digest)

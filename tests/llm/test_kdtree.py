"""Sharding against a tree that is built row by row."""

import random

from pyspark.sql import functions as F

from tidemark.llm import kdtree


def tree_by_rows(rows, dims, leaves, first, whole, out):
    """rows: (size, tie, coordinates, name). Leaves by name, split where a cut between two keys comes closest to the share."""
    if leaves == 1 or not rows:
        for r in rows:
            out[r[3]] = first
        return
    spread = [(max(r[2][k] for r in rows) - min(r[2][k] for r in rows)) / whole[k] for k in range(dims)]
    dim = max(range(dims), key=lambda k: spread[k])
    rows = sorted(rows, key=lambda r: (r[2][dim], r[1]))
    want, below, at = sum(r[0] for r in rows) * (leaves // 2) / leaves, 0, 0
    while below + rows[at][0] < want:
        below += rows[at][0]
        at += 1
    at += below + rows[at][0] - want <= want - below
    tree_by_rows(rows[:at], dims, leaves // 2, first, whole, out)
    tree_by_rows(rows[at:], dims, leaves - leaves // 2, first + leaves // 2, whole, out)


def documents(spark, n, seed):
    rng = random.Random(seed)
    names = [f"https://www.example.com/section/{k:03}/page" for k in range(60)]
    rows = []
    for k in range(n):
        text = "w" * rng.choice([rng.randrange(300), 40, 4000])
        source = "https://www.example.com/hot" if rng.random() < 0.34 else rng.choice([None, *names])
        rows.append((k, text, rng.choice(["en", "en", "de", None]), source, len(text) if rng.random() < 0.95 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_tree_by_rows(spark):
    for shards, seed in ((16, 1), (7, 2), (300, 3)):
        meta = kdtree.metadata(documents(spark, 900, seed))
        rows = [(r.size, r.tie, (r.c0, r.c1, r.c2), r.id_) for r in meta.collect()]
        whole = [max(1, max(r[2][k] for r in rows) - min(r[2][k] for r in rows)) for k in range(3)]
        want: dict = {}
        tree_by_rows(rows, 3, shards, 0, whole, want)
        _, placed = kdtree.build_tree(meta, 3, shards)
        assert {r.id_: r.node for r in placed.collect()} == want


def test_few_sums_give_the_same_tree(spark, monkeypatch):
    meta = kdtree.metadata(documents(spark, 500, 4))
    node = lambda: {r.id_: r.node for r in kdtree.build_tree(meta, 3, 8)[1].collect()}
    many = node()
    monkeypatch.setattr(kdtree, "SUMS", 1)
    monkeypatch.setattr(kdtree, "SMALL", 0)  # and joins that are not broadcast
    assert node() == many


def test_names_keep_their_order(spark):
    names = [None, "", "a", "aaaa", "aaab", "https://x/1", "https://x/2", "Ü", "é"]
    docs = spark.createDataFrame([(k, "t", n, n, 1) for k, n in enumerate(names + names)], "doc_id long, text string, lang string, source string, n_chars long")
    rank = {r.id_: r.c2 for r in kdtree.metadata(docs).collect()}
    order = sorted(range(len(names)), key=lambda k: (names[k] is not None, (names[k] or "").encode()))
    assert [rank[k] for k in order] == list(range(len(names))) and all(rank[k] == rank[k + len(names)] for k in range(len(names)))


def test_odd_rows(spark):
    docs = documents(spark, 40, 5).unionByName(spark.createDataFrame([(None, None, None, None, None)] * 30, "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.withColumns({c: F.lit(7) for c in ("node", "dim", "tie", "size", "value", "c0", "id_")})
    for given in ({"shards": 200}, {"target_bytes": 5_000}, {"shards": 1}):
        rows = kdtree.kd_shards(docs, **given).collect()
        assert len(rows) == 70 and rows[0].asDict().keys() == {"doc_id", "size", "text_crc32", "shard", "slot"}
        for shard in {r.shard for r in rows}:
            slots = sorted(r.slot for r in rows if r.shard == shard)
            assert slots == list(range(len(slots)))
    assert kdtree.kd_shards(docs.limit(0), shards=4).count() == 0

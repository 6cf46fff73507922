"""The pipeline against a brute-force version of its stages, over all documents and pairs."""

import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tests.llm.test_corpus import shingle_cosine
from tests.llm.test_decontaminate import sliding, words
from tests.llm.test_quality import by_definition
from tidemark.llm import quality
from tidemark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_pipeline_by_brute_force(spark):
    from zlib import crc32

    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = sorted(docs)
    x = np.array([quality.statistics(docs[i]) for i in ids])
    fit = [k for k, i in enumerate(ids) if i in labels and crc32(str(i).encode()) % 3 != 1]
    score = by_definition(x[fit], np.array([labels[ids[k]] for k in fit]), x)
    left = {i: docs[i] for i, s in zip(ids, score, strict=True) if s >= 0.5}

    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
    left = {i: left[i] for i in first.values()}

    # All pairs with a common shingle; pairs without one have a cosine of zero.
    held = defaultdict(set)
    for i, t in left.items():
        w = t.lower().split()
        for k in range(max(1, len(w) - 4)):
            held[tuple(w[k : k + 5])].add(i)
    pairs = {(a, b) for found in held.values() for a in found for b in found if a < b}
    root = {i: i for i in left}
    for a, b in pairs:
        if root[a] != root[b] and shingle_cosine(left[a], left[b]) >= 0.8 - 1e-9:
            lo, hi = sorted((root[a], root[b]))
            root = {k: lo if r == hi else r for k, r in root.items()}
    assert len({*root.values()}) < len(left)
    left = {i: left[i] for i in {*root.values()}}

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = set()
    for i, t in left.items():
        have = Counter(words(t))
        for item in items:
            # a match shares at least 0.8 of the shingles, so most of the words
            if words(item) and sum((have & Counter(words(item))).values()) >= 0.5 * len(words(item)) and sliding(t, item)[1]:
                bad.add(i)
    assert bad
    left = {i: t for i, t in left.items() if i not in bad}

    t = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(left)
    for i, text in left.items():
        ids_ = t.encode(text, add_special_tokens=False).ids
        assert got[i] == (len(ids_), ids_, t.decode(ids_, skip_special_tokens=False))


def test_stages_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

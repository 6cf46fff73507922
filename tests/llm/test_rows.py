"""Odd rows through the operators that take a table: nulls, repeats, long texts, empty tables, clashing columns."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_corpus import ODD, docs_of, with_clashes
from tidemark.llm import bpe, exact_dedup, simhash, urls
from tidemark.llm.queries import tokenizer_path


def test_bpe_encode_equals_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = [*ODD, *ODD, "x" * 30_000 + " " + "word " * 50_000, "<|endoftext|> a <|startoftext|>"]
    docs = with_clashes(docs_of(spark, texts, [None, *range(len(texts) - 1)])).withColumns({c: F.lit(1) for c in ("ids", "decoded", "n_tokens")})
    got = bpe.bpe_encode(docs, tokenizer_path()).collect()
    want = []
    for i, text in zip([None, *range(len(texts) - 1)], texts, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), ids, t.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got) == sorted(want)
    twice = docs_of(spark, ["a b", "a b"], [3, 3])
    assert len({(r.doc_id, bytes(r.ids)) for r in bpe.bpe_encode(twice, tokenizer_path()).collect()}) == 1 and bpe.bpe_encode(twice, tokenizer_path()).count() == 2
    assert bpe.bpe_encode(docs.limit(0), tokenizer_path()).count() == 0


def test_urls_of_odd_rows(spark):
    rules = [("block", "com", "/en/"), ("allow", "a.com", "")]
    rows = [(1, "http://A.com/en/"), (1, "http://A.com/en/"), (None, "http://b.com/en/"), (2, None), (3, ""), (4, "://"), (5, "http://" + "x." * 20_000 + "com/en/" + "y" * 50_000)]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string")).withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict")})
    got = sorted((str(r.page_id), r.rule, r.verdict) for r in urls.filter_urls(pages, rules).collect() if r.rule)
    assert got == sorted([("1", "com/en/", "block")] * 2 + [("5", "com/en/", "block"), ("None", "com/en/", "block")])
    assert urls.filter_urls(pages, rules).count() == len(rows) and urls.filter_urls(pages.limit(0), rules).count() == 0
    assert {(r.rule, r.verdict) for r in urls.filter_urls(pages, []).collect()} == {(None, "allow")}


def test_long_texts_and_clashing_columns_in_dedup(spark):
    long = " ".join(f"w{k * k % 9973}" for k in range(150_000)) + " "
    docs = with_clashes(docs_of(spark, [long, long + "  ", long + "x", None, ""])).withColumns({c: F.lit(1) for c in ("keep_id", "component_id", "digest_", "node")})
    kept = {r.doc_id: r.kept for r in exact_dedup.label_copies(docs).collect()}
    assert kept[0] and kept[2] and kept[3] and not kept[4]
    near = simhash.near_dedup(docs)
    assert sorted(r.doc_id for r in near.collect()) == [0, 3] and near.columns == docs.columns
    assert {r.doc_id: r.component_id for r in simhash.label_near_copies(docs).collect()}[1] == 0

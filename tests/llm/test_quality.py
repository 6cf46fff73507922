"""The discriminant against one written from its definition."""

import random
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_corpus import ODD, docs_of, with_clashes
from tidemark.llm import quality


def mixed(seed, n):
    rng = random.Random(seed)
    texts = []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 90))]
        if k % 3 == 0:
            words = [w + rng.choice(["", "#", "!", ".", "9", "|"]) for w in words] + words[:20]
        texts.append(rng.choice([" ", "\n"]).join(words))
    return texts


def by_definition(x, y, of):
    """Log density ratio of two Gaussians with shrunk covariances, as probability of class 1."""
    covs = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    share = np.array([(y == 0).mean(), (y == 1).mean()])
    pooled = share[0] * covs[0] + share[1] * covs[1]
    logs = []
    for c in (0, 1):
        cov = (1 - quality.POOL - quality.RIDGE) * covs[c] + quality.POOL * pooled + quality.RIDGE * np.diag(np.maximum(np.diag(pooled), 1e-6))
        d = of - x[y == c].mean(axis=0)
        logs.append(np.log(share[c]) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def test_scores_by_definition(spark):
    texts = mixed(1, 300) + ODD
    kinds = [int(k % 3 != 0) if k % 7 else 1 - int(k % 3 != 0) for k in range(len(texts))]
    docs, labels = docs_of(spark, texts), spark.createDataFrame(list(enumerate(kinds)) * 2, "doc_id long, quality int")
    x, y = np.array([quality.statistics(t) for t in texts]), np.array(kinds)
    held = np.array([crc32(str(k).encode()) % 3 == 1 for k in range(len(texts))])
    want = by_definition(x[~held], y[~held], x)
    rows = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    assert np.abs(want - [rows[k].score for k in range(len(texts))]).max() < 1e-6
    assert [rows[k].held_out for k in range(len(texts))] == held.tolist()
    assert sorted(r.doc_id for r in quality.keep_good(docs, labels).collect()) == [k for k in range(len(texts)) if want[k] >= 0.5]


def test_statistics_of_a_text():
    got = dict(zip(quality.NAMES, quality.statistics("Ab ab ab! 1|\n#\n#"), strict=True))
    assert got["words"] == np.log1p(6) and got["upper"] == (1 / 16) ** 0.5 and got["digits"] == (1 / 16) ** 0.5
    assert got["twice"] == (1 / 6) ** 0.5 and got["lines_twice"] == (1 / 3) ** 0.5 and got["pipes"] == (1 / 16) ** 0.5


def test_fits_on_a_bounded_number_of_labels(spark):
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    got = quality.labels_to_fit(labels, most=1000)
    assert 800 < got.count() < 1200 and not got.filter(quality.held_out("id_")).count()
    assert quality.labels_to_fit(labels.limit(0)).count() == 0


def test_odd_rows(spark):
    docs = with_clashes(docs_of(spark, ["a b c", "a b c", None], [1, 1, None])).withColumns({c: F.lit(0) for c in ("quality", "label_", "score", "doc_", "held_out")})
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, 7)], "doc_id long, quality int")
    assert sorted((str(r.doc_id), r.score) for r in quality.score_documents(docs, labels).collect()) == [("1", 1.0), ("1", 1.0), ("None", 1.0)]
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.score_documents(docs.limit(0), labels).count() == 0 and quality.keep_good(docs.limit(0), labels).count() == 0

"""Quality classifier: regularised quadratic discriminant over transformed statistics of the whole text.

Each class has a mean and a covariance that is shrunk toward the pooled one and a multiple of the
identity. A score is the logistic of the difference of the log densities, each from the Mahalanobis
distance by the class's Cholesky factor, which is factored once on the driver and sent with the task.

Fitting needs sums of features and of their products per class: one aggregate, combined map-side. It takes the
labelled rows whose id hashes lowest, about ``FIT_ROWS`` at most; so the ids of these rows, which are broadcast, and
the work of fitting are bounded. Every row is scored, by its whole text.

Defined results: a null text is empty and has a score; texts of any length count whole; without rows of both
classes the score is the share of class 1 among the labels, or 0.5 without labels; labels other than 0 and 1, or of a
null id, are not used; repeated labels count once, repeated rows are scored each; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, staged

NAMES = ("length", "words", "word_length", "upper", "title", "digits", "stops", "marks", "symbols", "pipes", "shouts", "breaks", "distinct", "top", "twice", "lines_twice")
POOL, RIDGE = 0.2, 0.05
#: Labelled rows that the model is fitted on, at most but for chance.
FIT_ROWS = 100_000

_SYMBOLS = np.frombuffer(b"#$%&*@^~_=+<>\\/{}[]", np.uint8)
_MARKS = np.frombuffer(b",;:'\"()-?", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of ``NAMES``."""
    text = text or ""
    count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words = text.split()
    chars, n = max(1, len(text)), max(1, len(words))
    often = Counter(words)
    lines = [x for x in text.split("\n") if x]
    root = lambda x, of: (x / of) ** 0.5
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        float(np.log1p((len(text) - int(count[[9, 10, 11, 12, 13, 32]].sum())) / n)),
        root(int(count[65:91].sum()), chars),
        root(sum(map(str.istitle, often)), max(1, len(often))),
        root(int(count[48:58].sum()), chars),
        root(int(count[46]), n),
        root(int(count[_MARKS].sum()), chars),
        root(int(count[_SYMBOLS].sum()), chars),
        root(int(count[124]), chars),
        root(int(count[33]), chars),
        root(int(count[10]), chars),
        root(len(often), n),
        root(max(often.values(), default=0), n),
        root(sum(map(eq, words, words[1:])), n),
        root(len(lines) - len({*lines}), max(1, len(lines))),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, f: array<double>."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), lambda cols: [cols[0], [statistics(t) for t in cols[1]]], f"`{id_col}` {kind}, f array<double>")


@dataclass(frozen=True)
class Model:
    """Per class: mean, inverse Cholesky factor, log of the prior less half the log determinant."""

    base: float
    mean: np.ndarray | None = None
    factor: np.ndarray | None = None
    const: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.base)
        logs = [self.const[c] - 0.5 * np.square((x - self.mean[c]) @ self.factor[c].T).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(rows: DataFrame, label: str = "quality", pool: float = POOL, ridge: float = RIDGE) -> Model:
    """``rows`` has the array f and the label."""
    d = len(NAMES)
    cells = [F.sum(F.col("f")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    got = {r[label]: r for r in rows.filter(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *cells).collect()}
    n = np.array([got[c].n if c in got else 0 for c in (0, 1)], float)
    if not n.all():
        return Model(float(n[1] / n.sum()) if n.sum() else 0.5)
    mean = np.array([[got[c][f"s{i}"] / n[c] for i in range(d)] for c in (0, 1)])
    cov = np.empty((2, d, d))
    for c in (0, 1):
        for i in range(d):
            for j in range(i + 1):
                cov[c, i, j] = cov[c, j, i] = got[c][f"p{i}_{j}"] / n[c] - mean[c, i] * mean[c, j]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factor, const = [], []
    for c in (0, 1):
        shrunk = (1 - pool - ridge) * cov[c] + pool * pooled + ridge * scale
        low = np.linalg.cholesky(shrunk)
        factor.append(np.linalg.inv(low))
        const.append(np.log(n[c] / n.sum()) - np.log(np.diag(low)).sum())
    return Model(float(n[1] / n.sum()), mean, np.array(factor), np.array(const))


def held_out(id_col: str = "doc_id") -> Column:
    """Every third row by the checksum of its id; never used in fitting."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labels_to_fit(labels: DataFrame, id_col: str = "doc_id", label: str = "quality", most: int = FIT_ROWS) -> DataFrame:
    """id_, label_: at most about ``most`` labels, none of a held-out row."""
    known = labels.filter(~held_out(id_col) & F.col(label).isin(0, 1)).select(F.col(id_col).alias("id_"), F.col(label).alias("label_")).filter("id_ is not null").distinct()
    n = known.count()
    share = F.pmod(F.xxhash64(F.col("id_").cast("string")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(1, n)))
    return F.broadcast(known.filter(share))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FIT_ROWS) -> DataFrame:
    """<id_col>, held_out, score, predicted of every row."""
    found = staged(features(docs, id_col, text_col), "quality-features")
    known = labels_to_fit(labels, id_col, most=most)
    model = fit(found.join(known, found[id_col] == known["id_"]), "label_")
    kind = docs.schema[id_col].dataType.simpleString()
    scored = map_batches(found, lambda cols: [cols[0], model.score(np.array(cols[1], float).reshape(len(cols[0]), len(NAMES)))], f"`{id_col}` {kind}, score double", rows=8192)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FIT_ROWS) -> DataFrame:
    """The rows that the classifier does not reject, with all their columns and without a shuffle of texts."""
    known = labels_to_fit(labels, id_col, most=most)
    texts = docs.select(F.col(id_col).alias("doc_"), F.col(text_col).alias("text_")).join(known, F.col("doc_") == F.col("id_"))
    schema = f"label_ {dict(known.dtypes)['label_']}, f array<double>"
    model = fit(map_batches(texts.select("label_", "text_"), lambda cols: [cols[0], [statistics(t) for t in cols[1]]], schema), "label_")

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts], float).reshape(len(texts), len(NAMES))))

    return docs.filter(score(F.col(text_col)) >= 0.5)

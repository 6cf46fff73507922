"""The field of personal data: gradient, decoding, and what it adds on lines that it was not trained on."""

import random
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_corpus import ODD, docs_of
from tidemark.llm import pii


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    table = pii.Training(pii.labelled_lines(5, 12), 0.1)
    weights = [rng.normal(size=x) * 0.3 for x in ((len(table.names), len(pii.TAGS)), (len(pii.TAGS),) * 2, (len(pii.TAGS),))]
    _, grads = table.likelihood(*weights)
    for w, g in zip(weights, grads, strict=True):
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in w.shape)
            keep, said = w[at], []
            for d in (1e-5, -1e-5):
                w[at] = keep + d
                said.append(table.likelihood(*weights)[0])
            w[at] = keep
            assert abs((said[0] - said[1]) / 2e-5 - g[at]) < 1e-4


def test_likelihood_is_that_of_all_tag_sequences():
    lines = [(["call", "(555)", "0123"], [0, 7, 8]), (["x@y"], [1])]
    table = pii.Training(lines, 0.0)
    rng = np.random.default_rng(2)
    emit, step, begin = (rng.normal(size=x) for x in ((len(table.names), len(pii.TAGS)), (len(pii.TAGS),) * 2, (len(pii.TAGS),)))
    field = pii.Field(table.names, emit, step + table.allow_step, begin + table.allow_begin)
    want = 0.0
    for words, tags in lines:
        score = field.scores(words)
        path = lambda t: field.begin[t[0]] + sum(score[k, x] for k, x in enumerate(t)) + sum(field.step[a, b] for a, b in zip(t, t[1:]))  # noqa: B023, E731
        every = [path(t) for t in product(range(len(pii.TAGS)), repeat=len(words))]
        want += path(tags) - np.log(np.exp(every).sum())
    assert abs(table.likelihood(emit, step, begin)[0] - want) < 1e-9


def test_decoding_is_viterbi():
    field = pii.trained()
    for line in (["call", "(555)", "123-4567"], ["192.0.2.1", "x"], ["ann", "(at)", "example"]):
        score, best = field.scores(line), None
        for tags in product(range(len(pii.TAGS)), repeat=len(line)):
            s = field.begin[tags[0]] + sum(score[k, t] for k, t in enumerate(tags)) + sum(field.step[a, b] for a, b in zip(tags, tags[1:]))
            best = max(best or (s, tags), (s, tags))
        assert tuple(field.decode([line, ["pad"] * 9])[0]) == best[1]


def marked(words, tags):
    """Spans of a labelled line, without the marks at their edges."""
    text, at, k, out = " ".join(words), [], 0, set()
    for w in words:
        at.append((at[-1][1] + 1 if at else 0, (at[-1][1] + 1 if at else 0) + len(w)))
    while k < len(words):
        j = k + 1
        if tags[k]:
            kind = pii.TAGS[tags[k]][2:]
            while j < len(words) and pii.TAGS[tags[j]] == f"I-{kind}":
                j += 1
            a, b = at[k][0], at[j - 1][1]
            while text[a] in pii._EDGE:
                a += 1
            while text[b - 1] in pii._EDGE:
                b -= 1
            out.add((kind, a, b))
        k = j
    return text, out


def test_adds_spans_of_every_kind_on_other_lines():
    """Precision and recall on invented lines of another seed, counted over spans that no pattern finds."""
    field = pii.trained()
    made = [marked(*line) for line in pii.labelled_lines(99, 2000)]
    right, wrong, missed = Counter(), Counter(), Counter()
    for (text, want), (base, every) in zip(made, pii.find_spans([t for t, _ in made], field), strict=True):
        assert {*base} <= {*every}
        want = {s for s in want if not any(a < s[2] and s[1] < b for _, a, b in base)}
        added = {*every} - {*base}
        right.update(k for k, *_ in added & want)
        wrong.update(k for k, *_ in added - want)
        missed.update(k for k, *_ in want - added)
    for kind in pii.ALL_KINDS:
        assert right[kind] > 50
        assert right[kind] >= 0.95 * (right[kind] + wrong[kind]) and right[kind] >= 0.9 * (right[kind] + missed[kind])


def test_adds_nothing_to_clean_prose():
    field, rng = pii.trained(), random.Random(3)
    assert field.plain_lines_are_empty
    lines = ["The quick fox, and - some ... words!", "In 1999 they moved; 25 people, 300 cows.", "On 2024-05-17 at 10:30 we met in room 101.", "Version 2.10.3 costs $45.99 or 20 % less", "Pages 10-20 and 30-40, chapter 12 (3)", "@someone said so", "Licence 4.0. See http://www.example.com/en/5462 for more", "id 99120034 in row 17", "a | b | c || d", "SHOUT!! MORE!!"]
    lines += [" ".join("".join(rng.choice("abcdefghij,.-'") for _ in range(rng.randrange(1, 9))) for _ in range(12)) for _ in range(300)]
    assert not any(e for _, e in pii.find_spans(lines, field))
    assert all((t == 0).all() for t in field.decode([x.split() for x in lines[10:]]))


def test_rows(spark):
    rows = pii.find_pii(docs_of(spark, ODD).withColumn("base", F.lit(1)).withColumn("spans", F.lit(2)).withColumn("id_", F.lit(3))).collect()
    assert len(rows) == len(ODD) and not any(r.spans for r in rows)
    docs = docs_of(spark, ["é call (555) 555-0123 or +1 (888) 555-0141"] * 2 + [None], [1, 1, None])
    got = pii.find_pii(docs).collect()
    spans = [("phone", 7, 21), ("phone", 25, 42)]
    assert sorted((str(r.doc_id), [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in got) == [("1", spans[1:], spans)] * 2 + [("None", [], [])]
    assert pii.find_pii(docs.limit(0)).count() == 0
    long = "word " * 300_000 + "\nmail ann (at) example (dot) org\n" + "x" * 300_000
    assert [s.kind for s in pii.find_pii(docs_of(spark, [long])).first().spans] == ["email"]

"""Decontamination by length of item: near the threshold, very short, repetitive and very long ones."""

import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.test_corpus import with_clashes
from tidemark.llm import decontaminate

LENGTHS = (1, 2, 4, 5, 6, 7, 9, 12, 20, 35, 60, 100, 200, 400)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def sliding(doc, item):
    """Best similarity over all windows and how many reach 0.8, by counts that move on a word at a time."""
    w, x = words(doc), words(item)
    k = min(5, len(x))
    want, have = Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1)), Counter()
    sh = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
    a, wide = len(x) - k + 1, min(len(x) - k + 1, len(sh))
    both, best, n = 0, 0.0, 0
    for j, s in enumerate(sh):
        both += have[s] < want[s]
        have[s] += 1
        if j >= wide:
            have[sh[j - wide]] -= 1
            both -= have[sh[j - wide]] < want[sh[j - wide]]
        if j >= wide - 1:
            t = both / (a + wide - both)
            best, n = max(best, t), n + (t >= 0.8)
    return best, n


def test_counts_of_all_windows_by_length(spark):
    rng = random.Random(11)
    items, docs = [], []
    for length in LENGTHS:
        for kind in range(3):
            vocabulary = [f"w{length}x{kind}y{j}" for j in range({0: 50 * length, 1: 50 * length, 2: 4}[kind])]
            item = [rng.choice(vocabulary) for _ in range(length)]
            if kind == 1:  # two shingles make up most of it
                item = [*item[: length // 5], *(["tick", "tock"] * length)[: length - length // 5]]
            items.append((len(items), " ".join(item)))
            for _ in range(6):  # about as many words changed as the threshold bears
                part = list(item)
                for _ in range(rng.randrange(0, 2 + length // 35)):
                    at = rng.randrange(len(part))
                    part[at : at + 1] = rng.choice([["new"], [], [part[at], "more"]])
                around = [f"z{rng.randrange(1000)}" for _ in range(rng.choice([0, 3, 40]))]
                docs.append((len(docs), " ".join(around + part + around[::-1])))
    want = {}
    for d, text in docs:
        there = {*words(text)}
        for i, item in items:
            if there & {*words(item)} and words(item):
                best, n = sliding(text, item)
                if n:
                    want[d, i] = (round(best, 9), n)
    near = sum(0.8 <= s < 0.9 for s, _ in want.values())
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.windows) for r in decontaminate.contaminated(frame, bench).collect()}
    assert got == want and len(want) > 150 and near > 20
    assert {len(words(items[i][1])) for _, i in want} == {*LENGTHS}


def test_long_items_take_linear_time(spark):
    rng, took = random.Random(2), {}
    for n in (1_000, 40_000):
        item = [f"w{rng.randrange(50_000)}" for _ in range(n)]
        part = list(item)
        for _ in range(n // 80):
            part[rng.randrange(n)] = "changed"
        docs = spark.createDataFrame([(1, " ".join(["before"] * 50 + part + ["after"] * 50)), (2, "a b c"), (3, " ".join(item[: n // 2]))], "doc_id long, text string")
        bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
        began = time.time()
        got = decontaminate.contaminated(docs, bench).collect()
        took[n] = time.time() - began
        assert [(r.doc_id, r.item_id, round(r.similarity, 9), r.windows) for r in got] == [(1, 7, *(lambda s: (round(s[0], 9), s[1]))(sliding(docs.first().text, bench.first().text)))]
    assert took[40_000] < 10 * took[1_000]


def test_odd_rows(spark):
    item = " ".join(f"w{k}" for k in range(30))
    docs = with_clashes(spark.createDataFrame([(1, item), (1, item), (None, item), (None, None), (2, ""), (3, "_ ! ?")], "doc_id long, text string")).withColumns({"bitmap": F.lit(1), "n": F.lit(2), "m": F.lit(3), "row_": F.lit(4)})
    bench = spark.createDataFrame([(7, item), (8, None), (None, item.upper()), (9, " . ")], "item_id long, text string").withColumn("sh", F.lit("x"))
    got = {(r.doc_id, r.item_id, r.windows) for r in decontaminate.contaminated(docs, bench).collect()}
    assert {(d, i) for d, i, _ in got} == {(1, 7), (None, 7), (1, None), (None, None)}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, None), (2, ""), (3, "_ ! ?")], key=str)
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).columns == docs.columns

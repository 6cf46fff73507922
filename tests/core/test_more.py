"""Odd source files, namespaces by brute force, roots that only Spark reads, and what is kept between runs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions.facts import facts
from tidemark.functions.tokens import tokenize
from tidemark.operators import changes, extraction, graph, selection
from tidemark.plans.analyze import build_graph, report_counts
from tidemark.sources import files, git
from tidemark.sources.store import Store


@pytest.mark.parametrize("source", ['<?php $x = ' + '"{$a[' * 20_000, '<?php $x = "' + "{$a} " * 60_000 + '";', "<?php " + "".join(f"<<<A{k}\n{{$" for k in range(30_000)), "<?php `" + "${a}" * 60_000 + "`"], ids=range(4))
def test_deep_and_long_strings(source):
    began = time.process_time()
    assert "".join(t.text for t in tokenize(source)) == source
    facts(source)
    assert time.process_time() - began < 20  # quadratic work takes minutes


def test_a_quote_within_an_expression_ends_no_string():
    assert [t.kind for t in tokenize('<?php "a {$b["k"]} c" . "{$d["{$e}"]}" ;')].count('"') == 6
    assert tokenize('<?php $x = "a {$b["k"]} \\" c"; new A;')[-2].text == "A"


def test_a_file_that_fails_has_no_rows(spark, monkeypatch):
    def rows(code):
        if "bad" in code:
            raise RecursionError(code)
        return [(code, "x")]

    df = spark.createDataFrame([("a", 1, "good"), ("b", 2, "bad"), ("c", 3, None)], "path string, ord long, code string")
    got = extraction._each(df, rows, {"kind": "string", "name": "string"}).collect()
    assert sorted(tuple(r) for r in got) == [("a", 1, "good", "x", 0), ("c", 3, "", "x", 0)]


def test_namespaces_by_brute_force(spark):
    rng = random.Random(7)
    words = ["User", "Order", "a", "ab", "Api", "Src", "Report", "ÉTAT", "i"]
    tests = ["\\".join(rng.choice(words) + rng.choice(["", "s", "X"]) for _ in range(rng.randrange(1, 5))) + "Test::test" + str(k) for k in range(200)]
    paths = ["/".join(rng.choice([*words, "src", "lib", "Tests", "user"]) for _ in range(rng.randrange(1, 5))) + rng.choice([".php", ""]) for _ in range(30)]

    def holds(test, path):
        name = test.partition("::")[0].replace("\\", "/").lower()
        parts = [p.lower() for p in path.removesuffix(".php").split("/") if p and p.lower() not in selection.COMMON]
        return sum(p in name for p in parts) >= 2

    want = {t for t in tests if any(holds(t, p) for p in paths)}
    got = selection.by_namespace(spark.createDataFrame([(t, "c") for t in tests], "test string, callee string"), spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {r.test for r in got.collect()} == want and 0 < len(want) < len(tests) and got.count() == len(want)


def test_cascade_asks_no_further_than_needed(spark):
    some, none = spark.createDataFrame([("t",)], "test string"), spark.createDataFrame([], "test string")
    fails = some.select(F.raise_error(F.lit("asked")).cast("string").alias("test"))
    assert [r.test for r in selection.cascade(none, some, fails).collect()] == ["t"]
    assert selection.cascade(none, none).count() == 0


def test_root_that_only_spark_reads(spark, tmp_path):
    for name, text in {"src/A.php": "<?php class A {}", "src/_b.php": "<?php class B {}", ".hid/c.php": "<?php class C {}", "gen/D.php": "<?php class D {}", ".gitignore": "gen/\n", "vendor/_e.php": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.rooted.link./in", f"file://{tmp_path}")
    for root in ("viewfs://rooted/in", str(tmp_path), f"file://{tmp_path}/"):
        got = files.source_files(spark, root)
        assert sorted((r.path, r.code) for r in got.collect()) == [(".hid/c.php", "<?php class C {}"), ("src/A.php", "<?php class A {}"), ("src/_b.php", "<?php class B {}")]


def test_calls_are_kept(spark, tmp_path):
    root, source = tmp_path / "p", "<?php class {0} {{ function f() {{ {1}::g(); }} }}"
    root.mkdir()
    for k in "ABC":
        (root / f"{k}.php").write_text(source.format(k, "X"))
    store = Store(spark, str(tmp_path / "kept"))
    rows = lambda g: sorted(tuple(r) for r in g.calls.collect())
    assert store.statistics() == {} and len(rows(build_graph(spark, str(root), store))) == 3
    (root / "B.php").write_text(source.format("B", "Other"))
    (root / "C.php").unlink()
    part = build_graph(spark, str(root), store)
    assert part.stats["parsed"] == 1 and rows(part) == rows(build_graph(spark, str(root))) == [("A.php", "A::f", "X::g"), ("B.php", "B::f", "Other::g")]
    said = store.statistics()
    assert said["bytes"] > 0 and said["age"] >= 0 and said["tracked"] == 3  # deleted files stay in the registry


def test_report_is_split(spark):
    reached, changed = spark.createDataFrame([("a",), ("b",), ("c",)], "path string"), spark.createDataFrame([("a",), ("a",), ("z",)], "path string")
    assert report_counts(reached, changed) == {"changed": 1, "dependent": 2}
    assert changes.registry_totals(spark.createDataFrame([("a", 3, 5), ("b", 9, 6)], "path string, mtime long, size long")).first().asDict() == {"files": 2, "newest": 9, "bytes": 11}


def test_diffs_of_a_table(spark):
    diff = "diff --git a/x.php b/x.php\n+++ b/x.php\n@@ -1 +3 @@\n"
    assert [tuple(r) for r in git.hunks_of_diffs(spark.createDataFrame([(diff,), (None,), ("",)], "diff string")).collect()] == [("x.php", 3, 1)]


def test_staged_files_go(spark):
    import os

    df = session.staged(spark.range(3), "gone")
    path = df.staged_path.removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 3
    session.discard(df)
    assert not os.path.exists(path)


def test_registry_lookup_and_counts(spark):
    registry = spark.createDataFrame([("a", 1, 2)], "path string, mtime long, size long")
    asked = spark.createDataFrame([("a",), ("b",)], "path string")
    assert sorted(tuple(r) for r in changes.registry_lookup(registry, asked).collect()) == [("a", True, 1, 2), ("b", False, None, None)]
    methods = spark.createDataFrame([("a", "X::f"), ("a", "X::f"), ("b", "X::f"), ("b", "g")], "path string, method string")
    assert tuple(changes.method_counts(methods).first()) == (2, 3)
    assert tuple(changes.method_counts(methods.filter("false")).first()) == (0, 0)


def test_files_of_reached_methods(spark):
    changed = spark.createDataFrame([("a.php", "X::f"), ("a.php", "g")], "path string, method string")
    reached = spark.createDataFrame([("X::f",), ("Y::h",), ("Y::i",), ("g",), ("Z::j",)], "method string")
    index = spark.createDataFrame([("X", "a.php"), ("Y", "y.php"), ("g", "no.php")], "class_name string, path string")
    assert sorted(r.path for r in graph.affected_files(changed, reached, index).collect()) == ["a.php", "y.php"]


def test_a_temporary_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), temporary=True)
    rows = spark.createDataFrame([("a", 1, 2)], "path string, mtime long, size long")
    assert store.load() is None and store.states() == []
    for _ in range(3):
        store.save(registry=rows)
    assert len(store.states()) == 2 and store.load()["registry"].collect() == rows.collect()

"""The generic operators on small tables."""

import random

import pytest

from tidemark.functions import patterns
from tidemark.operators import changes, filters, formatters, graph
from pyspark.sql import functions as F


def rows(spark, values, schema):
    return spark.createDataFrame(list(values), schema)


@pytest.mark.parametrize("small", [0, 1000])
def test_closure_by_search(spark, small):
    rng = random.Random(small)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(3, 3), (7, 8), (8, 7), (7, 8)] + [(100 + k, 101 + k) for k in range(12)]
    seeds = [0, 7, 100, 999]
    want = set()
    for s in seeds:
        todo, seen = [s], {s}
        while todo:
            x = todo.pop()
            new = {b for a, b in edges if a == x} - seen
            seen |= new
            todo += new
        want |= {(s, x) for x in seen}
    got = graph.closure(rows(spark, [(s, s) for s in seeds], "root long, node long"), rows(spark, edges, "dependency long, dependent long"), small=small)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_closure_of_long_chains(spark):
    """A round for each hop would take thousands of jobs."""
    chain, ring, side = [(k, k + 1) for k in range(3000)], [(10_000 + k, 10_000 + (k + 1) % 700) for k in range(700)], [(1500, 20_000), (20_000, 20_001), (None, 5), (5, None)]
    seeds = [(0, 0), (1, 1499), (2, 10_350), (3, 2999), (4, 99_999), (5, None), (None, 7)]
    got = graph.closure(rows(spark, seeds, "root long, node long"), rows(spark, chain + ring + side, "dependency long, dependent long"), small=0).collect()
    more = [20_000, 20_001]
    want = {0: [*range(3001), *more], 1: [*range(1499, 3001), *more], 2: [*range(10_000, 10_700)], 3: [2999, 3000], 4: [99_999]}
    assert sorted(tuple(r) for r in got) == sorted((root, x) for root, nodes in want.items() for x in nodes)


def test_shortcuts_are_reachable(spark):
    edges = rows(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (5, 7), (8, 9), (9, 8)], "dependency long, dependent long")
    got = [sorted(tuple(r) for r in s.collect()) for s in graph.shortcuts(edges)]
    assert got[:2] == [[(1, 3), (2, 4), (3, 5), (8, 8), (9, 9)], [(1, 5), (8, 8), (9, 9)]]


@pytest.mark.parametrize("small", [0, 1000])
def test_closure_leaves_nulls_out(spark, small):
    edges = rows(spark, [("a", "b"), (None, "c"), ("b", None)], "dependency string, dependent string")
    got = graph.closure(rows(spark, [("r", "a"), (None, "a"), ("r", None)], "root string, node string"), edges, small=small)
    assert sorted(tuple(r) for r in got.collect()) == [("r", "a"), ("r", "b")]


def test_last_file_owns_a_class(spark):
    declared = rows(spark, [("a", 1, "X"), ("b", 2, "X"), ("a", 1, "Y")], "path string, ord long, name string")
    assert {tuple(r) for r in graph.class_index(declared).collect()} == {("X", "b"), ("Y", "a")}


@pytest.mark.parametrize(
    ("path", "pattern", "hit"),
    [
        ("composer.json", "composer.json", True), ("config/composer.json", "composer.json", True), ("my-composer.json.backup", "composer.json", False),
        ("config/app.yml", r"/.*\.yml$/", True), ("config/services.php", r"/^config\//", True), ("phpunit.xml", "*.xml", True), ("phpunit.xml", "*.yml", False),
        ("phpunit.xml.dist", r"/phpunit\.xml/", True), ("phpunit.xml", r"/test\.xml/", False), ("a.php", "/(/", False), ("x/A.PHP", "#a\\.php#i", True),
    ],
)
def test_patterns(spark, path, pattern, hit):
    assert rows(spark, [(path,)], "path string").select(filters.matches(F.col("path"), pattern)).first()[0] is hit


def test_ignore_rules(spark):
    rules = patterns.ignore_rules(["cache", "!src/cacheable/A.php", "/build", "logs/"])
    want = {"src/cacheable/A.php": True, "build/x.php": False, "a//build": True, "logs/a.php": True, "mylogs/a.php": False, ".git/x": True, "src/B.php": False}
    got = rows(spark, [(p,) for p in want], "path string").select("path", filters.ignored(F.col("path"), rules).alias("i")).collect()
    assert {r.path: r.i for r in got} == want


@pytest.mark.parametrize(
    ("items", "out"),
    [
        (["tests/UserTest.php::testLogin"], "tests/UserTest.php --filter testLogin"),
        (["tests/UserTest.php::testLogin", "tests/FooTest.php::testBar"], "tests/UserTest.php tests/FooTest.php --filter '/testLogin|testBar/'"),
        (["tests/UserTest.php::testLogin", "tests/UserTest.php::testLogout"], "tests/UserTest.php --filter '/testLogin|testLogout/'"),
        (["tests/UserTest.php::testLogin", "tests/FooTest.php", "tests/BarTest.php"], "tests/UserTest.php tests/FooTest.php tests/BarTest.php --filter testLogin"),
        (["tests/UserTest.php::"], "tests/UserTest.php"),
        (["tests/UserTest.php::testSomething[data-set]"], r"tests/UserTest.php --filter testSomething\[data\-set\]"),
        (["src/User.php::getName", "tests/UserTest.php::testLogin"], "tests/UserTest.php --filter testLogin"),
        (["spec/UserSpec.php"], ""), ([], ""),
    ],
)
def test_phpunit_format(spark, items, out):
    df = rows(spark, enumerate(items), "ord long, item string")
    assert formatters.format_phpunit(df).first().out == out
    assert formatters.format_phpunit(df, full_scan=True).first().out == ""


def test_phpunit_methods(spark):
    df = rows(spark, enumerate(["App\\UserTest::testA", "service", "X::assertSame", "App\\UserTest::testB", "AccountTest::t"]), "ord long, method string")
    assert formatters.format_phpunit_methods(df).first().out == "--filter '/UserTest|AccountTest/'"


def test_registry_and_hunks(spark):
    reg = "path string, mtime long, size long"
    diff = changes.registry_diff(rows(spark, [("a", 1, 1), ("b", 2, 2), ("c", 1, 9)], reg), rows(spark, [("a", 1, 1), ("b", 1, 2), ("d", 1, 1)], reg))
    assert {tuple(r) for r in diff.collect()} == {("b", "modified"), ("c", "new"), ("d", "deleted")}
    lines = rows(spark, [("f", k, f"m{k // 5}") for k in range(20)], "path string, line int, method string")
    hunks = rows(spark, [("f", 4, 2), ("f", 15, 0)], "path string, start int, cnt int")
    assert {r.method for r in changes.hunk_methods(hunks, lines).collect()} == {"m0", "m1"}

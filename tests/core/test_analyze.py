import subprocess
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.operators import extraction, graph
from tidemark.plans.analyze import Options, analyze, build_graph
from tidemark.sources import config, files
from tidemark.sources.store import Store

FILES = {
    "src/User.php": "<?php\nnamespace App;\nclass User\n{\n    public function getName()\n    {\n        return 'a';\n    }\n}\n",
    "src/Collector.php": "<?php\nnamespace App;\nuse App\\User;\nclass Collector\n{\n    public function collect()\n    {\n        return User::getName();\n    }\n}\n",
    "src/Service.php": "<?php\nnamespace Web;\nuse App\\Collector;\nclass Service { function run() { return new Collector(); } }\n",
    "src/Product.php": "<?php\nnamespace App;\nclass Product {}\n",
    "src/_part.php": "<?php\ninclude 'User.php'; class Part extends \\App\\Product {}\n",
    "tests/UserTest.php": "<?php\nnamespace Tests;\nuse App\\User;\nclass UserTest\n{\n    public function testName()\n    {\n        User::getName();\n    }\n}\n",
    "vendor/x/V.php": "<?php use App\\User;\n",
    "build/gen.php": "<?php use App\\User;\n",
    ".gitignore": "build/\n# note\n",
    "notes.txt": "x",
}


@pytest.fixture
def repo(tmp_path):
    def run(*a):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True)

    def write(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)

    for name, text in FILES.items():
        write(name, text)
    run("init", "-q"), run("add", "."), run("commit", "-qm", "one")
    return SimpleNamespace(path=str(tmp_path), run=run, write=write)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_scan(spark, repo):
    got = files.source_files(spark, repo.path)
    assert [p for (p,) in rows(got, "path")] == sorted(n for n in FILES if n.startswith(("src/", "tests/")))
    assert {r.path: r.code for r in got.collect()}["src/_part.php"] == FILES["src/_part.php"]


def test_graph_and_includes(spark, repo):
    g = build_graph(spark, repo.path)
    assert ("src/_part.php", "src/User.php") in rows(g.dependencies, "path", "dep_name")
    assert rows(build_graph(spark, repo.path, parser="ast").edges, "dependency", "dependent") == rows(g.edges, "dependency", "dependent")
    assert "src/_part.php" not in [d for _, d in rows(g.edges.filter("dependency = 'src/User.php'"), "dependency", "dependent")]  # includes do not propagate
    seeds = spark.createDataFrame([("src/User.php",), ("unknown.php",)], "node string")
    assert [n for (n,) in rows(graph.affected(seeds, g.edges), "node")] == ["src/Collector.php", "src/Service.php", "src/User.php", "tests/UserTest.php", "unknown.php"]


def test_incremental_equals_full(spark, repo, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    assert build_graph(spark, repo.path, store).stats["parsed"] == 6
    assert build_graph(spark, repo.path, store).stats["parsed"] == 0
    repo.write("src/Product.php", "<?php\nnamespace App;\nuse App\\User;\nclass Goods extends User {}\n")
    repo.write("src/New.php", "<?php\nuse App\\Goods;\nclass Fresh {}\n")
    subprocess.run(["rm", f"{repo.path}/src/Service.php"], check=True)
    part, full = build_graph(spark, repo.path, store), build_graph(spark, repo.path)
    assert part.stats["parsed"] == 2 and full.stats["parsed"] == 6
    for name in ("declared", "index", "dependencies", "edges"):
        a, b = getattr(part, name), getattr(full, name)
        assert rows(a, *sorted(a.columns)) == rows(b, *sorted(a.columns)), name
    store.clear()
    assert not store.exists() and store.load() is None


def test_whole_run(spark, repo):
    run = lambda **k: analyze(spark, repo.path, Options(cache=False, **k))
    assert run() == ""  # nothing changed
    repo.write("src/User.php", FILES["src/User.php"].replace("'a'", "'b'"))
    assert run() == "--filter UserTest"
    assert run(output="psalm") == "src/User.php"
    assert run(file_level=True) == "tests/UserTest.php"
    assert run(file_level=True, output="phpstan") == "src/Collector.php src/Service.php src/User.php tests/UserTest.php"
    assert run(full_scan_pattern="/User/") == ""
    repo.run("add", "."), repo.run("commit", "-qm", "two")
    assert run(file_level=True, since="HEAD~1", until="HEAD") == "tests/UserTest.php"
    for bad in ({"output": "files"}, {"staged": True, "since": "HEAD"}, {"full_scan_pattern": "/("}):
        with pytest.raises(ValueError):
            run(**bad)


def test_settings(tmp_path):
    assert config.full_scan_patterns(root=str(tmp_path)) is None
    (tmp_path / "config.yml").write_text("full_scan_patterns:\n  - '*.xml'\n")
    assert config.full_scan_patterns(root=str(tmp_path)) == ["*.xml"]
    (tmp_path / "tidemark.yml").write_text("full_scan_patterns: []\n")
    assert config.full_scan_patterns(root=str(tmp_path)) == []
    with pytest.raises(FileNotFoundError):
        config.full_scan_patterns("none.yml", str(tmp_path))


def test_null_and_empty_code(spark):
    df = spark.createDataFrame([("a", "a", None), ("b", "b", "")], "path string, ord string, code string")
    for f in (extraction.extract_facts, extraction.extract_calls, extraction.extract_method_lines):
        assert f(df).count() == 0 and f(df.filter(F.lit(False))).count() == 0

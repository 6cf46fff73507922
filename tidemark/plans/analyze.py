"""The whole analysis: changes of a repository to one string for a downstream tool.

Two levels. By file: all files that a changed file reaches over reverse dependencies. By method (the
default): the methods that changed methods reach over reverse calls; for tests, a cascade from tests
that call one of them to tests of the changed classes to tests of the same namespace. Strings list
files and methods by path and name.
"""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import patterns
from tidemark.operators import changes, extraction, filters, formatters, graph, selection
from tidemark.session import staged
from tidemark.sources import config, files, git
from tidemark.sources.store import Store

log = logging.getLogger("tidemark")

OUTPUTS = ("phpunit", "psalm", "phpstan", "test")


@dataclass
class Options:
    output: str = "phpunit"
    since: str | None = None
    until: str | None = None
    staged: bool = False
    full_scan_pattern: str | None = None
    test_pattern: str | None = None
    cache: bool = True
    clear_cache: bool = False
    config: str | None = None
    file_level: bool = False
    strategy: str = "conservative"
    parser: str = "token"

    def checked(self) -> Options:
        if self.output not in OUTPUTS:
            raise ValueError(f"unknown output format {self.output!r}; one of phpunit, psalm, phpstan")
        if self.staged and (self.since or self.until):
            raise ValueError("staged changes have no range: leave out from and to")
        for given in (self.full_scan_pattern, self.test_pattern):
            if given and patterns.is_delimited(given) and patterns.delimited_regex(given) is None:
                raise ValueError(f"malformed expression {given!r}")
        if self.output == "test":  # an old name
            self.output = "phpunit"
        return self


@dataclass
class Graph:
    """The relations of a project: files (path, ord, mtime, size), declared classes, class index, dependencies, calls, edges."""

    files: DataFrame
    declared: DataFrame
    index: DataFrame
    dependencies: DataFrame
    calls: DataFrame
    stats: dict[str, float]

    @property
    def edges(self) -> DataFrame:
        return graph.reverse_edges(self.dependencies, self.index)


def relations(facts: DataFrame, all_files: DataFrame, root: str, strategy: str) -> tuple[DataFrame, DataFrame]:
    """Declared classes, and dependencies by the strategy with the included files."""
    deps = graph.dependency_set(facts, strategy).unionByName(extraction.resolved_includes(facts, all_files, root))
    return extraction.declared(facts), deps


def _calls(source: DataFrame) -> DataFrame:
    return extraction.extract_calls(source).select("path", "caller", "callee")


def build_graph(spark: SparkSession, root: str, store: Store | None = None, strategy: str = "conservative", parser: str = "token") -> Graph:
    """The graph of all files. With a store, files that kept time and size since the last run are not parsed again.

    Calls are kept with the rest; without a store they are parsed only where they are asked for.
    The store does not note strategy and parser: a graph of others is used as it is (compatible).
    """
    source = files.source_files(spark, root)
    current = staged(source.select("path", "ord", "mtime", "size"), "files")
    total = current.count()
    old = store.load() if store else None
    if old is None:
        facts = staged(extraction.extract_facts(source, parser), "facts")
        declared, deps = relations(facts, current, root, strategy)
        index, parsed, calls = graph.class_index(declared), total, _calls(source)
        registry = current.select("path", "mtime", "size")
    else:
        diff = staged(changes.registry_diff(current, old["registry"]), "diff")
        changed = diff.filter("status <> 'deleted'").select("path")
        if diff.isEmpty():
            return Graph(current, old["declared"], old["index"], old["dependencies"], old["calls"], changes.cache_stats(0, total))
        fresh = source.join(changed, "path", "left_semi")
        facts = staged(extraction.extract_facts(fresh, parser), "facts")
        calls = changes.merge_incremental(changes.prune(old["calls"], current), _calls(fresh), changed)
        fresh_declared, fresh_deps = relations(facts, current, root, strategy)
        was = changes.prune(old["declared"], current)
        before = was.join(changed, "path", "left_semi").select("name")
        index = changes.merge_class_index(changes.prune(old["index"], current), before, graph.class_index(fresh_declared))
        declared = changes.merge_incremental(was, fresh_declared, changed)
        deps = changes.merge_incremental(changes.prune(old["dependencies"], current), fresh_deps, changed)
        parsed = changed.count()
        registry = changes.update_registry(current, old["registry"])
    if store:
        store.save(registry=registry, declared=declared, index=index, dependencies=deps, calls=calls)
        kept = store.load()
        declared, index, deps, calls = kept["declared"], kept["index"], kept["dependencies"], kept["calls"]
    return Graph(current, declared, index, deps, calls, changes.cache_stats(parsed, total))


def changed_methods(source: DataFrame, hunks: DataFrame) -> DataFrame:
    """path, method of the PHP files in a diff; only these files are parsed."""
    touched = source.join(hunks.filter(filters.has_suffix(F.col("path"))).select("path").distinct(), "path", "left_semi")
    return changes.hunk_methods(hunks, extraction.extract_method_lines(touched).select("path", "line", "method"))


def affected_methods(methods: DataFrame, calls: DataFrame) -> DataFrame:
    seeds = methods.select(F.col("method").alias("node")).distinct()
    return graph.affected(seeds, graph.reverse_calls(calls)).withColumnRenamed("node", "method")


def relevant_tests(changed: DataFrame, reached: DataFrame, calls: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """test, and the test calls they come from. The first level asks for all reached methods, the second for the
    classes of the changed methods, the third for the changed paths."""
    tests = staged(selection.test_calls(calls.filter(filters.is_test_file(F.col("path")))), "tests")
    short = changed.filter(F.col("method").contains("::")).select(filters.class_of(F.col("method")).alias("name")).distinct()
    classes = graph.full_names(short, index).select(F.concat("name", F.lit("::")).alias("method"))
    found = selection.cascade(selection.direct(tests, reached), selection.by_class(tests, classes), selection.by_namespace(tests, changed))
    return staged(found, "found"), tests


def report_counts(reached: DataFrame, changed: DataFrame) -> dict[str, int]:
    """How many files of a report changed themselves, and how many depend on those."""
    return {r.why: r["count"] for r in changes.split_report(reached, changed).groupBy("why").count().collect()}


def _text(rows: DataFrame) -> str:
    return rows.first().out or ""


def _items(paths: DataFrame, column: str = "path", name: str = "item") -> DataFrame:
    return paths.select(F.col(column).alias("ord"), F.col(column).alias(name))


def _lacking(why: str) -> str:
    log.info(why)
    return ""


def analyze(spark: SparkSession, root: str, options: Options | None = None, store: Store | None = None) -> str:
    """One string; an empty one stands for everything, or for no change at all."""
    said = (options or Options()).checked()
    root = os.path.abspath(root)
    changed = git.changed_files(spark, root, said.since, said.until, said.staged)
    wanted = patterns.active_patterns(said.full_scan_pattern, config.full_scan_patterns(said.config, root))
    hit = filters.full_scan_match(changed, wanted).first() if wanted else None
    changed = changed.filter(filters.has_suffix(F.col("path")))
    if hit:
        return _lacking(f"full run: {hit.path} matches {hit.pattern}")
    if changed.isEmpty():
        return _lacking("no PHP file changed")
    if said.cache and store is None:
        store = Store(spark, os.path.join(root, ".tidemark", "graph"))
    if store and said.clear_cache:
        store.clear()
    built = build_graph(spark, root, store if said.cache else None, said.strategy, said.parser)
    log.info("graph: %s", built.stats | (store.statistics() if said.cache and log.isEnabledFor(logging.INFO) else {}))
    by_file = formatters.formatter(said.output)
    custom = {"custom": said.test_pattern} if said.output == "phpunit" else {}
    if said.file_level:
        reached = graph.affected(changed.select(F.col("path").alias("node")), built.edges)
        if log.isEnabledFor(logging.INFO):
            reached = staged(reached, "reached")
            log.info("files: %s", report_counts(reached.select(F.col("node").alias("path")), changed))
        return _text(by_file(_items(reached, "node"), **custom))
    source = files.source_files(spark, root)
    methods = staged(changed_methods(source, git.changed_hunks(spark, root, said.since, said.until, said.staged)), "methods")
    if methods.isEmpty():
        return _lacking("files changed, but no method")
    calls = built.calls if said.cache else staged(built.calls, "calls")
    reached = staged(affected_methods(methods, calls), "reached")
    if said.output == "phpunit":
        found, tests = relevant_tests(methods, reached, calls, built.index)
        if log.isEnabledFor(logging.INFO):
            log.info("methods: %d changed, %d reached; tests: %d", methods.count(), reached.count(), found.count())
        if not found.isEmpty():
            return _text(formatters.format_phpunit_methods(_items(found, "test", "method")))
        return _lacking("no test was found")
    return _text(by_file(_items(graph.affected_files(methods, reached, built.index))))

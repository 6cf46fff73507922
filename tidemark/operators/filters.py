"""Row predicates: suffixes, ignore rules, full-run triggers, tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import patterns

# Folders that are never scanned, and what marks a test file.
SKIPPED = ("vendor", "node_modules", ".git", "cache", "var", ".tidemark")
TEST_FOLDERS = ("tests/", "test/", "Tests/", "Test/")
NOT_TESTS = ("[Ff]ixtures?", "_support", "bootstrap\\.php$", "_bootstrap\\.php$", "TestCase\\.php$", "AbstractTest", "TestHelper\\.php$", "helpers?")


def has_suffix(path: Column, suffix: str = ".php") -> Column:
    return path.endswith(suffix)


def in_skipped_folder(path: Column) -> Column:
    """A folder at any depth, the file's own name not counted."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, SKIPPED)))


def should_scan(path: Column) -> Column:
    """Single-file test: the suffix, and none of the skipped names as a prefix of the path."""
    out = has_suffix(path)
    for name in SKIPPED:
        out = out & ~path.startswith(name + "/")
    return out


def ignored(path: Column, rules: list[patterns.IgnoreRule]) -> Column:
    """The first rule that matches the path or one of its parents decides; ``.git`` is always ignored."""
    parts = F.split(path, "/")
    parents = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    git = (path == ".git") | path.startswith(".git/")
    out = F.when(git, True)
    for rule in rules:
        hit = path.rlike(rule.regex) | F.exists(parents, lambda p: p.rlike(rule.regex))  # noqa: B023
        out = out.when(hit, F.lit(not rule.negated))
    return out.otherwise(False)


def matches(path: Column, pattern: str) -> Column:
    """A delimited regular expression (malformed: no match), or an exact name, an ending after a slash, or a glob."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    if patterns.is_delimited(pattern):
        regex = patterns.delimited_regex(pattern)
        return path.rlike(regex) if regex is not None else F.lit(False)
    return (path == pattern) | path.endswith("/" + pattern) | path.rlike(patterns.glob_regex(pattern))


def full_scan_match(files: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """ord, path, pattern_ord, pattern of the first file that a pattern matches, by file and then pattern; or no row."""
    hit = F.lit(None).cast("int")
    for k in reversed(range(len(wanted))):
        hit = F.when(matches(F.col("path"), wanted[k]), k).otherwise(hit)
    name = F.element_at(F.array(*map(F.lit, wanted or ("",))), F.col("pattern_ord") + 1)
    found = files.select("ord", "path", hit.alias("pattern_ord")).filter("pattern_ord is not null")
    return found.withColumn("pattern", name).orderBy("ord", "pattern_ord").limit(1)


def is_test_file(path: Column) -> Column:
    out = path.contains("Test.php")
    for folder in TEST_FOLDERS:
        out = out | path.startswith(folder)
    return out


def is_runnable_test(path: Column, custom: str | None = None) -> Column:
    """As the formatter has it: a custom expression alone decides; else helpers and base classes are no tests."""
    if custom:
        return matches(path, custom)
    out = is_test_file(path)
    for regex in NOT_TESTS:
        out = out & ~path.rlike(regex)
    return out


def is_test_method(method: Column) -> Column:
    name = F.element_at(F.split(method, "::"), -1)
    return method.contains("::") & (name.startswith("test") | name.endswith("Test"))


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\\"), -1)


def class_of(method: Column) -> Column:
    return F.substring_index(method, "::", 1)


def is_test_class(name: Column) -> Column:
    return short_name(name).endswith("Test") | short_name(name).endswith("TestCase")


def absolute(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))

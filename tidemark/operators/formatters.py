"""One string for a downstream tool; an empty string stands for everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.filters import class_of, is_runnable_test, is_test_class, short_name
from tidemark.operators.graph import methods_to_files

# The characters that the quoting function of the reference language escapes.
_QUOTED = r"([.\\+*?\[\^\]$(){}=!<>|:\-#/])"
FORMATS = ("phpunit", "psalm", "phpstan", "ecs", "cs-fixer")


def quoted(text: Column) -> Column:
    return F.regexp_replace(text, _QUOTED, r"\\$1")


def _first_seen(rows: DataFrame, col: str) -> DataFrame:
    return rows.groupBy(col).agg(F.min("ord").alias("ord"))


def joined(rows: DataFrame, col: str, sep: str) -> DataFrame:
    """One row, out: the values in the order of ord. The one string is made in one task, so it has to fit there."""
    pairs = F.array_sort(F.collect_list(F.struct("ord", col)))
    return rows.agg(F.array_join(F.transform(pairs, lambda p: p[col]), sep).alias("out"))


def _filter_text(joined_names: Column, n: Column) -> Column:
    return F.when(n == 1, joined_names).otherwise(F.concat(F.lit("'/"), joined_names, F.lit("/'")))


def format_plain(items: DataFrame, full_scan: bool = False) -> DataFrame:
    """out: items (ord, item) with blanks between."""
    return joined(items.filter(F.lit(not full_scan)), "item", " ")


def format_phpunit(items: DataFrame, full_scan: bool = False, custom: str | None = None) -> DataFrame:
    """out: test files, once each, and the methods named with them as a filter, repeats included."""
    parts = items.filter(F.lit(not full_scan)).select("ord", F.split("item", "::", 2).alias("p"))
    rows = parts.select("ord", F.col("p")[0].alias("path"), F.when(F.size("p") > 1, F.col("p")[1]).otherwise("").alias("method")).filter(is_runnable_test(F.col("path"), custom))
    paths = joined(_first_seen(rows, "path"), "path", " ").withColumnRenamed("out", "paths")
    named = rows.filter("method <> ''").withColumn("method", quoted(F.col("method")))
    names = joined(named, "method", "|").withColumnRenamed("out", "names").crossJoin(named.agg(F.count(F.lit(1)).alias("n")))  # single rows
    text = F.when(F.col("n") > 0, F.concat_ws(" --filter ", "paths", _filter_text(F.col("names"), F.col("n")))).otherwise(F.col("paths"))
    return paths.crossJoin(names).select(text.alias("out"))


def format_phpunit_methods(methods: DataFrame, full_scan: bool = False) -> DataFrame:
    """out: the short names of the test classes as a filter."""
    rows = methods.filter(F.lit(not full_scan)).filter(F.col("method").contains("::")).select("ord", class_of(F.col("method")).alias("c")).filter(is_test_class(F.col("c")))
    once = _first_seen(rows.select("ord", short_name(F.col("c")).alias("c")), "c")
    names = joined(once, "c", "|").crossJoin(once.agg(F.count(F.lit(1)).alias("n")))
    return names.select(F.when(F.col("n") > 0, F.concat(F.lit("--filter "), _filter_text(F.col("out"), F.col("n")))).otherwise("").alias("out"))


def format_file_methods(methods: DataFrame, index: DataFrame, full_scan: bool = False) -> DataFrame:
    """out: file::method of each method whose class has a file, with blanks between; for analysers."""
    return format_plain(methods_to_files(methods, index), full_scan)


def formatter(name: str):
    """The formatter of an output format."""
    if name not in FORMATS:
        raise ValueError(f"unknown output format {name!r}; one of {', '.join(FORMATS)}")
    return format_phpunit if name == "phpunit" else format_plain

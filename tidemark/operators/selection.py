"""Test selection: three levels, each asked only if the one before found nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.filters import class_of, is_test_method
from tidemark.session import staged

# Path components that say nothing about a namespace.
COMMON = ("src", "lib", "app", "tests")


def test_calls(calls: DataFrame) -> DataFrame:
    """Calls made by test methods: test, callee, path."""
    return calls.filter(is_test_method(F.col("caller"))).select(F.col("caller").alias("test"), "callee", "path")


def direct(tests: DataFrame, methods: DataFrame) -> DataFrame:
    return tests.join(methods.select(F.col("method").alias("callee")), "callee", "left_semi").select("test").distinct()


def by_class(tests: DataFrame, methods: DataFrame) -> DataFrame:
    classes = methods.select(class_of(F.col("method")).alias("class_"))
    return tests.withColumn("class_", class_of(F.col("callee"))).join(classes, "class_", "left_semi").select("test").distinct()


#: Letters of a component that a class name has to hold for the two to be compared.
GRAM = 3


def components(path: Column) -> Column:
    """The telling components of a path, in lower case."""
    parts = F.transform(F.split(F.regexp_replace(path, r"\.php$", ""), "/"), F.lower)
    return F.filter(parts, lambda p: (p != "") & ~p.isin(*COMMON))


def by_namespace(tests: DataFrame, changed: DataFrame, least: int = 2) -> DataFrame:
    """Tests whose class holds at least two components of a changed path, repeated ones counted as often.

    A component lies anywhere in a class, so both are joined on the component's first ``GRAM`` letters and the
    runs of as many letters in the class, and then compared; short components on all their letters.
    """
    paths = changed.select("path").distinct()
    wanted = paths.select("path", F.explode(components(F.col("path"))).alias("part")).groupBy("path", "part").agg(F.count(F.lit(1)).alias("times"))
    wanted = wanted.withColumn("gram", F.substring("part", 1, GRAM))
    names = tests.select(F.lower(F.replace(class_of(F.col("test")), F.lit("\\"), F.lit("/"))).alias("name")).distinct()
    at = F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1)))
    grams = F.flatten(F.transform(at, lambda k: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring(F.col("name"), k, n))))
    held = names.select("name", F.explode(F.array_distinct(grams)).alias("gram")).join(wanted, "gram").filter(F.contains("name", F.col("part")))
    found = held.groupBy("name", "path").agg(F.sum("times").alias("n")).filter(F.col("n") >= least).select("name").distinct()
    return tests.withColumn("name", F.lower(F.replace(class_of(F.col("test")), F.lit("\\"), F.lit("/")))).join(found, "name", "left_semi").select("test").distinct()


def cascade(*levels: DataFrame) -> DataFrame:
    """The first level that has rows; those after it are not run. A level is staged, so that it runs once."""
    for level in levels[:-1]:
        found = staged(level, "level")
        if not found.isEmpty():
            return found
    return levels[-1]


def test_files(found: DataFrame, tests: DataFrame) -> DataFrame:
    return tests.join(found, "test", "left_semi").select("path").distinct()

"""Dependency graphs as edge tables: index, edges, and closure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.filters import class_of, is_test_class, short_name  # noqa: F401
from tidemark.session import discard, staged

#: Kinds of facts that make a dependency, by strategy.
STRATEGIES = {
    "conservative": ("use", "extends", "implements", "trait", "new", "static"),
    "moderate": ("use", "extends", "implements", "trait"),
    "minimal": ("use", "extends", "implements"),
}
#: Edges up to which a counted graph is walked in memory by each task; beyond it the frontier is joined.
SMALL_EDGES = 200_000
#: Pairs up to which a counted round is broadcast to pick its like out of the visited ones.
SMALL_ROUND = 200_000


def class_index(declared: DataFrame) -> DataFrame:
    """class_name, path: of several files that declare a class the last one, by ord."""
    return declared.groupBy(F.col("name").alias("class_name")).agg(F.max_by("path", "ord").alias("path"))


def file_classes(declared: DataFrame) -> DataFrame:
    return declared.groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("classes"))


def dependency_set(facts: DataFrame, strategy: str = "conservative") -> DataFrame:
    """path, dep_name: distinct names of the kinds that the strategy counts."""
    return facts.filter(F.col("kind").isin(*STRATEGIES[strategy])).select("path", F.col("name").alias("dep_name")).distinct()


def reverse_edges(deps: DataFrame, index: DataFrame) -> DataFrame:
    """dependency, dependent: who is affected by a change of a file. Names without an owner (such as include paths) drop out."""
    return deps.join(index.withColumnRenamed("path", "dependency"), deps.dep_name == F.col("class_name")).select("dependency", F.col("path").alias("dependent"))


def reverse_calls(calls: DataFrame) -> DataFrame:
    """callee -> caller, without calls on variables that were not resolved."""
    return calls.filter(~F.col("callee").contains("$")).select(F.col("callee").alias("dependency"), F.col("caller").alias("dependent"))


def closure(seeds: DataFrame, edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """root, node: all that each root reaches, itself included, over edges (dependency, dependent).

    Cycles, self edges, repeated edges and roots without edges are fine; edges and seeds with a null are left
    out. ``seeds`` has root and node. A graph of up to ``small`` distinct edges goes to the tasks, which walk it
    for their share of the roots; a larger one is joined with the frontier, round by round, each round staged.
    ``shortcuts`` take a round's frontier along chains, so a chain of n nodes needs about log2(n) rounds; where paths branch
    at every node, there is a round for each hop.
    """
    edges = staged(edges.filter("dependency is not null and dependent is not null and dependency <> dependent").select("dependency", "dependent").distinct(), "edges")
    seeds = seeds.select("root", "node").filter("root is not null and node is not null").distinct()
    if edges.count() <= small:
        return _walk(seeds, edges)
    for more in shortcuts(edges):
        edges = edges.unionByName(more)
    seen = [staged(seeds, "frontier")]
    while True:  # a round adds a pair at least, or is the last
        visited = seen[0]
        for more in seen[1:]:
            visited = visited.unionByName(more)
        reached = staged(seen[-1].join(edges, F.col("node") == F.col("dependency")).select("root", F.col("dependent").alias("node")).distinct(), "reached")
        # A small round picks what it has to compare with out of the visited pairs, which then are not shuffled.
        known = visited.join(F.broadcast(reached), ["root", "node"], "left_semi") if reached.count() <= SMALL_ROUND else visited
        new = staged(reached.join(known, ["root", "node"], "left_anti"), "frontier")
        discard(reached)
        if new.isEmpty():
            return visited
        seen.append(new)
        if len(seen) > 16:  # few parts to scan
            old, seen = seen[:-1], [staged(visited, "visited"), new]
            discard(*old)


def shortcuts(edges: DataFrame) -> list[DataFrame]:
    """Staged edges from each node to those 2, 4, 8, ... hops on, as long as all nodes between have one way on.

    What they lead to is reached anyway, so they change no closure. A table holds at most an edge for each node with one
    way on, and there are at most log2 of their number; chains that end soon drop out of the next table.
    """
    step = staged(edges.groupBy("dependency").agg(F.count(F.lit(1)).alias("n"), F.min("dependent").alias("dependent")).filter("n = 1").select("dependency", "dependent"), "chain")
    out: list[DataFrame] = []
    most, hops = step.count(), 1
    while hops < most:  # chains that bite their tail never end
        on = step.select(F.col("dependency").alias("dependent"), F.col("dependent").alias("further"))
        step = staged(step.join(on, "dependent").select("dependency", F.col("further").alias("dependent")), "shortcuts")
        if step.isEmpty():
            break
        out.append(step)
        hops *= 2
    return out


def _walk(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    known: dict = {}
    for r in edges.toLocalIterator():  # counted by the caller
        known.setdefault(r.dependency, []).append(r.dependent)
    shared = edges.sparkSession.sparkContext.broadcast(known)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = shared.value
        for pdf in frames:
            roots, nodes = [], []
            for root, start in pdf.groupby("root", sort=False)["node"]:
                found = dict.fromkeys(start)
                todo = list(found)
                while todo:
                    for x in to.get(todo.pop(), ()):
                        if x not in found:
                            found[x] = None
                            todo.append(x)
                roots += [root] * len(found)
                nodes += found
            yield pd.DataFrame({"root": pd.Series(roots, dtype=pdf["root"].dtype), "node": pd.Series(nodes, dtype=pdf["node"].dtype)})

    return seeds.mapInPandas(run, seeds.schema).distinct()


def affected(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """node: the closure of one set of seeds, given as (node)."""
    return closure(seeds.select(F.lit("").alias("root"), "node"), edges).select("node").distinct()


def one_hop(changed: DataFrame, index: DataFrame, deps: DataFrame) -> DataFrame:
    """path of the files that depend on a class of a changed file."""
    names = index.join(changed.select("path"), "path", "left_semi").select(F.col("class_name").alias("dep_name"))
    return deps.join(names, "dep_name", "left_semi").select("path").distinct()


def methods_to_files(methods: DataFrame, index: DataFrame) -> DataFrame:
    """item: file::method for each Class::method whose class has a file."""
    rows = methods.select("ord", class_of(F.col("method")).alias("class_name"), F.element_at(F.split("method", "::", 2), -1).alias("rest"))
    return rows.join(index, "class_name").select("ord", F.concat_ws("::", "path", "rest").alias("item"))


def affected_files(changed: DataFrame, reached: DataFrame, index: DataFrame) -> DataFrame:
    """path: the files that changed, and those of the classes whose methods are reached; functions have no class."""
    owners = reached.filter(F.col("method").contains("::")).select(class_of(F.col("method")).alias("class_name")).join(index, "class_name").select("path")
    return changed.select("path").unionByName(owners).distinct()


def full_names(names: DataFrame, index: DataFrame) -> DataFrame:
    """name: qualified names as they are, short ones as all classes of that last segment."""
    qualified = names.filter(F.col("name").contains("\\")).select("name")
    short = names.filter(~F.col("name").contains("\\")).select(F.col("name").alias("short"))
    return qualified.unionByName(index.withColumn("short", short_name(F.col("class_name"))).join(short, "short", "left_semi").select(F.col("class_name").alias("name"))).distinct()

"""Facts, calls and method lines of source files: one pass in Arrow batches, no shuffle.

Source files have path, ord and code (null: empty). Parsing needs imperative code, so it runs in Python,
a batch at a time; each file is parsed by itself and memory is bounded by a batch and its longest file.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.functions import facts as parse
from tidemark.functions import syntax


def _each(files: DataFrame, rows: Callable[[str], list[tuple]], columns: dict[str, str]) -> DataFrame:
    """A file that cannot be parsed has no rows and is named in the worker's log; it does not end the job."""
    names = ["path", "ord", *columns, "pos"]
    types = {"path": "string", "ord": files.schema["ord"].dataType.simpleString(), **columns, "pos": "int"}
    schema = StructType.fromDDL(", ".join(f"{n} {types[n]}" for n in names))
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for path, ord_, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = rows(code or "")
                except Exception as e:  # noqa: BLE001 - whatever a text does to the parser
                    print(f"[tidemark] {path} was not parsed: {e!r}", file=sys.stderr)
                    continue
                out[0] += [path] * len(found)
                out[1] += [ord_] * len(found)
                out[-1] += range(len(found))
                for column, values in zip(out[2:-1], zip(*found), strict=bool(found)):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, kinds, strict=True)], schema=kinds)

    return files.select("path", "ord", "code").mapInArrow(run, schema)


#: Parsers by name: a plain token scan, or facts as a syntax tree gives them.
PARSERS = {"token": parse.facts, "ast": syntax.facts}


def extract_facts(files: DataFrame, parser: str = "token") -> DataFrame:
    """path, ord, kind, name, pos. A parser of an unknown name is the token scan."""
    return _each(files, PARSERS.get(parser.lower(), parse.facts), {"kind": "string", "name": "string"})


def extract_calls(files: DataFrame) -> DataFrame:
    """path, ord, caller, callee, pos: a bag."""
    return _each(files, parse.calls, {"caller": "string", "callee": "string"})


def extract_method_lines(files: DataFrame) -> DataFrame:
    """path, ord, line, method, pos."""
    return _each(files, parse.method_lines, {"line": "int", "method": "string"})


def declared(facts: DataFrame) -> DataFrame:
    return facts.filter("kind = 'declared'").select("path", "ord", "name")


def includes(facts: DataFrame) -> DataFrame:
    """path, name: what is included, as it is written."""
    return facts.filter("kind = 'include'").select("path", "name")


def _normal(path: Column) -> Column:
    """A relative path without empty, ``.`` and, where there is a folder to leave, ``..`` segments."""

    def step(done: Column, part: Column) -> Column:
        leaves = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when(part.isin("", "."), done).when(leaves, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolved_includes(facts: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """path, dep_name: included files by their path in the project. Absolute paths are taken as they are, relative
    ones from the including file, and those that lead to no file of the project drop out."""
    top = root.rstrip("/") + "/"
    rows = includes(facts)
    absolute = rows.filter(F.startswith("name", F.lit("/"))).select("path", F.when(F.startswith("name", F.lit(top)), F.substring("name", len(top) + 1, 1 << 30)).otherwise(F.col("name")).alias("dep_name"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    relative = rows.filter(~F.startswith("name", F.lit("/"))).select("path", _normal(F.concat(folder, "name")).alias("dep_name"))
    return absolute.unionByName(relative.join(files.select(F.col("path").alias("dep_name")), "dep_name", "left_semi").select("path", "dep_name"))

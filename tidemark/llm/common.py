"""Shared plumbing of the corpus operators: tables, staged results, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import discard, shared_dir, staged  # noqa: F401

#: ASCII white space as the contracts name it: the blank and \x09 to \x0D.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Put bytes into a file of the shared folder, if it is not there yet, and give its path."""
    path = f"{shared_dir(spark)}/{name}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        out = fs.create(jpath, True)
        out.write(bytearray(data))
        out.close()
        fs.deleteOnExit(jpath)
    return path


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ids_repeat(df: DataFrame, id_col: str) -> bool:
    """Whether any two rows have one id (null ids count as equal). Only ids move."""
    return not df.groupBy(F.col(id_col).alias("id_")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a local relation, which costs no Python worker."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))
    columns = list(zip(*rows)) or [()] * len(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, kind, strict=True)], schema=kind), _parse_datatype_string(schema))


def map_batches(df: DataFrame, fn: Callable[[list[list]], list], schema: str, rows: int = 512) -> DataFrame:
    """``mapInArrow`` over lists of column values, ``rows`` rows at a time to bound a worker's memory.

    ``fn`` gets one list per input column and returns one list or array per output column.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = fn([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(made, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)

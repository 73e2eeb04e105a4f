"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from medlake.session import shared_dir

#: Rows of a side that may be broadcast after they were counted; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared folder, so that a lost executor loses nothing.

    DataFrame.checkpoint would keep the constraints of the old plan, which multiply from round to round of a loop.
    """
    return written(df, "cut")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, read as often as needed."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Column types that Python functions hand back, as Arrow types.
ARROW = {
    "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
    "array<array<int>>": pa.list_(pa.list_(pa.int32())),
}


def mapped(df: DataFrame, keep: list[str], read: list[str], make: Callable[[], Callable[..., dict[str, list]]], added: dict[str, str]) -> DataFrame:
    """Each row's columns `keep`, untouched, and the columns `added`, which a function makes of the lists of the columns `read`.

    make() gives that function once a task.  What is kept stays in Arrow, so that no value changes: nullable longs
    would become doubles in pandas.
    """
    schema = StructType([*df.select(*keep).schema, *StructType.fromDDL(", ".join(f"`{c}` {kind}" for c, kind in added.items()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(*(batch.column(c).to_pylist() for c in read))
            columns = [batch.column(c) for c in keep] + [pa.array(made[c], ARROW[kind]) for c, kind in added.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *added])

    return df.select(*dict.fromkeys([*keep, *read])).mapInArrow(run, schema)


def filtered(df: DataFrame, read: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows for which a function of the list of a column's values says so, all their columns untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            yield batch.filter(pa.array(work(batch.column(read).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


_HELD: dict[tuple, object] = {}


def held_model(make: Callable, *args: object) -> object:
    """make(*args), which a worker keeps until it is asked for another one: models of earlier operators don't add up."""
    key = (make, args)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make(*args)
    return _HELD[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only for a side whose row count was taken and is under the limit."""
    return F.broadcast(df) if rows <= limit else df


def arrow_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Bytes to a batch handed to Python, which bounds a worker's memory however long the texts; narrow rows go in large batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")

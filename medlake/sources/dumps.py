"""Dumps of whole tables as schemas and compressed records, and their restore."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from medlake.operators.archive import JSON_TIMES
from medlake.operators.groups import restore_check

#: Records of a file at most: a compressed file is read by one task.
FILE_RECORDS = 1_000_000
MANIFEST = "name string, rows long, high long, low long"


def _hash(df: DataFrame) -> Column:
    """A hash of a row: of each column's value, and of which are null, as a null adds nothing to a hash."""
    nested = (ArrayType, MapType, StructType, VariantType)
    values = [F.to_json(F.struct(f"`{f.name}`"), JSON_TIMES) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(*values, *(F.col(f"`{f.name}`").isNull() for f in df.schema))


def _content(df: DataFrame) -> list[Column]:
    """rows, high and low: the count of rows and two sums of halves of their hashes, whatever their order."""
    h = _hash(df)
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.shiftright(h, 32)).alias("high"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low")]


def dump(tables: dict[str, DataFrame], path: str) -> None:
    """Write each table's records as compressed JSON lines, then its schema, and last the manifest of all: rows and content hashes as they were written."""
    spark = next(iter(tables.values())).sparkSession
    told = []
    for name, df in tables.items():
        seen = Observation()
        options = {"compression": "gzip", "ignoreNullFields": "false", "maxRecordsPerFile": FILE_RECORDS, **JSON_TIMES}
        df.observe(seen, *_content(df)).write.mode("overwrite").options(**options).json(f"{path}/data/{name}")
        told.append((name, *(seen.get[k] for k in ("rows", "high", "low"))))
    schemas = spark.createDataFrame([(name, df.schema.json()) for name, df in tables.items()], "name string, schema string")
    schemas.coalesce(1).write.mode("overwrite").json(f"{path}/schemas")
    spark.createDataFrame(told, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a dump, with the types that they had; a record that cannot be read ends the restore."""
    schemas = {r.name: StructType.fromJson(json.loads(r.schema)) for r in spark.read.schema("name string, schema string").json(f"{path}/schemas").collect()}
    return {name: spark.read.schema(schema).options(mode="FAILFAST", **JSON_TIMES).json(f"{path}/data/{name}") for name, schema in sorted(schemas.items())}


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """name, rows and now_rows of the tables of a dump that do not come back as the manifest has them."""
    schemas = {r.name: StructType.fromJson(json.loads(r.schema)) for r in spark.read.schema("name string, schema string").json(f"{path}/schemas").collect()}
    # what cannot be read counts as lost here, so that all damage is listed
    found = {name: spark.read.schema(schema).options(mode="DROPMALFORMED", ignoreCorruptFiles="true", **JSON_TIMES).json(f"{path}/data/{name}") for name, schema in schemas.items()}
    return restore_check(_manifest(spark, path), _contents(found).drop("columns"))


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def _contents(tables: dict[str, DataFrame]) -> DataFrame:
    """name, columns, rows, high and low of each table, read once from its first to its last row."""
    parts = [df.agg(*_content(df)).select(F.lit(name).alias("name"), F.lit(len(df.columns)).cast("long").alias("columns"), "*") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def smoke_test(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows and columns of each table: that it can be read from its first to its last row."""
    return _contents(tables).where(F.col("high").isNotNull() | (F.col("rows") == 0)).select("name", "rows", "columns")


def restored(spark: SparkSession, path: str) -> DataFrame:
    """smoke_test() of a restored dump, and whether each table's contents are `whole`, those of the manifest; each file is read once."""
    now = _contents(restore(spark, path))
    said = _manifest(spark, path).select("name", *(F.col(c).alias(f"said_{c}") for c in ("rows", "high", "low")))
    whole = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"said_{c}")) for c in ("rows", "high", "low")))
    return now.join(said, "name", "left").select("name", "rows", "columns", whole.alias("whole"))

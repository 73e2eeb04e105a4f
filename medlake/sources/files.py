"""Readers and writers of the archive's files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from medlake.functions.scalars import extension, json_strings
from medlake.operators.hygiene import page_texts

DOCUMENTS = (".pdf", ".png", ".jpg", ".jpeg", ".txt", ".md", ".docx")
HIDDEN = "(^|/)[._][^/]*"


def folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = DOCUMENTS, modified_after: str | None = None) -> DataFrame:
    """Files below a folder by extension, hidden ones and those in hidden folders left out; contents are read only if selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    rows = reader.load(path)
    plain = F.regexp_replace("path", "^[^:]*:(//)?", "")
    top = re.sub("^[^:]*:(//)?", "", path.rstrip("/"))
    relative = F.substring(plain, F.lit(len(top) + 2), F.length(plain))
    return rows.where(extension(F.col("path")).isin(*extensions)).withColumn("relative", relative).where(~F.col("relative").rlike(HIDDEN))


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A record a line; lines that are none are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def content_text(c: str) -> Column:
    """Text of a message whose content is a string or a JSON list of blocks with text."""
    blocks = F.from_json(F.col(c), "array<struct<type string, text string>>")
    joined = F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull()), "\n")
    return F.when(F.col(c).startswith("["), F.coalesce(joined, F.col(c))).otherwise(F.col(c))


TRIAL = (
    "protocolSection struct<identificationModule: struct<nctId: string, briefTitle: string>, statusModule: struct<overallStatus: string>,"
    " designModule: struct<phases: array<string>>, conditionsModule: struct<conditions: array<string>>,"
    " contactsLocationsModule: struct<locations: array<struct<facility: string, city: string, country: string>>>>"
)


def trials(spark: SparkSession, path: str) -> DataFrame:
    """Clinical trials, a JSON document a file, as flat rows."""
    return _flat(spark.read.schema(TRIAL).option("multiLine", "true").json(path))


def trial_rows(df: DataFrame, column: str) -> DataFrame:
    """Clinical trials, a JSON document a row of a column, as flat rows."""
    return _flat(df.select(F.from_json(column, TRIAL).alias("__t")).select("__t.*"))


def _flat(s: DataFrame) -> DataFrame:
    """The first phase, and up to five places; parts of a place that are missing leave no gap."""
    s = s.select("protocolSection.*")
    places = F.transform(F.slice("contactsLocationsModule.locations", 1, 5), lambda x: F.concat_ws(", ", x["facility"], x["city"], x["country"]))
    return s.select(
        F.col("identificationModule.nctId").alias("trial"), F.col("identificationModule.briefTitle").alias("title"),
        F.col("statusModule.overallStatus").alias("status"), F.try_element_at("designModule.phases", F.lit(1)).alias("phase"),
        F.col("conditionsModule.conditions").alias("conditions"), places.alias("places"),
    )


def trial_entries(rows: DataFrame) -> DataFrame:
    """Trials as research entries: a summary in parts, and up to five conditions, the phase and the status as tags."""
    tags = F.array_compact(F.concat(F.slice(F.coalesce("conditions", F.array().cast("array<string>")), 1, 5), F.array(F.lower("phase"), F.lower("status"))))
    return rows.select(
        F.lit("trials").alias("source"), F.col("trial").alias("external_id"), "title",
        F.concat_ws(" | ", "status", "phase", F.array_join("places", "; ")).alias("summary"), F.to_json(tags).alias("tags"),
    )


def tags_of(c: str) -> Column:
    return json_strings(F.col(c))


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def manifest_records(tables: dict[str, tuple[DataFrame, list[str]]], most: int = 200) -> DataFrame:
    """name and record (JSON) of the first rows of each table, by the order given with it; a manifest lists `most` rows a table."""
    out = None
    for name, (df, order) in tables.items():
        part = df.orderBy(*order).limit(most).select(F.lit(name).alias("name"), F.to_json(F.struct(*df.columns)).alias("record"))
        out = part if out is None else out.unionByName(part)
    return out


def manifest_table(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    """One table of a manifest that write_manifest wrote."""
    rows = spark.read.schema("name string, record string").json(path).where(F.col("name") == name)
    return rows.select(F.from_json("record", schema).alias("r")).select("r.*")


def folders(rows: DataFrame) -> DataFrame:
    """path and name of each folder that holds a file of a listing (relative), the folders above it included; the top one is ''."""
    parts = F.split("relative", "/")
    each = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return rows.select(F.explode(each).alias("path")).distinct().withColumn("name", F.element_at(F.split("path", "/"), -1))


def export_rows(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Documents without a remote id and the folder, category/YYYY-MM, that they go to; with pages, also their text, joined by page number.

    A document without a date goes to `undated`; one without pages has no text.  The text is the heavy part and is made on a full run only.
    """
    month = F.coalesce(F.date_format("document_date", "yyyy-MM"), F.lit("undated"))
    rows = docs.where("remote_id is null").select("id", F.concat_ws("/", "category", month).alias("folder"))
    return rows if pages is None else rows.join(page_texts(pages), "id", "left")


def write_by_month(df: DataFrame, path: str, category: str, day: str) -> None:
    """One folder a category and month."""
    df.withColumn("year_month", F.date_format(day, "yyyy-MM")).write.mode("overwrite").partitionBy(category, "year_month").parquet(path)

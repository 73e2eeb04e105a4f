"""Document groups, tiers, runs and other upkeep of the archive's tables; every update is a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.operators import ordering
from medlake.operators.archive import broken_groups
from medlake.operators.naming import with_part


def members(docs: DataFrame, group: str, part: str, id_column: str) -> DataFrame:
    """Documents of each group with their place in it, by part number and id."""
    rows = docs.where(F.col(group).isNotNull())
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.asc_nulls_last(part), id_column)))


def split(docs: DataFrame, parts: DataFrame, least: float = 0.7) -> DataFrame:
    """The parts (id, part, category, confidence) of documents (id, filename) that are split, as rows of their own.

    A document is split if it has two parts or more and all have the confidence; its parts are named and numbered in
    order, share its id as their group, and point back to it.
    """
    fit = parts.groupBy("id").agg(F.count(F.lit(1)).alias("total"), F.min("confidence").alias("low")).where((F.col("total") >= 2) & (F.col("low") >= least))
    rows = docs.select("id", "filename").join(fit.select("id", "total"), "id").join(parts, "id")
    part = F.row_number().over(Window.partitionBy("id").orderBy("part"))
    rows = rows.withColumn("nth", part)
    return rows.select(
        F.col("id").alias("source_id"), F.col("id").alias("group_id"), F.col("nth").alias("part_number"), F.col("total").cast("int").alias("total_parts"), "category",
        with_part(F.col("filename"), F.col("nth"), F.col("total")).alias("filename"),
    )


def repaired(docs: DataFrame, group: str, day: str, place: str) -> DataFrame:
    """docs with the group and part columns of broken groups emptied, and the defect."""
    bad = broken_groups(docs.where(F.col(group).isNotNull()), group, day, place).select(group, "defect")
    rows = docs.join(bad, group, "left")
    return rows.withColumns({c: F.when(F.col("defect").isNull(), F.col(c)) for c in (group, "part_number", "total_parts") if c in docs.columns}).select(*docs.columns, "defect")


def reassigned(rows: DataFrame, ids: DataFrame, tenant: object, column: str = "tenant") -> DataFrame:
    """rows with the given ids moved to a tenant; rows that are there already stay unchanged."""
    moved = ids.select("id").distinct().withColumn("__moved", F.lit(True))
    return rows.join(moved, "id", "left").withColumn(column, F.when(F.col("__moved"), F.lit(tenant)).otherwise(F.col(column))).drop("__moved")


def after_onboarding(tenants: DataFrame, now: Column) -> DataFrame:
    """Tenants with the tier `free` where onboarding has ended; an unknown end never comes."""
    ended = (F.col("tier") == "free_onboarding") & (F.col("onboarding_ends_at") < now)
    return tenants.withColumn("tier", F.when(ended, "free").otherwise(F.col("tier")))


def history(audit: DataFrame, record: str, at: str, id_column: str) -> DataFrame:
    """Audit rows with their place in the history of their record, newest first."""
    return audit.withColumn("nth", F.row_number().over(Window.partitionBy(record).orderBy(F.desc(at), F.desc(id_column))))


def completed_runs(started: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs (run_id, started_at) with what is known of their end (run_id, finished_at, status); open ones are `running`."""
    rows = started.join(finished, "run_id", "left")
    seconds = F.col("finished_at").cast("timestamp").cast("double") - F.col("started_at").cast("timestamp").cast("double")
    return rows.select("run_id", "started_at", "finished_at", F.coalesce("status", F.lit("running")).alias("status"), F.round(seconds, 1).alias("duration_s"))


def cloned(base: DataFrame, reference: DataFrame, tenants: DataFrame, keys: list[str]) -> DataFrame:
    """base and a copy of each reference row for each tenant that lacks its key; as many rows as both sides multiply to, both being dimensions."""
    wanted = tenants.select("tenant").join(reference, F.lit(True))
    return base.unionByName(wanted.join(base.select("tenant", *keys), ["tenant", *keys], "left_anti").select(base.columns))


def unexpected(listing: DataFrame, documents: DataFrame, suffix: str = "_OCR.txt") -> DataFrame:
    """Companion files of a listing (name) that belong to no document (filename)."""
    expected = documents.select(F.concat(F.regexp_replace("filename", "(?<=.)\\.[^.]*$", ""), F.lit(suffix)).alias("name"))
    return listing.where(F.col("name").endswith(suffix)).join(expected, "name", "left_anti")


def package(docs: DataFrame, events: DataFrame) -> DataFrame:
    """One row a tenant: documents as a map of category to names in order, and the timeline of events as a list."""
    by = docs.groupBy("tenant", "category").agg(F.array_sort(F.collect_list("filename")).alias("names"))
    shelves = by.groupBy("tenant").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "names")))).alias("documents"))
    line = events.groupBy("tenant").agg(F.array_sort(F.collect_list(F.struct("day", "title"))).alias("timeline"))
    return shelves.join(line, "tenant", "full_outer")


def package_rows(docs: DataFrame, events: DataFrame) -> DataFrame:
    """package() as rows (tenant, shelf, nth from 1, entry), for tenants of any size: a shelf for each category and the shelf `timeline`."""
    shelves = docs.select("tenant", F.concat(F.lit("documents/"), F.coalesce("category", F.lit(""))).alias("shelf"), F.col("filename").alias("entry"))
    line = F.concat_ws(" ", F.date_format("day", "yyyy-MM-dd"), "title")
    rows = shelves.unionByName(events.select("tenant", F.lit("timeline").alias("shelf"), line.alias("entry")))
    return ordering.placed(rows, ["tenant", "shelf"], ["entry"]).select("tenant", "shelf", "nth", "entry")


def restore_check(manifest: DataFrame, restored: DataFrame) -> DataFrame:
    """Tables of a manifest whose restored form differs in rows or content, or is not there."""
    now = restored.select("name", F.col("rows").alias("now_rows"), F.col("high").alias("now_high"), F.col("low").alias("now_low"))
    same = F.col("rows").eqNullSafe(F.col("now_rows")) & F.col("high").eqNullSafe(F.col("now_high")) & F.col("low").eqNullSafe(F.col("now_low"))
    return manifest.join(now, "name", "left").where(~same).select("name", "rows", "now_rows")


def context(tenants: DataFrame, stored: DataFrame, files: DataFrame, default: str) -> DataFrame:
    """The context of each tenant: the stored one, else that of its file, else the default."""
    a, b = stored.select("tenant", F.col("context").alias("stored")), files.select("tenant", F.col("context").alias("file"))
    rows = tenants.select("tenant").join(a, "tenant", "left").join(b, "tenant", "left")
    origin = F.when(F.col("stored").isNotNull(), "stored").when(F.col("file").isNotNull(), "file").otherwise("default")
    return rows.select("tenant", F.coalesce("stored", "file", F.lit(default)).alias("context"), origin.alias("origin"))

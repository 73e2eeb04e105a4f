"""Table services: what the archive does to its tables, as new states of them.

Each function takes the state of a table and gives the next one; writing it is the
caller's step, so a failed job leaves the old state whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medlake.session import if_few


def insert_within_quota(base: DataFrame, rows: DataFrame, tenant: str, order: list[str], quota: int = 200) -> DataFrame:
    """base and the new rows, as far as each tenant's quota of rows goes; the first by order come in."""
    held = base.groupBy(tenant).agg(F.count(F.lit(1)).alias("__held"))
    nth = F.row_number().over(Window.partitionBy(tenant).orderBy(*order))
    fit = rows.withColumn("__nth", nth).join(held, tenant, "left").where(F.col("__nth") + F.coalesce("__held", F.lit(0)) <= quota)
    return base.unionByName(fit.drop("__nth", "__held"))


def insert_or_replace(base: DataFrame, rows: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """base with the rows of each key replaced by its new row; of several new rows the first by `newest` counts."""
    w = Window.partitionBy(*keys).orderBy(*newest)
    last = rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last)


def latest_state(log: DataFrame, keys: list[str], at: list[Column], deleted: str) -> DataFrame:
    """The live rows of a log of changes: the newest of each key, without those whose newest change is a deletion."""
    w = Window.partitionBy(*keys).orderBy(*at)
    return log.withColumn("__nth", F.row_number().over(w)).where(f"__nth = 1 and not `{deleted}`").drop("__nth")


def close_stale(runs: DataFrame, as_of: Column, minutes: int = 10) -> DataFrame:
    """Runs that have been `running` for longer become `timeout`, with the time at which that was seen."""
    stale = (F.col("status") == "running") & (F.col("started_at") < as_of - F.make_interval(mins=F.lit(minutes)))
    return runs.withColumns({"finished_at": F.when(stale, as_of).otherwise(F.col("finished_at")), "status": F.when(stale, "timeout").otherwise(F.col("status"))})


def retain(df: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last so many days; a row without a time stays."""
    return df.where(F.col(column).isNull() | (F.col(column) >= as_of - F.make_interval(days=F.lit(days))))


def rekey(df: DataFrame, mapping: DataFrame, column: str, old: str = "old", new: str = "new") -> DataFrame:
    """The ids of a column replaced through a mapping (old, new); ids without an entry stay."""
    m = mapping.select(F.col(old).alias(column), F.col(new).alias("__new"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("__new", column)).select(df.columns)


def once_only(events: DataFrame, keys: list[str], kind: str, once: list[str], order: list[str]) -> DataFrame:
    """Events, where those of the kinds in `once` count a single time for their keys; null keys are a key of their own."""
    w = Window.partitionBy(*keys, kind).orderBy(*order)
    nth = F.row_number().over(w)
    return events.withColumn("__nth", nth).where((F.col("__nth") == 1) | ~F.coalesce(F.col(kind).isin(once), F.lit(False))).drop("__nth")


def recover_owners(rows: DataFrame, owners: DataFrame, key: str, owner: str, sentinel: str) -> DataFrame:
    """Rows without an owner get that of the record they point to, else the sentinel; `how` tells kept, recovered or sentinel."""
    known = owners.select(F.col(key), F.col(owner).alias("__owner"))
    lacks = F.coalesce(F.col(owner) == "", F.lit(True))
    how = F.when(~lacks, "kept").when(F.col("__owner").isNotNull(), "recovered").otherwise("sentinel")
    joined = rows.join(known, key, "left").withColumn("how", how)
    found = F.when(F.col("how") == "kept", F.col(owner)).when(F.col("how") == "recovered", F.col("__owner")).otherwise(sentinel)
    return joined.withColumn(owner, found).select(*rows.columns, "how")


def in_chunks(rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, chunks: int = 64, most: int | None = None) -> int:
    """work(rows) written chunk by chunk, a chunk being a share of the key's hashes; the number of chunks that are left.

    A chunk that is done has its mark beside it and is passed over, so that a run goes on where one before it broke
    off; a chunk without its mark is written again from the start.  `most` chunks are done at once.
    """
    spark = rows.sparkSession
    done = {r.chunk for r in _progress(spark, path).collect()}
    left = [k for k in range(chunks) if k not in done]
    for k in left[:most]:
        part = rows.where(F.pmod(F.xxhash64(key), F.lit(chunks)) == k)
        work(part).write.mode("overwrite").parquet(f"{path}/rows/chunk={k}")
        n = spark.read.parquet(f"{path}/rows/chunk={k}").count()
        spark.createDataFrame([(k, n)], PROGRESS).coalesce(1).write.mode("append").json(f"{path}/progress")
    return len(left[most:]) if most is not None else 0


PROGRESS = "chunk int, rows long"


def _progress(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(PROGRESS).json(f"{path}/progress")
    except AnalysisException:  # no chunk is done yet
        return spark.createDataFrame([], PROGRESS)


def chunks_done(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all chunks that are done."""
    paths = [f"{path}/rows/chunk={r.chunk}" for r in _progress(spark, path).collect()]
    return spark.read.parquet(*paths)


def extracted_values(documents: DataFrame, metadata: str, fallback: str) -> DataFrame:
    """Lab values of the JSON of each document: the block's date, the metadata's or the document's; what is no number is left out."""
    schema = "struct<date string, labs array<struct<date string, parameter string, value string, unit string>>>"
    rows = documents.withColumn("__m", F.from_json(metadata, schema)).withColumn("__x", F.explode("__m.labs"))
    day = F.coalesce(*(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date") for c in (F.col("__x.date"), F.col("__m.date"))), F.col(fallback).cast("date"))
    value = F.expr("try_cast(replace(trim(__x.value), ',', '.') as double)")
    out = rows.select("id", F.col("__x.parameter").alias("parameter"), day.alias("lab_date"), value.alias("value"), F.col("__x.unit").alias("unit"))
    return out.where("value is not null and parameter is not null")


def may_group(parts: DataFrame, group: str, day: str, place: str, confidence: str, taken: str, least: float = 0.7, most_days: int = 7) -> DataFrame:
    """Whether proposed groups may be formed: sure enough, within so many days, of one institution, no member grouped already."""
    g = parts.groupBy(group).agg(
        F.min(confidence).alias("confidence"), F.datediff(F.max(day), F.min(day)).alias("span"), F.count_distinct(F.trim(place)).alias("places"),
        F.count(taken).alias("grouped"), F.count(F.lit(1)).alias("members"),
    )
    fits = (F.col("members") >= 2) & (F.col("confidence") >= least) & (F.coalesce("span", F.lit(0)) <= most_days) & (F.col("places") <= 1) & (F.col("grouped") == 0)
    return g.withColumn("fits", F.coalesce(fits, F.lit(False)))


def pipeline_totals(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs, successes, failures, moved records and mean duration (one place) of each group; a missing count adds nothing."""
    moved = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("failed"),
        moved("imported").alias("imported"), moved("exported").alias("exported"), F.round(F.avg("duration"), 1).alias("avg_duration"),
    )


def pipeline_report(runs: DataFrame, docs: DataFrame, is_done: Column) -> DataFrame:
    """pipeline_totals() over all runs given, and how many documents are done and pending; one row."""
    state = docs.agg(F.count_if(is_done).alias("done"), F.count_if(~F.coalesce(is_done, F.lit(False))).alias("pending"))
    return pipeline_totals(runs, []).join(F.broadcast(state), F.lit(True))  # one row each


def error_histogram(rows: DataFrame, by: str, error: str) -> DataFrame:
    """A map from error class to count for each group, by class name."""
    n = rows.where(F.col(error).isNotNull()).groupBy(by, error).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(error, "n")))).alias("errors"))


def duplicate_siblings(folders: DataFrame, parent: str, name: str, id_column: str) -> DataFrame:
    """Children of one parent whose names agree but for case, with their ids in order."""
    g = folders.groupBy(parent, F.lower(name).alias("folded")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(id_column)).alias("ids"))
    return g.where("n >= 2")


def misplaced_folders(folders: DataFrame, categories: list[str]) -> DataFrame:
    """Month folders (id, parent, name) below another month or below what is no category; an unknown parent is the root."""
    above = folders.select(F.col("id").alias("parent"), F.col("name").alias("above"))
    month = "^\\d{4}-\\d{2}$"
    rows = folders.where(F.col("name").rlike(month)).join(above, "parent", "left").where("above is not null")
    why = F.when(F.col("above").rlike(month), "month_in_month").when(~F.col("above").isin(categories), "no_category")
    return rows.withColumn("why", why).where("why is not null")


def checklist(latest: DataFrame, items: DataFrame, tenant: str = "tenant", parameter: str = "parameter") -> DataFrame:
    """Each item of a list (parameter, low, high) for each tenant: ok, out_of_range or missing.  The list is a fixed dimension."""
    every = latest.select(tenant).distinct().join(if_few(items))
    rows = every.join(latest, [tenant, parameter], "left")
    out = F.coalesce(F.col("latest") < F.col("low"), F.lit(False)) | F.coalesce(F.col("latest") > F.col("high"), F.lit(False))
    return rows.withColumn("state", F.when(F.col("latest").isNull(), "missing").when(out, "out_of_range").otherwise("ok"))


def without_baseline(events: DataFrame, labs: DataFrame, tenant: str, kind: str, day: str, lab_day: str, first_kind: str) -> DataFrame:
    """Tenants whose first event of a kind has no lab value on or before its day."""
    first = events.where(F.col(kind) == first_kind).groupBy(tenant).agg(F.min(day).alias("first_day"))
    earliest = labs.groupBy(tenant).agg(F.min(lab_day).alias("first_lab"))
    return first.join(earliest, tenant, "left").where(F.col("first_lab").isNull() | (F.col("first_lab") > F.col("first_day")))


def with_labs(events: DataFrame, labs: DataFrame, tenant: str, day: str, lab_day: str) -> DataFrame:
    """Events with the lab values of their tenant and day as a JSON object by parameter, `{}` without any."""
    packed = labs.groupBy(tenant, F.col(lab_day).alias(day)).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("parameter", "value")))).alias("__labs"))
    return events.join(packed, [tenant, day], "left").withColumn("labs", F.coalesce(F.to_json("__labs"), F.lit("{}"))).drop("__labs")


def stored_state(incoming: DataFrame, stored: DataFrame, document: str, parameter: str, tenant: str, day: str) -> DataFrame:
    """Incoming lab values as stored (same document and parameter), collision (another document of that day has it) or new."""
    mine = stored.select(document, parameter).distinct().withColumn("__mine", F.lit(True))
    others = stored.groupBy(tenant, parameter, day).agg(F.min(document).alias("__low"), F.max(document).alias("__high"))
    rows = incoming.join(mine, [document, parameter], "left").join(others, [tenant, parameter, day], "left")
    other = (F.col("__low") != F.col(document)) | (F.col("__high") != F.col(document))
    state = F.when(F.col("__mine"), "stored").when(F.coalesce(other, F.lit(False)), "collision").otherwise("new")
    return rows.withColumn("state", state).drop("__mine", "__low", "__high")

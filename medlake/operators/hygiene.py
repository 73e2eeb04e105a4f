"""Completeness of documents: the flag matrix, its filters, gap counters and work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.functions.scalars import all_of, reasons
from medlake.operators.naming import is_standard_name

#: Types that can be read.
EXTRACTABLE = ("application/pdf", "image/jpeg", "image/png", "image/webp", "image/heic", "text/plain")
FLAGS = ("has_ocr", "has_ai", "has_metadata", "is_synced", "is_standard", "has_date", "has_institution")
#: Filters of the matrix, and the flag whose rows they leave out.
FILTERS = {
    "missing_ocr": "has_ocr", "missing_ai": "has_ai", "missing_metadata": "has_metadata", "missing_date": "has_date", "missing_institution": "has_institution",
    "not_synced": "is_synced", "not_renamed": "is_standard", "incomplete": "complete", "all": None,
}


def extractable(c: str = "mime") -> Column:
    """Types that can be read; an unknown type may be."""
    return F.col(c).isNull() | (F.col(c) == "") | F.col(c).isin(*EXTRACTABLE)


def flags(docs: DataFrame, pages: DataFrame, person: str) -> DataFrame:
    """docs (id, filename, mime, summary, metadata, remote_id, document_date, institution, …) with the seven flags and `complete`; pages (id) are read pages."""
    read = pages.select("id").distinct().withColumn("__read", F.lit(True))
    rows = docs.join(read, "id", "left").withColumns(
        {
            "has_ocr": F.col("__read").isNotNull(), "has_ai": F.col("summary").isNotNull(), "has_metadata": F.coalesce(F.col("metadata") != "", F.lit(False)),
            "is_synced": F.col("remote_id").isNotNull(), "is_standard": is_standard_name(F.col("filename"), person), "has_date": F.col("document_date").isNotNull(),
            "has_institution": F.col("institution").isNotNull(),
        }
    )
    every = F.lit(True)
    for f in FLAGS:
        every = every & F.col(f)
    return rows.drop("__read").withColumn("complete", every)


def stage_counts(docs: DataFrame, person: str) -> DataFrame:
    """One row: documents in all and past each stage, and past all of them; an empty text counts as missing. The names of the counts are fixed values."""
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    stages = {
        "with_ai_summary": some("summary"), "with_structured_metadata": some("metadata"), "with_date": F.col("document_date").isNotNull(), "with_institution": some("institution"),
        "synced_to_gdrive": some("remote_id"), "standard_filename": is_standard_name(F.col("filename"), person),
    }
    return docs.agg(F.count(F.lit(1)).alias("total_documents"), *(F.count_if(c).alias(n) for n, c in stages.items()), F.count_if(all_of(list(stages.values()))).alias("fully_complete"))


def matrix(flagged: DataFrame, by: str = "all", limit: int | None = None, offset: int = 0) -> DataFrame:
    """The rows that a filter keeps, by id; filtered first and then cut to a page, where a limit is given."""
    rows = flagged.where(~F.col(FILTERS[by])) if FILTERS[by] else flagged
    rows = rows.select("id", F.substring("filename", 1, 60).alias("filename"), *FLAGS, "complete")
    return rows if limit is None else rows.orderBy("id").offset(offset).limit(limit)


def matrices(flagged: DataFrame) -> DataFrame:
    """The rows of all filters at once, as kept_by and the columns of matrix(); each document is read once and repeated for every filter that keeps it."""
    kept = F.array_compact(F.array(*(F.lit(name) if not flag else F.when(~F.col(flag), F.lit(name)) for name, flag in FILTERS.items())))
    return flagged.select(F.explode(kept).alias("kept_by"), "id", F.substring("filename", 1, 60).alias("filename"), *FLAGS, "complete")


def matrix_summary(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(f).alias(f"n_{f}") for f in (*FLAGS, "complete")))


def audited(flagged: DataFrame) -> DataFrame:
    """Flags as the gap audit counts them: documents with summary and metadata count as read, and types that cannot be read lack nothing."""
    can = extractable()
    ocr = F.col("has_ocr") | (F.col("has_ai") & F.col("has_metadata"))
    rows = flagged.withColumns({"extractable": can, "has_ocr": ocr})
    extracted = ~F.col("extractable") | (F.col("has_ocr") & F.col("has_ai") & F.col("has_metadata"))
    whole = extracted & F.col("has_date") & F.col("has_institution") & F.col("is_synced") & F.col("is_standard")
    why = reasons(
        no_ocr=F.col("extractable") & ~F.col("has_ocr"), no_ai=F.col("extractable") & ~F.col("has_ai"), no_metadata=F.col("extractable") & ~F.col("has_metadata"),
        no_date=~F.col("has_date"), no_institution=~F.col("has_institution"), not_synced=~F.col("is_synced"), not_standard_named=~F.col("is_standard"),
    )
    return rows.withColumns({"fully_complete": whole, "reasons": why})


def gap_counters(flagged: DataFrame) -> DataFrame:
    """The eleven counters of the gap audit over docs that also have `outside` and `sync_state`."""
    a = audited(flagged)
    n = lambda c, name: F.count_if(c).alias(name)
    can = F.col("extractable")
    return a.agg(
        n(can & ~F.col("has_ocr"), "missing_ocr"), n(can & ~F.col("has_ai"), "missing_ai"), n(can & ~F.col("has_metadata"), "missing_metadata"), n(~can, "non_extractable_skipped"),
        n(~F.col("has_date"), "missing_date"), n(~F.col("has_institution"), "missing_institution"), n(~F.col("is_synced"), "not_synced"), n(~F.col("is_standard"), "not_standard_named"),
        n(F.col("outside"), "external_location"), n(F.coalesce(F.col("sync_state") == "deleted_remote", F.lit(False)), "deleted_remote"), n(F.col("fully_complete"), "fully_complete"),
    )


def stuck(flagged: DataFrame, n: int | None = None) -> DataFrame:
    """Incomplete documents with their reasons, by id; the first n where a sample is wanted."""
    rows = audited(flagged).where(~F.col("fully_complete") & (F.size("reasons") > 0)).select("id", "reasons")
    return rows if n is None else rows.orderBy("id").limit(n)


def gap_list(flagged: DataFrame, foldered: Column) -> DataFrame:
    """Live documents with what keeps them from being in order: name, export, summary, reading, folder."""
    why = reasons(
        non_standard_name=~F.col("is_standard"), not_exported=~F.col("is_synced"), no_summary=~F.col("has_ai"), no_ocr=~F.col("has_ocr"), not_in_folder=~foldered,
    )
    return flagged.select("id", why.alias("reasons")).where(F.size("reasons") > 0)


def metadata_queue(docs: DataFrame) -> DataFrame:
    """Documents whose metadata are null, empty or unreadable, or name neither findings nor diagnoses."""
    some = lambda f: F.coalesce(F.size(F.from_json(F.get_json_object("metadata", f"$.{f}"), "array<string>")) > 0, F.lit(False))
    return docs.where(F.col("metadata").isNull() | (F.col("metadata") == "") | ~(some("findings") | some("diagnoses")))


def unprocessed(docs: DataFrame, column: str = "processed_at") -> DataFrame:
    return docs.where(F.col(column).isNull())


def pending_sync(docs: DataFrame) -> DataFrame:
    """Documents without a remote id, or marked as pending."""
    return docs.where(F.col("remote_id").isNull() | (F.col("sync_state") == "pending"))


def page_counts(pages: DataFrame, least: int = 2) -> DataFrame:
    """Documents with at least so many pages."""
    return pages.groupBy("id").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)


def page_texts(pages: DataFrame) -> DataFrame:
    """The pages of each document joined by page number."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"])
    return pages.groupBy("id").agg(F.array_join(ordered, "\n").alias("text"))


def missing_upstream(ours: DataFrame, remote: DataFrame) -> DataFrame:
    """Our documents that the remote listing (remote_id, root, trashed) does not show in its place: external, deleted_remote or missing; nothing is removed."""
    theirs = remote.select("remote_id", F.col("root").alias("their_root"), "trashed", F.lit(True).alias("listed"))
    rows = ours.where("remote_id is not null").join(theirs, "remote_id", "left")
    state = F.when(F.col("listed").isNull(), "missing").when(F.col("trashed"), "deleted_remote").when(F.col("their_root") != F.col("root"), "external")
    return rows.withColumn("state", state).where("state is not null").select("id", "remote_id", "state")

"""Incremental forms of the analytics: event-time counts, dedup and rolling rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch)).parquet(path)


def daily_counts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Events of each day; a day is final once the watermark has passed it."""
    days = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("calls"))
    return days.select(F.col("window.start").cast("date").alias("day"), "calls")


def once(events: DataFrame, key: str, lateness: str = "7 days") -> DataFrame:
    """The first arrival of each key within the lookback, of polls that overlap."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def rates(events: DataFrame, by: str, length: str = "60 seconds", step: str = "10 seconds", most: int = 120) -> DataFrame:
    """Keys with more events than allowed in a sliding window."""
    n = events.withWatermark("ts", length).groupBy(by, F.window("ts", length, step)).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") > most).select(by, F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, by: str, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """Sessions of each key that end with a gap."""
    s = events.withWatermark("ts", lateness).groupBy(by, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def classify(arrived: DataFrame, known: DataFrame, *more: str) -> DataFrame:
    """Arrived files (id, modified, md5, name) against known ones, with more columns of these: new, unchanged, renamed or updated."""
    old = known.select("id", F.col("modified").alias("was"), F.col("md5").alias("was_md5"), F.col("name").alias("was_name"), *more)
    state = (
        F.when(F.col("was").isNull(), "new")
        .when(F.col("modified") <= F.col("was"), "unchanged")
        .when(F.col("md5").eqNullSafe(F.col("was_md5")), F.when(F.col("name") == F.col("was_name"), "unchanged").otherwise("renamed"))
        .otherwise("updated")
    )
    return arrived.join(old, "id", "left").withColumn("state", state).drop("was", "was_md5", "was_name")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that has arrived to Parquet and stop; the next call goes on from there."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def once_for_ever(events: DataFrame, keys: list[str], kind: str, once: list[str]) -> DataFrame:
    """The first arrival of each key and kind, of the kinds that count a single time; the state keeps every key, as the funnel has few kinds."""
    return events.where(F.col(kind).isin(once)).dropDuplicates([*keys, kind])


def cache_misses(calls: DataFrame, key: str, ttl: str = "30 days") -> DataFrame:
    """Successful calls that no response of the same key from within the time to live could have answered; later ones are hits and go.

    The state holds one time a live key and drops it when the watermark has passed its end.
    """
    return once(calls.where("status = 'ok'"), key, ttl)

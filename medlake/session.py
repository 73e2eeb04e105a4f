"""Sessions and table access."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "medlake", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings override."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a side that may be broadcast once they were counted; beyond it the join is Spark's to plan.
FEW = 100_000


def if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, to be broadcast if it was counted and has `most` rows or fewer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows and bytes of a hash partition that dealt() aims at.
PART_ROWS = 250_000
PART_BYTES = 64 << 20


def dealt(df: DataFrame, rows: int, *keys: str, size: int = 0) -> DataFrame:
    """df by hash of keys, in as many partitions as its counted rows, of `size` bytes in all, need.

    Adaptive execution joins partitions by their compressed bytes, of which rows that are much alike have few, so that
    the memory of a task would grow with how well they compress.  With fewer partitions than the session's number a
    join would shuffle once more.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // PART_ROWS), -(-size // PART_BYTES)), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode alone, a folder of our own where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="medlake-"))
    return sc.getCheckpointDir()

"""Tables that batches of a stream change, each batch once: imports, reconciliation in cycles, and audit rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from medlake.operators.relations import _cut
from medlake.session import PART_ROWS
from medlake.streaming.streams import classify


class StoredTable:
    """A table in hash buckets of its key.

    A batch writes the buckets that it touches anew, and then a manifest that says which batch holds each bucket.  The
    manifest is what counts: a batch that broke off before it is written again from the start, one that comes again
    after it is passed over, and readers see whole batches only.  `buckets` bounds what passes through the driver.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), jvm.org.apache.hadoop.fs.Path

    def _exists(self, name: str) -> bool:
        files, path = self._files()
        return files.exists(path(f"{self.path}/{name}"))

    def batches(self) -> list[int]:
        """Numbers of the batches that were finished, in order."""
        files, path = self._files()
        if not self._exists("manifest"):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path(f"{self.path}/manifest"))]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and self._exists(f"manifest/{n}/_SUCCESS"))

    def manifest(self) -> dict[int, int]:
        """The batch that holds each bucket."""
        done = self.batches()
        if not done:
            return {}
        rows = self.spark.read.schema("bucket int, held int").json(f"{self.path}/manifest/batch={done[-1]}").collect()
        return {r.bucket: r.held for r in rows}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some."""
        held = [f"{self.path}/data/batch={k}/bucket={b}" for b, k in self.manifest().items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*held) if held else self.spark.createDataFrame([], self.schema)

    def change(self, rows: DataFrame, batch: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Replace the buckets that rows fall into by merge(their rows in the table, rows); whether this batch was not there yet."""
        done = self.batches()
        if done and batch <= done[-1]:
            return False
        touched = [r[0] for r in rows.select(self.bucket()).distinct().collect()]
        if touched:
            old = self.read(touched)
            merged = merge(old, rows).select(*self.schema.names).withColumn("bucket", self.bucket())
            shares = 1 + (old.count() + rows.count()) // (len(touched) * PART_ROWS)  # tasks that write a bucket
            merged.repartition(len(touched) * shares, "bucket", F.pmod(F.hash(self.key), F.lit(shares))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
        held = {b: k for b, k in self.manifest().items() if b not in touched} | {b: batch for b in touched if self._exists(f"data/batch={batch}/bucket={b}")}
        self.spark.createDataFrame(list(held.items()), "bucket int, held int").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/batch={batch}")
        return True


LISTING = "id long, name string, modified timestamp, md5 string"
#: What the table of imported files holds besides the listing.
IMPORTED = StructType(
    [
        StructField("id", LongType()), StructField("name", StringType()), StructField("modified", TimestampType()), StructField("md5", StringType()),
        *(StructField(c, IntegerType()) for c in ("first_batch", "last_batch", "removed_at")),
    ]
)


def _latest(listing: DataFrame) -> DataFrame:
    """One row an id: the one modified last, of equals the greatest name and md5."""
    return listing.groupBy("id").agg(F.max(F.struct("modified", "name", "md5")).alias("x")).select("id", "x.name", "x.modified", "x.md5")


def _merged(old: DataFrame, new: DataFrame, batch: int) -> DataFrame:
    """Old rows with classified ones merged in: contents change with `updated`, names with `renamed` too; a file that is listed again is no longer removed."""
    mine = new.select("id", *(F.col(c).alias(f"n_{c}") for c in ("name", "modified", "md5", "state")))
    taken = F.col("n_state").isin("new", "updated", "renamed")
    pick = lambda c: F.when(taken, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    gone = F.col("n_state") == "removed"
    return old.join(mine, "id", "full_outer").select(
        "id", pick("name"), pick("modified"), pick("md5"), F.coalesce("first_batch", F.lit(batch)).alias("first_batch"),
        F.when(taken, F.lit(batch)).otherwise(F.col("last_batch")).alias("last_batch"),
        F.when(gone, F.lit(batch)).when(F.col("n_state").isNotNull(), F.lit(None).cast("int")).otherwise(F.col("removed_at")).alias("removed_at"),
    )


def import_batch(store: StoredTable, listing: DataFrame, batch: int, full: Callable[[int, bool], bool] = lambda batch, changed: False) -> bool:
    """Bring a listing (id, name, modified, md5) into the table; counts by state stand beside it.  Whether the batch was not there yet.

    Only buckets of new or changed files are read and written, unless full(batch, whether anything is new or updated)
    asks for the whole: then the listing is complete, and files that it lacks are marked as removed.
    """
    done = store.batches()
    if done and batch <= done[-1]:
        return False
    arrived = _cut(_latest(listing))  # read up to four times, as are the states
    buckets = [r[0] for r in arrived.select(store.bucket()).distinct().collect()]
    known = store.read(buckets)
    states = _cut(classify(arrived, known, "removed_at"))
    counts = {r.state: r.n for r in states.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = states.where("state <> 'unchanged' or removed_at is not null").drop("removed_at")
    if full(batch, bool(counts.get("new") or counts.get("updated"))):
        missing = _cut(store.read().where("removed_at is null").join(arrived.select("id"), "id", "left_anti").select("id", "name", "modified", "md5", F.lit("removed").alias("state")))
        counts["removed"] = missing.count()
        rows = rows.unionByName(missing)
    told = store.spark.createDataFrame([(batch, s, n) for s, n in counts.items() if n], "batch int, state string, n long")
    told.coalesce(1).write.mode("overwrite").json(f"{store.path}/counts/batch={batch}")
    return store.change(rows, batch, lambda old, new: _merged(old, new, batch))


def counts(store: StoredTable) -> DataFrame:
    """batch, state and n of all batches."""
    return store.spark.read.schema("batch int, state string, n long").json(f"{store.path}/counts/*")


def every(n: int = 6) -> Callable[[int, bool], bool]:
    """Full reconciliation on each n-th batch, counted from 1, and whenever anything is new or updated."""
    return lambda batch, changed: changed or (batch + 1) % n == 0


def audit(path: str, most: int | None = None) -> Callable[[DataFrame, int], None]:
    """What appends calls (id, ts, ...) of a batch to the audit rows, once however often the batch comes.

    Of a batch with more than `most` calls the oldest are dropped, and counted: the metrics beside the rows hold
    total, kept and dropped of each batch, observed while it is written.
    """

    def write(rows: DataFrame, batch: int) -> None:
        seen, kept = Observation(f"seen-{batch}"), Observation(f"kept-{batch}")
        out = rows.observe(seen, F.count(F.lit(1)).alias("n"))
        if most is not None:
            out = out.orderBy(F.desc("ts"), F.desc("id")).limit(most)
        out.observe(kept, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        total, n = seen.get["n"], kept.get["n"]
        told = rows.sparkSession.createDataFrame([(batch, total, n, total - n)], "batch int, total long, kept long, dropped long")
        told.coalesce(1).write.mode("overwrite").json(f"{path}/metrics/batch={batch}")

    return write

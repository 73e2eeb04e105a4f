"""A positional index of texts, and phrase queries over it.

The index is a table term -> (id, field, text, positions), stored in hash buckets of the term.
A batch of queries is a table too: its words meet the postings of their buckets, and a
phrase stands where its words have neighbouring positions of one text, in their order.
Texts are read when the index is built, and not again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from medlake.functions.scalars import fold
from medlake.session import if_few

#: Buckets of an index; one of many terms and texts takes more.
BUCKETS = 16
SCHEMA = "term string, id long, field string, text long, positions array<int>, bucket int"


def terms(c: Column) -> Column:
    """The words of a text without case and diacritics, in order: runs of letters and digits."""
    return F.filter(F.split(fold(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _bucket(c: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of postings() of texts that come as lists of words; words are sorted as numbers, a batch at once."""
    for batch in batches:
        words = batch.column("words")
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(words.flatten())
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = text * max(len(coded.dictionary), 1) + code
        order = np.argsort(key, kind="stable")  # places stay in order
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        of = pa.array(text[order][first])
        starts = pa.array(np.append(first, len(order)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(code[order][first])), *(batch.column(c).take(of) for c in ("id", "field", "text")), pa.ListArray.from_arrays(starts, pa.array(at[order].astype(np.int32)))],
            names=["term", "id", "field", "text", "positions"],
        )


def postings(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """term, id, field, text (a hash of it) and positions of every word of the fields; a null id has none.

    A text's words are grouped where the text is read, so that words are not shuffled one by one.  Rows of one id
    stand by themselves, and equal ones may do so more than once.
    """
    of = lambda f: F.struct(F.lit(f).alias("field"), F.xxhash64(F.col(f).cast("string")).alias("text"), terms(F.col(f).cast("string")).alias("words"))
    rows = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.explode(F.array(*(of(f) for f in fields))).alias("x"))
    return rows.select("id", "x.field", "x.text", "x.words").mapInArrow(_grouped, "term string, id long, field string, text long, positions array<int>")


def build(df: DataFrame, id_column: str, fields: list[str], path: str, buckets: int = BUCKETS) -> None:
    """Write the index of a table; rows of a bucket lie together, by term, and a frequent term over many files."""
    rows = postings(df, id_column, fields).withColumn("bucket", _bucket("term", buckets))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
    dealt.sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def search(index: DataFrame, queries: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """query_id, id, field and hits (how often the phrase stands there) for queries (query_id, phrase); a phrase without a word finds nothing.

    Each posting of a word that is asked for is read once, however many phrases have the word: the asked words of a
    text are laid out by their places, and runs of neighbouring places are looked up among the phrases.  The queries
    are the small side; how many words they have is counted before they are broadcast.
    """
    asked = queries.select("query_id", terms(F.col("phrase")).alias("words")).where(F.size("words") > 0).select("query_id", F.size("words").alias("size"), F.array_join("words", " ").alias("run"), "words")
    sizes = sorted(r[0] for r in asked.select("size").distinct().collect())
    if not sizes:
        return index.sparkSession.createDataFrame([], StructType([queries.schema["query_id"], *index.select("id", "field").schema, StructField("hits", LongType())]))
    words = if_few(asked.select(F.explode("words").alias("term")).distinct().withColumn("bucket", _bucket("term", buckets)))
    met = index.join(words, ["bucket", "term"]).select("id", "field", "text", "term", "positions").repartition("id")
    # equal rows of one id give a place once
    places = met.dropDuplicates(["id", "field", "text", "term"]).select("id", "field", "text", "term", F.explode("positions").alias("at"))
    ahead = Window.partitionBy("id", "field", "text").orderBy("at")
    laid = places.select("id", "field", "term", "at", *(F.lead(c, k).over(ahead).alias(f"{c}_{k}") for k in range(1, sizes[-1]) for c in ("term", "at")))
    run = lambda n: F.struct(F.lit(n).alias("size"), F.concat_ws(" ", "term", *(f"term_{k}" for k in range(1, n))).alias("run"))
    runs = F.array_compact(F.array(*(run(n) if n == 1 else F.when(F.col(f"at_{n - 1}") == F.col("at") + n - 1, run(n)) for n in sizes)))
    found = laid.select("id", "field", F.explode(runs).alias("x")).select("id", "field", "x.size", "x.run")
    return found.join(if_few(asked.drop("words")), ["size", "run"]).groupBy("query_id", "id", "field").agg(F.count(F.lit(1)).alias("hits"))

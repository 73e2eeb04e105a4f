"""MinHash near-duplicates with sequential Bayesian verification.

Rows with equal shingle sets count as one.  Banded signatures propose candidates; a
candidate's signatures are then compared batch by batch and dropped as soon as the
posterior chance of reaching the threshold falls below MISS; what is left is verified on
the full shingle sets.  Groups are components of the verified links.

Not all pairs of a band's bucket are candidates: see components.grouped.

Nulls and texts without a word have the empty set and link with nothing.  A null doc_id
is passed over.  Rows of a doc_id with different texts are documents of their own, each
with its own component; repeated rows are treated alike.  An empty table gives an empty
result.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import arrow_batches, broadcast_if_small, checkpoint, whole_text, written
from medlake.llm.components import grouped

BANDS, ROWS = 40, 6
BATCH = 24
MISS = 1e-6
PERCENT = 80
_RNG = np.random.default_rng(20)
_MASKS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
_K = np.uint64(0x9FB21C651E98DF25)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * _K
    return x ^ (x >> np.uint64(32))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text: A-Z lower-cased, words between ASCII white space."""
    split = text.encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in split], np.uint64)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = _mixed(out * _K + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minimum hashes of a set."""
    low = np.full(len(_MASKS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), 2048):
        x = ((found[None, at : at + 2048] ^ _MASKS[:, None]) * _FACTORS[:, None]) >> np.uint64(32)
        np.minimum(low, x.min(1).astype(np.uint32), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mixed(key * _K + rows[:, r])
    return key.view(np.int64)


def least_matches(percent: int = PERCENT, miss: float = MISS) -> np.ndarray:
    """For each number of hashes compared, the fewest matches that leave a posterior chance of `miss` or more.

    Under a uniform prior the chance that the similarity is t or more, given m matches
    of n, is that of at most m successes in n + 1 trials of chance t.
    """
    t = percent / 100
    out = np.zeros(BANDS * ROWS + 1, np.int64)
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total = 0.0
        for m in range(n + 2):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                out[n] = m
                break
    return out


def verified(sig_a: np.ndarray, sig_b: np.ndarray, sets_a: list, sets_b: list, percent: int = PERCENT) -> np.ndarray:
    """Which pairs reach the threshold: pruned batch by batch on signatures, then counted on full sets."""
    least = least_matches(percent)
    live, matches = np.arange(len(sig_a)), np.zeros(len(sig_a), np.int64)
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        matches[live] += (sig_a[live, n - BATCH : n] == sig_b[live, n - BATCH : n]).sum(1)
        live = live[matches[live] >= least[n]]
    out = np.zeros(len(sig_a), bool)
    for i in live:
        x, y = np.frombuffer(sets_a[i], np.uint64), np.frombuffer(sets_b[i], np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out[i] = 100 * both >= percent * (len(x) + len(y) - both)
    return out


def text_key() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(whole_text()).alias("text_key")


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (equal for equal sets) and band keys of every row."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t, words) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "text_key": batch["text_key"],
                    "n_shingles": [len(s) for s in sets],
                    "set_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "bands": [band_keys(signature(s)) if len(s) else np.zeros(0, np.int64) for s in sets],
                }
            )

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_key(), whole_text().alias("text"))
    return rows.mapInPandas(run, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, signature and full set, as bytes, of the given documents (id, doc_id, text_key)."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t, words) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "sig": [signature(s).tobytes() for s in sets], "found": [s.tobytes() for s in sets]})

    rows = docs.select("doc_id", text_key(), whole_text().alias("text")).join(ids, ["doc_id", "text_key"]).select("id", "text")
    return rows.mapInPandas(run, "id long, sig binary, found binary").dropDuplicates(["id"])


def links(pairs: DataFrame, docs: DataFrame, at: DataFrame, words: int, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that reach the threshold; `at` says where each id stands."""
    ids = placed_ids(at, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = full_sets(docs, ids, words)
    left, right = (sets.select(*(F.col(c).alias(c + s) for c in sets.columns)) for s in "ab")

    def run(batches):
        for batch in batches:
            if len(batch):
                sigs = [np.frombuffer(b"".join(batch[c]), np.uint32).reshape(len(batch), -1) for c in ("siga", "sigb")]
                yield batch.loc[verified(*sigs, list(batch["founda"]), list(batch["foundb"]), percent), ["a", "b"]]

    joined = pairs.join(left, F.col("a") == F.col("ida")).join(right, F.col("b") == F.col("idb"))
    return joined.select("a", "b", "siga", "sigb", "founda", "foundb").mapInPandas(run, "a long, b long")


SIGNED = BANDS * ROWS * 4


def among(rows: list[bytes], percent: int = PERCENT):
    """What tells of one row which of these reach the threshold with it; a row is the signature's and the set's bytes.

    Signatures prune, batch by batch, as in verified(); what is left is counted on full sets.
    """
    sigs = np.frombuffer(b"".join(r[:SIGNED] for r in rows), np.uint32).reshape(len(rows), -1)
    sets = [np.frombuffer(r, np.uint64, offset=SIGNED) for r in rows]
    least = least_matches(percent)

    def test(data: bytes) -> np.ndarray:
        sig, x = np.frombuffer(data[:SIGNED], np.uint32), np.frombuffer(data, np.uint64, offset=SIGNED)
        live, matches = np.arange(len(sets)), np.zeros(len(sets), np.int64)
        for n in range(BATCH, BANDS * ROWS + 1, BATCH):
            matches[live] += (sigs[live, n - BATCH : n] == sig[n - BATCH : n]).sum(1)
            live = live[matches[live] >= least[n]]
        out = np.zeros(len(sets), bool)
        for i in live:
            both = len(np.intersect1d(x, sets[i], assume_unique=True))
            out[i] = 100 * both >= percent * (len(x) + len(sets[i]) - both)
        return out

    return test


#: A group of equal sets is large from this share of all rows on; there are fewer of them than its inverse, so that they may be broadcast.
LARGE = 1 / 1000


def placed_ids(at: DataFrame, ids: DataFrame) -> DataFrame:
    """Where the given ids stand, as (id, doc_id, text_key), to be joined with the documents."""
    ids = checkpoint(at.join(ids, "id", "left_semi"))
    return broadcast_if_small(ids, ids.count())


#: Gives id and component of sets: takes the representatives (id and the further columns of the rows), where each id stands, and whether rows of an id repeat.
Find = Callable[[DataFrame, DataFrame, bool], DataFrame]


def component_rows(rows: DataFrame, find: Find) -> DataFrame:
    """doc_id, text_key, n_shingles and component_id of every row, rows of equal sets counting as one.

    rows: a written table of doc_id, text_key, n_shingles, set_key and what find needs.
    """
    first = F.min(F.struct("doc_id", "text_key")).alias("at")
    sets = rows.where("n_shingles > 0").groupBy("set_key").agg(first, F.count(F.lit(1)).alias("n")).select("set_key", "at.*", "n")
    # a set's id is the doc_id of its first row; where one doc_id has several texts, a hash of the set
    many = checkpoint(sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("doc_id", F.lit(True).alias("many")))
    n_many = many.count()
    sets = sets.join(broadcast_if_small(many, n_many), "doc_id", "left") if n_many else sets.withColumn("many", F.lit(None).cast("boolean"))
    sets = checkpoint(sets.select("set_key", F.when(F.col("many"), F.xxhash64("set_key")).otherwise(F.col("doc_id")).alias("id"), "doc_id", "text_key", "n"))
    at = sets.select("id", "doc_id", "text_key")
    reps = rows.join(sets.select("id", "set_key", "doc_id", "text_key"), ["set_key", "doc_id", "text_key"])
    labels = find(reps, at, n_many > 0)
    if n_many:
        named = labels.join(at, "id")
        labels = checkpoint(named.join(named.groupBy("component").agg(F.min("doc_id").alias("least")), "component").select("id", F.col("least").alias("component")))
    doubles = sets.where("n > 1 or id <> doc_id").select("set_key", "id", "n")
    total = rows.count()
    large = doubles.where(F.col("n") >= F.lit(total * LARGE)).select("set_key", F.col("id").alias("large_id"))
    rows = rows.select("doc_id", "text_key", "n_shingles", "set_key").join(F.broadcast(large), "set_key", "left")
    # rows of large groups have their id; the others meet it by set, and large groups and empty sets are dealt over all tasks
    dealt = F.when(F.col("large_id").isNull() & (F.col("n_shingles") > 0), F.col("set_key")).otherwise(F.unhex(F.hex("doc_id")))
    small = doubles.where(F.col("n") < F.lit(total * LARGE)).select(F.col("set_key").alias("dealt"), F.col("id").alias("small_id"))
    placed = rows.withColumn("dealt", dealt).join(small, "dealt", "left").withColumn("id", F.coalesce("large_id", "small_id", "doc_id"))
    placed = placed.join(broadcast_if_small(labels, labels.count()), "id", "left")
    if not n_many:
        return placed.select("doc_id", "text_key", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    hashed = sets.where("id <> doc_id").select("id", F.col("doc_id").alias("first_id"))
    return placed.join(hashed, "id", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("component", "first_id", "id").alias("component_id"))


def _grouped_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles and component_id of every row."""
    arrow_batches(docs.sparkSession)

    def find(reps: DataFrame, at: DataFrame, repeated: bool) -> DataFrame:
        keys = reps.select(F.explode("bands").alias("key"), "id")
        return grouped(
            keys.distinct() if repeated else keys,
            lambda pairs: links(pairs, docs, at, words, percent),
            lambda ids: full_sets(docs, placed_ids(at, ids), words).select("id", F.concat("sig", "found").alias("data")),
            lambda sets: among(sets, percent),
        )

    return component_rows(written(sketches(docs, words), "sketches"), find)


def duplicates(docs: DataFrame, words: int, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return _grouped_rows(docs, words, percent).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that are not the first of their group, with all their columns; null doc_ids stay."""
    gone = _grouped_rows(docs, words, percent).where("doc_id <> component_id")
    gone = checkpoint(gone.select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__key")).distinct())
    same = (docs["doc_id"] == F.col("__gone")) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("__key"))
    return docs.join(broadcast_if_small(gone, gone.count()), same, "left_anti")

"""Jaccard join of n-gram sets by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes.  Cut into fragments, it cuts
every set into segments, and the overlap of two sets is the sum of the overlaps of their
segments.  Fragments serve twice:

1. Candidates.  Two sets of similarity t differ in D n-grams at most, D following from
   their sizes.  The order is cut into (D + 1) / 2 parts, rounded up, so that in one of
   them the sets differ in one n-gram at most; each part is cut into three fragments, of
   which two are then equal.  A set is looked up by the hashes of these pairs of segments,
   under the cuts of its own class of sizes and of the class below, the only ones that
   hold sets as small as t allows.
2. Verification.  Each candidate pair meets in every one of FRAGMENTS ranges of the order
   by itself, where its partial overlap is counted; these are summed by pair.

Keys are of whole segments that hold n-grams from all over a text, so a passage that many
texts share makes no key that they share.  Rows with equal sets count as one before any
pair is made; not all pairs of a key are candidates: see components.grouped.

Nulls and texts without a word have the empty set and link with nothing.  A null doc_id
is passed over.  Rows of a doc_id with different texts are documents of their own; repeated
rows are treated alike.  An empty table gives an empty result.  Further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import arrow_batches, whole_text, written
from medlake.llm.components import grouped
from medlake.llm.minhash import component_rows, placed_ids, shingles, text_key

WORDS = 3
PERCENT = 90
#: Ranges of the global order in which overlaps are counted by themselves; a power of two.
FRAGMENTS = 16
_SHIFT = np.uint64(64 - FRAGMENTS.bit_length() + 1)
_K = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@lru_cache(64)
def size_classes(percent: int, least: int) -> tuple[int, ...]:
    """The first sizes of the classes, up to one beyond `least`: a partner of a set lies in its class or in a neighbouring one."""
    out = [1]
    while out[-1] <= least:
        out.append(100 * out[-1] // percent + 1)
    return tuple(out)


def class_of(n: int, percent: int) -> tuple[int, int, int]:
    """The first sizes of the class below n's (0 if none), of n's, and of the next."""
    first = size_classes(percent, 1 << n.bit_length())
    k = bisect_right(first, n)
    return (first[k - 2] if k > 1 else 0), first[k - 1], first[k]


def most_apart(top: int, percent: int) -> int:
    """How many n-grams two linked sets may not share if the smaller has `top` at most."""
    return (100 - percent) * (top + 100 * top // percent) // (100 + percent)


def _pair_keys(found: np.ndarray, top: int, percent: int) -> np.ndarray:
    """Hashes of the pairs of segments under the cuts of the class that ends at size `top`."""
    apart = most_apart(top, percent)
    if not apart:  # only equal sets link
        return np.zeros(0, np.uint64)
    parts = (apart + 2) // 2
    fragment = (found >> np.uint64(32)) * np.uint64(3 * parts) >> np.uint64(32)
    ends = np.searchsorted(fragment, np.arange(3 * parts + 1, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(found * _K), dtype=np.uint64)])
    sums = _mixed((total[ends[1:]] - total[ends[:-1]]) ^ _mixed(np.arange(3 * parts, dtype=np.uint64) + np.uint64(top * int(_K) & 0xFFFFFFFFFFFFFFFF)))
    a, b, c = sums.reshape(-1, 3).T
    return np.concatenate([_mixed(a * _K + b), _mixed(b * _K + c), _mixed(c * _K + a)])


def keys_of(found: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of a set, sorted n-gram hashes; two linked sets share one."""
    n = len(found)
    if not n:
        return np.zeros(0, np.int64)
    below, own, after = class_of(n, percent)
    keys = [_pair_keys(found, after - 1, percent)]
    if below:
        keys.append(_pair_keys(found, own - 1, percent))
    return np.concatenate(keys).view(np.int64)


def sets_of(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (equal for equal sets) and keys of every row."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t, words) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "text_key": batch["text_key"],
                    "n_shingles": [len(s) for s in sets],
                    "set_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "keys": [keys_of(s, percent) for s in sets],
                }
            )

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_key(), whole_text().alias("text"))
    return rows.mapInPandas(run, "doc_id long, text_key long, n_shingles long, set_key binary, keys array<long>")


def _texts(docs: DataFrame, at: DataFrame) -> DataFrame:
    """id and text of the given documents (id, doc_id, text_key)."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_key(), whole_text().alias("text"))
    return rows.join(at, ["doc_id", "text_key"]).select("id", "text")


def segments(docs: DataFrame, at: DataFrame, words: int) -> DataFrame:
    """id, fragment, size of the whole set, and the n-gram hashes of each segment, as bytes."""

    def run(batches):
        for batch in batches:
            out = []
            for i, t in zip(batch["id"], batch["text"], strict=True):
                found = shingles(t, words)
                ends = np.searchsorted(found >> _SHIFT, np.arange(FRAGMENTS + 1, dtype=np.uint64))
                out += [(i, f, len(found), found[ends[f] : ends[f + 1]].tobytes()) for f in range(FRAGMENTS) if ends[f] < ends[f + 1]]
            yield pd.DataFrame(out, columns=["id", "fragment", "size", "segment"])

    return _texts(docs, at).mapInPandas(run, "id long, fragment int, size long, segment binary").dropDuplicates(["id", "fragment"])


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """a, b, size_a, size_b and overlap of pairs (a, b): counted in each fragment by itself, and summed."""
    left, right = (parts.select(F.col("id").alias(s), "fragment", F.col("size").alias(f"size_{s}"), F.col("segment").alias(f"segment_{s}")) for s in "ab")

    def run(batches):
        for batch in batches:
            shared = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch["segment_a"], batch["segment_b"], strict=True)]
            yield batch[["a", "b", "size_a", "size_b"]].assign(part=np.array(shared, np.int64))

    met = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "size_a", "size_b", "segment_a", "segment_b")
    counted = met.mapInPandas(run, "a long, b long, size_a long, size_b long, part long")
    return counted.groupBy("a", "b", "size_a", "size_b").agg(F.sum("part").alias("overlap"))


def links(pairs: DataFrame, docs: DataFrame, at: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold; `at` says where each id stands."""
    ids = placed_ids(at, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    counted = overlaps(pairs, written(segments(docs, ids, words), "segments"))
    return counted.where(100 * F.col("overlap") >= percent * (F.col("size_a") + F.col("size_b") - F.col("overlap"))).select("a", "b")


def among(rows: list[bytes], percent: int):
    """What tells of one set which of these reach the threshold with it; overlaps are summed by fragment until the rest cannot suffice."""
    sets = [np.frombuffer(r, np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    edges = np.arange(FRAGMENTS + 1, dtype=np.uint64)
    cuts = [np.searchsorted(s >> _SHIFT, edges) for s in sets]

    def test(data: bytes) -> np.ndarray:
        x = np.frombuffer(data, np.uint64)
        cut = np.searchsorted(x >> _SHIFT, edges)
        out = np.zeros(len(sets), bool)
        for i in np.flatnonzero(100 * np.minimum(sizes, len(x)) >= percent * np.maximum(sizes, len(x))):
            y, ends, both = sets[i], cuts[i], 0
            need = -(-percent * (len(x) + len(y)) // (100 + percent))
            for f in range(FRAGMENTS):
                both += len(np.intersect1d(x[cut[f] : cut[f + 1]], y[ends[f] : ends[f + 1]], assume_unique=True))
                if both + min(len(x) - cut[f + 1], len(y) - ends[f + 1]) < need:
                    break
            out[i] = both >= need
        return out

    return test


def _sets(docs: DataFrame, at: DataFrame, words: int) -> DataFrame:
    """id and the whole set, as bytes."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "data": [shingles(t, words).tobytes() for t in batch["text"]]})

    return _texts(docs, at).mapInPandas(run, "id long, data binary").dropDuplicates(["id"])


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: documents whose sets overlap by `percent` of their union, and whatever links reach."""
    arrow_batches(docs.sparkSession)

    def find(reps: DataFrame, at: DataFrame, repeated: bool) -> DataFrame:
        keys = reps.select(F.explode("keys").alias("key"), "id")
        return grouped(
            keys.distinct() if repeated else keys,
            lambda pairs: links(pairs, docs, at, words, percent),
            lambda ids: _sets(docs, placed_ids(at, ids), words),
            lambda sets: among(sets, percent),
        )

    return component_rows(written(sets_of(docs, words, percent), "sets"), find).select("doc_id", "n_shingles", "component_id")

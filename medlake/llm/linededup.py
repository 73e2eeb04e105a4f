"""Line dedup by a segment-partition edit join.

Lines within EDITS edits of each other form classes (components of such links), and
of each class the first line by document and place stays.  A line is cut into EDITS + 1
segments; a line that is near keeps at least one of them, at a place that the lengths of
both lines and the segment's number bound.  Each line is indexed by its segments under
its own length, and probes, with its substrings at those places, the indexes of lengths
down to EDITS shorter.  Candidates are verified by a banded bit-parallel edit distance.

Lines shorter than LEAST code points, for which two edits would be too many, match
exactly; blank lines are never removed.  Lines are told apart by two 64-bit hashes.
Nulls: a null text has no lines and stays null; a null doc_id is passed over and stays
as it is.  Rows of a doc_id with different texts are documents of their own; repeated
rows, of equal text too, count as one document and are treated alike.  An empty table
gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import arrow_batches, broadcast_if_small, checkpoint
from medlake.llm.components import grouped

EDITS = 2
#: Lines shorter than this match exactly, longer ones within EDITS edits.
LEAST = 24
#: A class is large from this share of all lines on; there are fewer of them than its inverse, so that they may be broadcast.
LARGE = 1 / 1000
BLANK = "^[\\s\\u00a0]*$"


def signed_hash(text: str) -> int:
    """As Spark's xxhash64 of the string."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, end) of the segments of a line of this length."""
    cuts = [length * i // (edits + 1) for i in range(edits + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


@lru_cache(4096)
def probes(n: int, edits: int, least: int) -> tuple[tuple[int, int, int], ...]:
    """(start, end, seed) of the substrings that a line of n code points is looked up by; the seed tells segment and length."""
    out = set()
    for length in range(max(least, n - edits), n + 1):
        more = n - length
        for i, (start, end) in enumerate(segments(length, edits)):
            size = end - start
            low = max(0, start - i, start + more - (edits - i))
            high = min(n - size, start + i, start + more + (edits - i))
            out |= {(at, at + size, length * (edits + 1) + i) for at in range(low, high + 1)}
    return tuple(sorted(out))


def keys_of(line: str, edits: int, least: int = LEAST) -> set[int]:
    """Hashes of a line's own segments and of its probes for lines as long or shorter."""
    raw = line.encode("utf-8", "surrogatepass")
    if len(raw) == len(line):
        found = {xxhash.xxh3_64_intdigest(raw[a:b], seed) for a, b, seed in probes(len(line), edits, least)}
    else:
        found = {xxhash.xxh3_64_intdigest(line[a:b].encode("utf-8", "surrogatepass"), seed) for a, b, seed in probes(len(line), edits, least)}
    return found


def within(a: str, b: str, edits: int) -> bool:
    """Whether two lines differ by at most so many edits: bit vectors of the states within the band, one for each count of edits."""
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    low, high = 0, min(len(a), len(b))
    while low < high:  # the length of the common start
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    band = (1 << (2 * edits + 1)) - 1
    rows = [(1 << (d + 1)) - 1 for d in range(edits + 1)]
    for j, c in enumerate(b, 1):
        match = masks.get(c, 0)
        keep = band << (j - edits) if j > edits else band >> (edits - j)
        before = rows[0]
        rows[0] = above = (before & match) << 1 & keep
        for d in range(1, edits + 1):
            now = rows[d]
            above = ((now & match) << 1 | before | before << 1 | above << 1) & keep
            rows[d], before = above, now
        if not rows[edits]:
            return False
    return bool(rows[edits] >> len(a) & 1)


def _text_key() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64("text").alias("text_key")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, place, and both hashes of the lines that are not blank."""
    found = F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("id"), F.xxhash64(x, F.lit(1)).alias("check"), x.rlike(BLANK).alias("blank")))
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", _text_key(), F.posexplode(found).alias("place", "line"))
    return rows.where(~F.col("line.blank")).select("doc_id", "text_key", "place", "line.id", "line.check")


def _keys(docs: DataFrame, edits: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            lines = {x for t in batch["text"] for x in t.split("\n") if len(x) >= LEAST}
            found = {signed_hash(x): keys_of(x, edits) for x in lines}
            ids = np.repeat(np.fromiter(found, np.int64, len(found)), [len(k) for k in found.values()])
            keys = np.fromiter(chain.from_iterable(found.values()), np.uint64, len(ids))
            yield pd.DataFrame({"key": keys.view(np.int64), "id": ids})

    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("text").mapInPandas(run, "key long, id long")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and line of the given line ids."""
    lines = docs.where(F.col("text").isNotNull()).select(F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where(F.length("line") >= LEAST).select(F.xxhash64("line").alias("id"), "line")
    return lines.join(broadcast_if_small(ids, ids.count()), "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"))


def _tally(line: str) -> np.ndarray:
    """How often characters occur, in 64 classes; an edit changes two counts at most."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(points & 63, minlength=64)


def among(lines: list[bytes], edits: int):
    """What tells of one line which of these lie within so many edits of it."""
    texts = [x.decode() for x in lines]
    tallies = np.stack([_tally(x) for x in texts]).astype(np.int32)

    def test(data: bytes) -> np.ndarray:
        line = data.decode()
        out = np.zeros(len(texts), bool)
        for j in np.flatnonzero(np.abs(tallies - _tally(line).astype(np.int32)).sum(1) <= 2 * edits):
            out[j] = within(texts[j], line, edits)
        return out

    return test


def _linked(pairs: DataFrame, docs: DataFrame, edits: int) -> DataFrame:
    lines = _texts(docs, checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    left, right = (lines.select(F.col("id").alias(s), F.col("line").alias(f"line_{s}")) for s in "ab")

    def run(batches):
        for batch in batches:
            near = [within(x, y, edits) for x, y in zip(batch["line_a"], batch["line_b"], strict=True)]
            yield batch.loc[near, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a long, b long")


def line_classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, place, line id and class of every line long enough; first where the class begins."""
    arrow_batches(docs.sparkSession)
    labels = grouped(
        _keys(docs, edits),
        lambda pairs: _linked(pairs, docs, edits),
        lambda ids: _texts(docs, ids).select("id", F.col("line").cast("binary").alias("data")),
        lambda lines: among(lines, edits),
    )
    known = broadcast_if_small(labels, labels.count())
    linked = F.col("component").isNotNull()
    rows = _lines(docs).join(known, "id", "left").withColumns(
        {"class": F.coalesce("component", "id"), "check": F.when(linked, 0).otherwise(F.col("check"))}  # a class of linked lines has many hashes
    ).drop("component")
    firsts = rows.groupBy("class", "check").agg(F.min(F.struct("doc_id", "place", "text_key")).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = checkpoint(firsts)
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = firsts.where(F.col("n") >= F.lit(total * LARGE)).select("class", "check", F.col("at").alias("at_large"))
    rows = rows.join(F.broadcast(large), ["class", "check"], "left")
    # rows of large classes have met their first line; the others meet it by class, and large classes are dealt over all tasks
    dealt = F.when(F.col("at_large").isNull(), F.col("class")).otherwise(F.xxhash64("doc_id", "place"))
    rows = rows.withColumn("dealt", dealt).join(firsts.where(F.col("n") < F.lit(total * LARGE)).select(F.col("class").alias("dealt"), "check", "at"), ["dealt", "check"], "left")
    at = F.coalesce("at_large", "at")
    return rows.select("doc_id", "text_key", "place", "id", "class", F.coalesce(F.struct("doc_id", "place", "text_key") == at, F.lit(True)).alias("first"))


def removed_places(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, text_key and the places of the lines to remove, for documents that have any."""
    gone = line_classes(docs, edits).where("not first")
    return gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("place")).alias("gone"))


def _with_gone(docs: DataFrame, edits: int) -> DataFrame:
    """docs with __gone, the places of the lines to remove; null where there are none."""
    gone = removed_places(docs, edits).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("gone").alias("__gone"))
    return docs.join(gone, (docs["doc_id"] == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__key")), "left")


def dedup(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """docs with the repeated lines cut out of text; rows of which nothing but blank lines is left go."""
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    all_gone = kept.rlike(BLANK)
    rows = _with_gone(docs, edits).where(F.col("__gone").isNull() | ~all_gone)
    return rows.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)).select(docs.columns)


def digest(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, n_lines and removed (places of removed lines) of every document."""
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    gone = F.coalesce("__gone", F.array().cast("array<int>"))
    rows = _with_gone(docs.select("doc_id", "text"), edits)
    return rows.select("doc_id", n_lines.alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), gone.alias("removed"))

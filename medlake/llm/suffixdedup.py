"""Exact removal of repeated byte strings by blockwise suffix sorting with a cover sample.

Every LENGTH-byte string that starts at two places or more goes, in all its places.

A cover sample is a set of positions such that two equal strings of LENGTH bytes meet
the sample after the same number k of bytes.  Here it is content-defined: the position
in each such string whose 16-byte hash is least.  A suffix is then ordered by its k
leading bytes and, however long the tie, by the precomputed rank of the sample position
it reaches.  Suffixes that reach samples with different bytes cannot be equal, so the
bytes at the sample name the bucket, and buckets are sorted one at a time:

1. samples: (bucket, hash of all bytes that any string through the sample can cover, place)
2. samples that agree in all those bytes, told by 128-bit hashes, are repeated whole;
   nothing is sorted for them
3. of each bucket with several such contexts one place of each context is fetched; its
   right contexts are ranked with their common prefix lengths, its left contexts too
4. for each k, suffixes of a bucket with the same k leading bytes and the same rank down
   to LENGTH - k are equal
5. the strings found are laid over each document

Memory is that of one bucket's contexts, BUCKET at most; the strings of larger buckets are
hashed whole, for each k, and counted by Spark.

Equality of a whole context is that of its 128-bit hash, and of a string of a large bucket
that of 96 bits: among 1e12 samples two different ones agree with a chance of some 1e-15,
among as many strings with one of 1e-5.  A row is told by doc_id and a hash of
its text.  A difference cover on fixed offsets would need positions that agree between
documents; the least hash of each string's bytes is the same wherever the string stands.

Nulls: a null text is empty; a null doc_id is passed over.  Repeated rows (equal id and
text) are places of their own and get equal results.  An empty table gives an empty
result.  Texts are never cut, and strings never cross from one document to another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import arrow_batches, broadcast_if_small, whole_text, written

LENGTH = 400
#: Bytes at a sample that name its bucket.
NAME = 64
SPAN = LENGTH - NAME + 1
BUCKET = 20_000
#: Hashed strings to a batch that a task hands on.
HASHED = 100_000
BLOCK_ROWS = 4000
#: Entries of all arrays of a side that may be broadcast after they were counted.
BROADCAST_ENTRIES = 50_000
#: Words of 64 bits that tell which rows a join may keep; they are broadcast, so many at most whatever the input.
WORDS = 1 << 19


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


#: A row of the documents.
ROW = ["doc_id", "row"]


def _halves(raw: bytes, seed: int = 0) -> tuple[int, int]:
    """A 128-bit hash as two signed longs."""
    h = xxhash.xxh3_128_intdigest(raw, seed)
    return _signed(h >> 64), _signed(h & ((1 << 64) - 1))


def _row_key() -> Column:
    return F.xxhash64("text")


def likely(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `met`, which is false only where no row of few has their keys: what need not shuffle to meet few.

    The hash of the keys of each row of few sets one of 64 * WORDS bits.  The more of them are set, the more other rows
    are taken for met ones; the join that follows decides.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(64 * WORDS))
    word = F.shiftright(slot, 6).alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    bits = few.groupBy(word).agg(F.bit_or(bit).alias("bits"))
    joined = rows.select("*", word).join(F.broadcast(bits), "word", "left")
    return joined.withColumn("met", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))).drop("word", "bits")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", whole_text().alias("text"))


def sample_places(texts: list[bytes]) -> list[np.ndarray]:
    """The sample positions of each text: where the least 16-byte hash of each LENGTH-byte string stands, the first among equals."""
    ends = np.cumsum([len(t) for t in texts])
    n = int(ends[-1]) if len(texts) else 0
    if n < LENGTH:
        return [np.zeros(0, np.int64) for _ in texts]
    raw = b"".join(texts) + bytes(16 + 2 * SPAN)
    words = np.ndarray((n + 8,), "<u8", raw, strides=(1,)).copy()
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (words[8 : n + 8] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    key = np.full(-(-(n + SPAN) // SPAN) * SPAN, np.iinfo(np.uint64).max)
    key[:n] = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = key.reshape(-1, SPAN)
    upto = np.minimum.accumulate(blocks, 1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(onward[: n - LENGTH + 1], upto[SPAN - 1 : SPAN + n - LENGTH])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    out = []
    for i, end in enumerate(ends):
        start = int(end) - len(texts[i])
        mine = at[start : max(start, int(end) - LENGTH + 1)]
        out.append(mine[np.flatnonzero(np.diff(mine, prepend=-1))] - start)
    return out


CONTEXT = ["context", "context_2"]


def samples(docs: DataFrame) -> DataFrame:
    """bucket, context (two halves), row, place and the last start of a string through the sample; equal contexts have equal buckets."""

    def run(batches):
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            rows = []
            for d, key, t, places in zip(batch["doc_id"], batch["row"], texts, sample_places(texts), strict=True):
                n = len(t)
                for p in places.tolist():
                    left, right = max(0, p - SPAN + 1), min(n, p + LENGTH)
                    context = _halves(t[left:right], (p - left) << 10 | (right - p))
                    rows.append((_signed(xxhash.xxh3_64_intdigest(t[p : p + NAME])), *context, d, key, p, min(p, n - LENGTH)))
            yield pd.DataFrame(rows, columns=["bucket", *CONTEXT, *ROW, "place", "high"])

    rows = _texts(docs).withColumn("row", _row_key()).where(F.octet_length("text") >= LENGTH).select(*ROW, "text")
    return rows.mapInPandas(run, "bucket long, context long, context_2 long, doc_id long, row long, place int, high int")


def _wanted_texts(docs: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    lists = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("place", "bucket", "single", "sample")).alias("want"))
    texts = _texts(docs).withColumn("row", _row_key()).select(*ROW, "text")
    if n_wanted > BROADCAST_ENTRIES:
        texts = likely(texts, wanted, ROW).where("met").drop("met")
    return texts.join(broadcast_if_small(lists, n_wanted, BROADCAST_ENTRIES), ROW)


def contexts(docs: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """bucket, row, place, single, and the bytes before (backwards) and after the name of each wanted sample."""

    def run(batches):
        for batch in batches:
            rows = []
            for d, key, text, want in zip(batch["doc_id"], batch["row"], batch["text"], batch["want"], strict=True):
                t = text.encode("utf-8", "surrogatepass")
                for w in want:
                    p = w["place"]
                    rows.append((w["bucket"], d, key, p, w["single"], t[max(0, p - SPAN + 1) : p][::-1], t[p + NAME : p + LENGTH]))
            yield pd.DataFrame(rows, columns=["bucket", *ROW, "place", "single", "before", "after"])

    return _wanted_texts(docs, wanted, n_wanted).mapInPandas(run, "bucket long, doc_id long, row long, place int, single boolean, before binary, after binary")


def hashed_strings(docs: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """hash (96 bits, in two parts), sample and k of each string that starts k bytes before a wanted sample; ~k where the sample is not single."""

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for text, want in zip(batch["text"], batch["want"], strict=True):
                t = text.encode("utf-8", "surrogatepass")
                for w in want:
                    p, sample, single = w["place"], w["sample"], w["single"]
                    for at in range(max(0, p - SPAN + 1), min(p, len(t) - LENGTH) + 1):
                        k = p - at
                        h = xxhash.xxh3_128_intdigest(t[at : at + LENGTH], seed=k)
                        rows.append((_signed(h >> 64), (h & 0xFFFFFFFF) - (1 << 31), sample, k if single else ~k))
                    if len(rows) >= HASHED:
                        yield pd.DataFrame(rows, columns=["hash", "check", "sample", "k"])
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["hash", "check", "sample", "k"])

    return _wanted_texts(docs, wanted, n_wanted).mapInPandas(run, "hash long, check int, sample long, k short")


def count_strings(docs: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """row, low and high as of sort_buckets, from the strings' hashes; no task holds the strings of a bucket.

    The strings are hashed twice, once to be counted, which shrinks them before they shuffle, and once to be looked up:
    a table of them would be many times the text.
    """
    strings = hashed_strings(docs, wanted, n_wanted)
    twice = strings.groupBy("hash", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "check")
    found = strings.where("k >= 0").join(twice, ["hash", "check"], "left_semi").groupBy("sample").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    first = F.filter("ks", lambda k, i: F.coalesce(F.get("ks", i - 1) != k - 1, F.lit(True)))
    last = F.filter("ks", lambda k, i: F.coalesce(F.get("ks", i + 1) != k + 1, F.lit(True)))
    runs = found.select("sample", F.explode(F.arrays_zip(first.alias("first"), last.alias("last"))).alias("run"))
    places = wanted.select("sample", *ROW, "place")
    return runs.join(places, "sample").select(*ROW, (F.col("place") - F.col("run.last")).cast("int").alias("low"), (F.col("place") - F.col("run.first")).cast("int").alias("high"))


def _ranked(group: np.ndarray, parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the parts within their groups, and common prefix of each with the one before in that order."""
    lengths = np.array([len(p) for p in parts], np.int64)
    m = np.frombuffer(b"".join(p.ljust(width, b"\xff") for p in parts), np.uint8).reshape(len(parts), width) + np.uint8(1)  # 0 only pads: UTF-8 has no 255
    order = np.argsort(m.view(f"S{width}").ravel(), kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    common = np.full(len(parts), -1, np.int64)
    x, y = m[order[1:]], m[order[:-1]]
    differ = x != y
    first = np.where(differ.any(1), differ.argmax(1), width)
    same = group[order[1:]] == group[order[:-1]]
    common[1:] = np.where(same, np.minimum(first, np.minimum(lengths[order[1:]], lengths[order[:-1]])), -1)
    return order, common


def equal_strings(group: np.ndarray, before: list[bytes], after: list[bytes]) -> np.ndarray:
    """Of each sample and each k, whether the string that starts k bytes before the sample also starts elsewhere in its group."""
    n = len(group)
    found = np.zeros((n, SPAN), bool)
    right, right_common = _ranked(group, after, SPAN)
    left, left_common = _ranked(group, before, SPAN)

    def most(order: np.ndarray, common: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.maximum(common, np.append(common[1:], -1))
        return out

    most_right, most_left = most(right, right_common), most(left, left_common)
    head, tail = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in range(SPAN):
        live = np.flatnonzero((most_right >= SPAN - 1 - k) & (most_left >= k))
        if len(live) < 2:
            continue
        head[left] = np.cumsum(left_common < k)  # equal for equal k leading bytes
        tail[right] = np.cumsum(right_common < SPAN - 1 - k)  # equal for equal ranks down to what is left
        _, inverse, count = np.unique(head[live] * n + tail[live], return_inverse=True, return_counts=True)
        found[live[count[inverse] > 1], k] = True
    return found


def sort_buckets(rows: DataFrame) -> DataFrame:
    """row, low and high: runs of starts of strings that start elsewhere too, for samples marked single."""

    def solve(block: pd.DataFrame) -> pd.DataFrame:
        group = np.cumsum(np.append(True, np.diff(block["bucket"].to_numpy()) != 0))
        found = equal_strings(group, list(block["before"]), list(block["after"]))
        found &= block["single"].to_numpy()[:, None]
        edge = np.diff(found.astype(np.int8), axis=1, prepend=0, append=0)
        i, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        place = block["place"].to_numpy()[i]
        return pd.DataFrame({c: block[c].to_numpy()[i] for c in ROW} | {"low": place - last + 1, "high": place - first})

    def run(batches):
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            n += len(batch)
            if n >= BLOCK_ROWS:
                block = pd.concat(held, ignore_index=True)
                whole = block["bucket"] != block["bucket"].iloc[-1]  # the last bucket may go on
                if whole.any():
                    yield solve(block[whole].reset_index(drop=True))
                    block = block[~whole].reset_index(drop=True)
                held, n = [block], len(block)
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, "doc_id long, row long, low int, high int")


def repeats(docs: DataFrame) -> DataFrame:
    """row, low and high: runs of starts, within a document, of strings that start at another place too."""
    found = written(samples(docs), "samples")
    by_context = found.groupBy(*CONTEXT).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ROW, "place", "bucket")).alias("at"))
    by_context = written(by_context.select(*CONTEXT, (F.col("n") == 1).alias("single"), "at.*"), "contexts")
    first = F.greatest(F.lit(0), F.col("place") - (SPAN - 1)).alias("low")
    repeated = by_context.where("not single").select(*CONTEXT)
    whole = likely(found, repeated, CONTEXT).where("met").join(repeated, CONTEXT, "left_semi").select(*ROW, first, "high")
    several = by_context.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("single").alias("any")).where("n > 1 and any")
    several = several.select("bucket", (F.col("n") > BUCKET).alias("hot"))
    wanted = written(by_context.join(several, "bucket").select(*ROW, "place", "bucket", "single", "hot", F.monotonically_increasing_id().alias("sample")), "wanted")
    counts = dict(wanted.groupBy("hot").count().collect())
    rest = whole.unionByName(sort_buckets(contexts(docs, wanted.where("not hot"), counts.get(False, 0))))
    if True not in counts:
        return rest
    return rest.unionByName(count_strings(docs, wanted.where("hot"), counts[True]))


def laid_over(n: int, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Maximal (start, end) runs of bytes that strings starting from low to high cover."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, low, 1)
    np.add.at(mark, high + LENGTH, -1)
    edge = np.diff((np.cumsum(mark)[:n] > 0).astype(np.int8), prepend=0, append=0)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def _over(docs: DataFrame, row: Callable[[int, bytes, list[tuple[int, int]]], tuple], schema: str) -> DataFrame:
    """A row of each document, made from its id, its bytes and the spans of them that go."""
    arrow_batches(docs.sparkSession)
    packed = F.shiftleft(F.col("low").cast("long"), 32) + F.col("high")
    per_row = written(repeats(docs).groupBy(*ROW).agg(F.collect_set(packed).alias("runs")), "runs")
    n_runs = per_row.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for d, text, runs in zip(batch["doc_id"], batch["text"], batch["runs"], strict=True):
                t, spans = text.encode("utf-8", "surrogatepass"), []
                if runs is not None and len(runs):
                    spans = laid_over(len(t), runs >> 32, runs & 0xFFFFFFFF)
                rows.append(row(d, t, spans))
            yield pd.DataFrame(rows, columns=columns)

    rows = _texts(docs).withColumn("row", _row_key())
    if n_runs <= BROADCAST_ENTRIES:
        joined = rows.join(F.broadcast(per_row), ROW, "left")
    else:  # texts without runs stay where they are
        marked = likely(rows, per_row, ROW)
        without = marked.where("not met").withColumn("runs", F.lit(None).cast("array<long>"))
        joined = marked.where("met").join(per_row, ROW, "left").unionByName(without, allowMissingColumns=True)
    return joined.select("doc_id", "text", "runs").mapInPandas(run, schema)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, the bytes that stay, and starts and ends of what goes, of every document."""
    return _over(
        docs, lambda d, t, spans: (d, kept_bytes(t, spans), [s for s, _ in spans], [e for _, e in spans]),
        "doc_id long, kept binary, starts array<int>, ends array<int>",
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def row(d: int, t: bytes, spans: list[tuple[int, int]]) -> tuple:
        kept = kept_bytes(t, spans)
        return d, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()

    return _over(docs, row, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

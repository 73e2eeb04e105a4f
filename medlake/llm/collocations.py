"""Phrase collocations: count-min sketches find what may be frequent, a second pass counts that exactly.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and pieces into
words at blanks and tabs.  Within each language:

1. every task adds the words and word pairs of its rows to a count-min sketch whose counters
   stop at the threshold; tasks' sketches are merged block by block, and one bit a counter,
   whether it reached the threshold, goes back to the tasks
2. phrases of three words and more all of whose pairs passed are added to a second sketch
3. phrases that passed their sketches are counted exactly.  A sketch never counts too little,
   so nothing frequent is lost; what it counted too high goes here
4. each candidate is scored by its weakest cut; candidates that a longer one holds nearly
   as often as they stand go

The bits are bounded by WIDEST whatever the input; where the input is so large that
counters fill up by chance, more passes on to step 3 and results stay the same.  A text is
cut into slices of bounded size, with the words that phrases across the cut need.

Nulls: a null text is empty; a null lang is `und`, and counts with rows that say `und`.
Repeated rows count each.  doc_id is not read.  An empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medlake.llm.common import arrow_batches, broadcast_if_small, whole_text, written

LONGEST = 5
LEAST = 100
TOP = 2000
#: Percent of a candidate's occurrences that a longer one must hold to replace it.
HELD = 100
DEPTH = 2
#: Counters to a row of a sketch at least and at most, and to a block that is merged as one.
NARROWEST, WIDEST, BLOCK = 1 << 24, 1 << 26, 1 << 16
#: Bytes of text that a task works on at once.
SLICE = 6 << 20
_TO = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
_K = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.array([0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * _K


def _places(h: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The counters of hashes, row by row."""
    shift = np.uint64(64 - width.bit_length() + 1)
    for seed in _SEEDS:
        yield (_mixed(h ^ seed) >> shift).astype(np.int64)


class Sketch:
    """Count-min counters that stop at `least`."""

    def __init__(self, width: int, least: int):
        self.least, self.counts = least, np.zeros((DEPTH, width), np.uint16 if least < 1 << 15 else np.uint64)

    def add(self, h: np.ndarray) -> None:
        for row, places in zip(self.counts, _places(h, self.counts.shape[1]), strict=True):
            for at in range(0, len(places), 1 << 15):  # so few at once that no counter overflows before it is stopped
                some = places[at : at + (1 << 15)]
                np.add.at(row, some, 1)
                row[some] = np.minimum(row[some], self.least)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """Number and counters of the blocks that hold any."""
        flat = self.counts.reshape(-1, min(BLOCK, self.counts.shape[1]))
        for k in np.flatnonzero(flat.any(1)).tolist():
            yield k, zlib.compress(flat[k].astype(np.uint8 if self.least < 256 else flat.dtype).tobytes(), 1)


class Passed:
    """For each counter of a merged sketch, whether it reached the threshold."""

    def __init__(self, width: int, bits: np.ndarray):
        self.width, self.bits = width, bits

    def test(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row, places in zip(self.bits, _places(h, self.width), strict=True):
            out &= (row[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _cut(raw: bytes, size: int) -> Iterator[tuple[list[bytes], list[int], int]]:
    """Words, the lengths of pieces, and the number of leading words seen before, of each slice of a text."""
    tail: list[bytes] = []
    at = 0
    while at < len(raw):
        end = at + size
        while end < len(raw) and raw[end] not in b" \n":
            end += 1
        pieces = [p.split() for p in raw[at:end].split(b"\n")]
        carried = len(tail)
        pieces[0] = tail + pieces[0]
        tail = pieces[-1][1 - LONGEST :]
        yield list(chain.from_iterable(pieces)), [len(p) for p in pieces], carried
        at = end


class Slice:
    """Words of texts of one language: hashes of the phrases that start at each word, and where phrases end too late."""

    def __init__(self, lang: str, words: list[bytes], pieces: list[int], carried: int):
        self.lang, self.words, self.carried = lang, words, carried
        self.codes, self.distinct = pd.factorize(np.array([*words, None], object)[:-1])
        self.piece = np.repeat(np.arange(len(pieces)), pieces)
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in self.distinct], np.uint64)
        self.h = hashes[self.codes]
        self.of_lang = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), 1))

    def phrases(self, k: int, seen: bool = False) -> np.ndarray:
        """Whether a phrase of k words starts at each of the first len - k + 1 words; those that the slice before has count if `seen`."""
        n = len(self.words) - k + 1
        if n <= 0:
            return np.zeros(0, bool)
        out = self.piece[:n] == self.piece[k - 1 :]
        if not seen:
            out[: max(0, self.carried - k + 1)] = False
        return out

    def hashes(self, k: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the phrases of k words that start at the places given."""
        h = _mixed(self.h[at] ^ self.of_lang)
        for j in range(1, k):
            h = _mixed(h * _K + self.h[at + j])
        return h

    def runs(self, pairs: np.ndarray, k: int, seen: bool = False) -> np.ndarray:
        """Where phrases of k words start all of whose pairs are among those given."""
        n = max(0, len(self.words) - k + 1)
        out = self.phrases(k, seen)
        for j in range(k - 1):
            out &= pairs[j : j + n]
        return out


def _slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[Slice]:
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush() -> Iterator[Slice]:
        for lang, texts in held.items():
            pieces = [p.split() for p in b"\n".join(texts).split(b"\n")]
            yield Slice(lang, list(chain.from_iterable(pieces)), [len(p) for p in pieces], 0)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = text.translate(_TO)
            if len(raw) > most:
                yield from (Slice(lang, *part) for part in _cut(raw, most))
                continue
            held.setdefault(lang, []).append(raw)
            size += len(raw)
            if size > most:
                yield from flush()
                size = 0
    yield from flush()


def _pairs_passed(part: Slice, passed: Passed) -> np.ndarray:
    """Whether the pair that starts at each word may be frequent, pairs with words of the slice before included."""
    n = max(0, len(part.words) - 1)
    at = np.flatnonzero(part.piece[:n] == part.piece[1:]) if n else np.zeros(0, np.int64)
    out = np.zeros(n, bool)
    out[at[passed.test(part.hashes(2, at))]] = True
    return out


def _merged(rows: DataFrame, width: int, least: int) -> Passed:
    """Tasks' blocks, summed block by block as a stream; a bit a counter comes to the driver."""
    block, kind = min(BLOCK, width), np.uint8 if least < 256 else np.uint64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = None, np.zeros(block, np.uint64)

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([here], pa.int64()), "bits": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})

        for batch in batches:
            for k, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if k != here:
                    if here is not None:
                        yield bits()
                    here, total = k, np.zeros(block, np.uint64)
                total += np.frombuffer(zlib.decompress(counts), kind)
        if here is not None:
            yield bits()

    found = rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, bits binary")
    out = np.zeros((DEPTH * width // block, block // 8), np.uint8)
    for r in found.toLocalIterator():
        out[r.block] = np.frombuffer(bytes(r.bits), np.uint8)
    return Passed(width, out.reshape(DEPTH, -1))


def _sketched(texts: DataFrame, add, width: int, least: int) -> Passed:
    """The merged sketch of what add(sketch, slice) adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(width, least)
        for part in _slices(batches):
            add(sketch, part)
        for k, counts in sketch.blocks():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int64()), "counts": pa.array([counts], pa.binary())})

    return _merged(texts.mapInArrow(run, "block long, counts binary"), width, least)


#: Phrases that a task adds up before it hands them on.
HELD_PHRASES = 400_000


def tallies(parts: Iterator[Slice], first: Passed, second: Passed, longest: int) -> Iterator[dict[tuple[str, bytes], int]]:
    """How often each phrase that passed the sketches stands in the slices, by language; the number of all words stands at the phrase b''."""
    sums: dict[tuple[str, bytes], int] = {}
    for part in parts:
        lang, words, kinds = part.lang, part.words, len(part.distinct)
        sums[lang, b""] = sums.get((lang, b""), 0) + len(words) - part.carried
        ids, passed, pairs = part.codes, np.zeros(0, bool), _pairs_passed(part, first)
        for size in range(1, longest + 1):
            # ids: equal numbers for equal phrases of the size before; with the next word they number those of this size
            if size == 1:
                at = np.flatnonzero(first.test(part.hashes(1, np.arange(len(words)))))
                group = part.codes[at]
            else:
                now = pairs if size == 2 else part.runs(pairs, size, seen=True)
                if size > 3:  # both phrases one shorter passed too
                    now = now & passed[:-1] & passed[1:]
                at = np.flatnonzero(now)
                if size > 2:
                    at = at[second.test(part.hashes(size, at))]
                passed = np.zeros(len(now), bool)
                passed[at] = True
                _, group = np.unique(ids[at] * kinds + part.codes[at + size - 1], return_inverse=True)
                ids = np.zeros(len(words), np.int64)
                ids[at] = group
            fresh = at + size > part.carried
            _, where, n = np.unique(group[fresh], return_index=True, return_counts=True)
            for i, count in zip(at[fresh][where].tolist(), n.tolist(), strict=True):
                key = lang, b" ".join(words[i : i + size])
                sums[key] = sums.get(key, 0) + count
        if len(sums) > HELD_PHRASES:
            yield sums
            sums = {}
    yield sums


#: Parts that phrases are dealt to by their hash; a task adds up one part at a time.
PARTS = 4096


def _packed(sums: dict[tuple[str, bytes], int]) -> Iterator[tuple[str, int, bytes, bytes]]:
    """lang, part, phrases and counts of a task's sums: one row a language and part instead of one a phrase."""
    dealt: dict[tuple[str, int], list[tuple[bytes, int]]] = {}
    for (lang, phrase), n in sums.items():
        dealt.setdefault((lang, xxhash.xxh3_64_intdigest(phrase) % PARTS), []).append((phrase, n))
    for (lang, part), rows in dealt.items():
        rows.sort()
        yield lang, part, zlib.compress(b"\n".join(p for p, _ in rows), 1), np.array([n for _, n in rows], np.int64).tobytes()


def _counted(texts: DataFrame, two, more, least: int, longest: int) -> DataFrame:
    """lang, phrase and f of what passed the sketches.

    Tasks hand on their sums packed by parts, since most tasks hold most frequent phrases; no phrase holds a line end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sums in tallies(_slices(batches), two.value, more.value, longest):
            lang, part, phrases, counts = zip(*_packed(sums), strict=True) if sums else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "part": pa.array(part, pa.int32()), "phrases": pa.array(phrases, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = None, Counter()

        def rows() -> pa.RecordBatch:
            kept = {p: n for p, n in total.items() if n >= least or not p}
            return pa.RecordBatch.from_pydict({"lang": pa.array([here[0]] * len(kept), pa.string()), "phrase": pa.array([p.decode("utf-8", "surrogatepass") for p in kept], pa.string()), "f": pa.array(list(kept.values()), pa.int64())})

        for batch in batches:
            for *key, phrases, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "phrases", "counts")), strict=True):
                if key != here:
                    if here is not None:
                        yield rows()
                    here, total = key, Counter()
                for phrase, n in zip(zlib.decompress(phrases).split(b"\n"), np.frombuffer(counts, np.int64).tolist(), strict=True):
                    total[phrase] += n
        if here is not None:
            yield rows()

    packed = texts.mapInArrow(run, "lang string, part int, phrases binary, counts binary")
    return packed.repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(added, "lang string, phrase string, f long")


def frequencies(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase and f, exact, of all phrases of 1 to `longest` words that occur `least` times; the number of all words stands at the phrase ''."""
    spark = docs.sparkSession
    arrow_batches(spark)
    size = docs.agg(F.sum(F.octet_length(whole_text()))).first()[0] or 0
    width = min(WIDEST, max(NARROWEST, 1 << (size // 64).bit_length()))
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().cast("binary").alias("text"))

    def add_two(sketch: Sketch, part: Slice) -> None:
        for k in (1, 2):
            sketch.add(part.hashes(k, np.flatnonzero(part.phrases(k))))

    two = spark.sparkContext.broadcast(_sketched(texts, add_two, width, least))

    def add_more(sketch: Sketch, part: Slice) -> None:
        pairs = _pairs_passed(part, two.value)
        for k in range(3, longest + 1):
            sketch.add(part.hashes(k, np.flatnonzero(part.runs(pairs, k))))

    more = spark.sparkContext.broadcast(_sketched(texts, add_more, width, least))
    return written(_counted(texts, two, more, least, longest), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, held: int = HELD) -> DataFrame:
    """The best `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = frequencies(docs, least, longest)
    rows = counts.count()
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    found = counts.where("phrase <> '' and instr(phrase, ' ') > 0").select("lang", "phrase", F.col("f").alias("a"), words.alias("words"))
    size = F.size("words")

    def part(start, length):
        return F.array_join(F.slice("words", start, length), " ")

    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).withColumns({"first": part(1, F.col("k")), "rest": part(F.col("k") + 1, size - F.col("k"))})
    of_first, of_rest = (counts.select("lang", F.col("phrase").alias(c), F.col("f").alias(s)) for c, s in (("first", "l"), ("rest", "r")))
    cuts = cuts.join(broadcast_if_small(of_first, rows, 200_000), ["lang", "first"]).join(broadcast_if_small(of_rest, rows, 200_000), ["lang", "rest"])
    cuts = cuts.join(broadcast_if_small(totals, totals.count()), "lang")
    wide = {c: F.col(c).cast("decimal(38,0)") for c in "anlr"}
    cuts = cuts.withColumns({f"w{c}": v for c, v in wide.items()}).withColumn("score", F.expr("(1000 * wa * wn) div (wl * wr)"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # what longer candidates hold: their inner phrases, shorter ones of two words and more
    lengths = F.sequence(F.lit(2), size - 1)
    inner = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    longer = found.where(size > 2).select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where("longer is null or 100 * longer < {0} * a".format(held))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

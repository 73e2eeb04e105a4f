"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may differ from a passage by up to RATE * n edits.  Cut into one
piece more than that budget, at least one piece occurs unchanged in any such passage.
One automaton finds all pieces of all items in a text; each hit is verified by Myers'
bit-parallel distance over the stretch where the item would lie.

Texts and items are lower-cased and their white space runs become one space.  Items of
any length are looked for; those shorter than SHORT characters, which have no edits to
spare, must stand as whole words.  Nulls: a null text is empty; a null or blank item is
passed over.  Repeated items count once by item_id each; repeated rows give repeated
results; empty tables none.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import arrow_batches, filtered, held_model, whole_text

RATE = 0.06
SHORT = 20
#: Items that go to the tasks at once; a larger benchmark is matched in blocks.
ITEM_BLOCK = 20_000

_SPACE = re.compile(r"\s+")


def normalise(text: str) -> str:
    return _SPACE.sub(" ", text).strip().lower()


def budget(n: int, rate: float = RATE) -> int:
    return int(n * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces of near equal length."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether no word goes on over either end of a stretch."""
    return not (
        (start > 0 and text[start - 1].isalnum() and text[start].isalnum()) or (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())
    )


class Pattern:
    """An item with its bit masks for Myers' search."""

    def __init__(self, item_id: int, text: str, rate: float) -> None:
        self.item_id, self.text, self.errors = item_id, text, budget(len(text), rate)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the stretch of text nearest to the item; the first end among equals."""
        m = len(self.text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score = full, 0, m
        best, end = m, 0
        for j, c in enumerate(text):
            eq = self.masks.get(c, 0)
            x = eq | down
            d0 = ((((x & up) + up) ^ up) | x) & full
            ph = down | (~(d0 | up) & full)
            mh = up & d0
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & full
            mh = mh << 1 & full
            up = mh | (~(d0 | ph) & full)
            down = ph & d0
            if score < best:
                best, end = score, j + 1
        return best, end


class Matcher:
    def __init__(self, items: tuple[tuple[int, str], ...], rate: float = RATE) -> None:
        self.patterns = [Pattern(i, t, rate) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, p in enumerate(self.patterns):
            for offset, piece in pieces(p.text, p.errors):
                where.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of each item found, its nearest passage first met."""
        if not self.any:
            return []
        text = normalise(text)
        found: dict[int, tuple[int, int]] = {}
        seen: dict[int, int] = {}
        for end, (length, at) in self.automaton.iter(text):
            for k, offset in at:
                p = self.patterns[k]
                start = end + 1 - length - offset
                if (k in found and found[k][0] == 0) or seen.get(k) == start:
                    continue
                seen[k] = start  # a passage without shifts gives the same start for each piece
                if len(p.text) < SHORT and not whole_words(text, start, start + len(p.text)):
                    continue
                low = max(0, start - p.errors)
                stretch = text[low : start + len(p.text) + p.errors]
                exact = stretch.find(p.text)
                distance, stop = (0, exact + len(p.text)) if exact >= 0 else p.best(stretch)
                if distance <= p.errors and (k not in found or distance < found[k][0]):
                    found[k] = (distance, low + stop)
        return sorted((self.patterns[k].item_id, d, e) for k, (d, e) in found.items())


def matcher_of(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    return held_model(Matcher, items, rate)


def item_blocks(benchmark: DataFrame, block: int = ITEM_BLOCK) -> list[tuple[tuple[int, str], ...]]:
    """The normalised items in blocks of about `block`, each small enough for a task."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    n = -(-rows.count() // block)
    out = []
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).collect()
        out.append(tuple(sorted({(r.item_id, t) for r in part if (t := normalise(r.text))})))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance and end of each item that a document holds; documents without any have no row."""
    arrow_batches(docs.sparkSession)
    texts = docs.select("doc_id", whole_text().alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, distance int, end int"
    out = None
    for items in item_blocks(benchmark):

        def run(batches, items=items):
            matcher = matcher_of(items, rate)
            for batch in batches:
                found = [(k, *m) for k, t in enumerate(batch.column("text").to_pylist()) for m in matcher.matches(t)]
                row, *rest = zip(*found, strict=True) if found else ((), (), (), ())
                arrays = [pa.array(v, kind) for v, kind in zip(rest, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int32())), *arrays], names=["doc_id", "item_id", "distance", "end"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return texts.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold no item, with all their columns; decided row by row, without a join."""
    arrow_batches(docs.sparkSession)
    for items in item_blocks(benchmark):

        def make(items=items):
            matcher = matcher_of(items, rate)
            return lambda texts: [t is None or not matcher.matches(t) for t in texts]

        docs = filtered(docs, "text", make)
    return docs

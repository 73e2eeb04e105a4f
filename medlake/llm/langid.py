"""Language identification by cross-parsing entropy.

A suffix automaton holds labelled text of each language.  A text is parsed greedily
into longest matches against each automaton; the language that needs the fewest
phrases, normalised by the logarithm of its reference length, wins.  The automata are
dense transition tables, so that a batch of texts advances one character at a time in
numpy, in all languages at once.

The symbols are the UTF-8 bytes of the lower-cased letters; a run of anything else is
one symbol, since marks and digits tell no language.  Texts are parsed whole: segments advance side by
side, and those whose parse begins inside a phrase of the segment before it are parsed
again from there until both parses meet, so that phrases are those of one parse.

Nulls: a null text, or one without a letter, is `und` with score 0; rows without a
language are not learned from.  Ties go to the language first by name.  Repeated rows
give repeated results, an empty table none, and without any labelled row all is `und`.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.llm.common import arrow_batches, filtered, held_model, mapped, whole_text

#: Bounds of the labelled sample of each language: rows, and characters of each.  Rows of at most so many characters
#: come first, by the hash of their id; where a language has too few, longer ones give a passage whose place the hash picks.
SAMPLE_DOCS, SAMPLE_CHARS = 40, 1000
#: Bytes of a segment; no result depends on it.
SEGMENT = 512
#: Bytes times languages that are parsed side by side.
SIDE_BY_SIDE = 4 << 20
UNDETERMINED = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(language, text) of up to SAMPLE_DOCS documents a language, by the hash of their id; a bounded result."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    h, room = F.xxhash64("doc_id"), F.length("text") - SAMPLE_CHARS
    begin = F.when(room > 0, F.pmod(h, room + 1)).otherwise(0).cast("int") + 1
    rows = known.select("lang", (room > 0).alias("longer"), h.alias("h"), F.substring("text", begin, F.lit(SAMPLE_CHARS)).alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("longer", "h", "text"))
    picked = rows.withColumn("nth", nth).where(F.col("nth") <= SAMPLE_DOCS)
    by: dict[str, list[tuple[int, str]]] = {}
    for r in picked.select("lang", "nth", "text").collect():
        by.setdefault(r.lang, []).append((r.nth, r.text))
    return [(lang, "\n".join(t for _, t in sorted(by[lang]))) for lang in sorted(by)]


def suffix_automaton(codes: list[int], symbols: int) -> np.ndarray:
    """Transitions of the smallest automaton of all substrings; -1 where there is none."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    table = np.full((len(step), symbols), -1, np.int32)
    for s, to in enumerate(step):
        for c, t in to.items():
            table[s, c] = t
    return table


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(point).isalpha() for point in range(0x110000)), bool, 0x110000)


def symbols(text: str) -> np.ndarray:
    """The bytes of a text's symbols."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[points]
    points = np.where(letter, points, 32)[letter | np.append(True, letter[:-1])[: len(points)]]
    return np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)


class CrossParser:
    """Automata of several languages side by side."""

    def __init__(self, sample: tuple[tuple[str, str], ...]) -> None:
        self.langs = [lang for lang, _ in sample]
        learned = [symbols(text) for _, text in sample]
        used = np.unique(np.concatenate(learned)) if learned else np.zeros(0, np.uint8)
        self.code_of = np.zeros(256, np.uint8)  # 0: in no sample
        self.code_of[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        parts, self.bits, base = [], [], 0
        for raw in learned:
            t = suffix_automaton(self.code_of[raw].tolist(), width)
            # a failing transition holds the complement of where the next phrase starts
            restart = ~(np.maximum(t[0], 0) * width + base)
            parts.append(np.where(t >= 0, t * width + base, restart).astype(np.int32).ravel())
            self.bits.append(np.log2(len(raw) + 2))
            base += t.size
        self.table = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.roots = np.cumsum([0, *(len(p) for p in parts[:-1])]).astype(np.int32)[: len(parts)]
        self.bits = np.array(self.bits)

    def codes(self, text: str) -> np.ndarray:
        return self.code_of[symbols(text)]

    def _advance(self, flat: np.ndarray, at: np.ndarray, length: np.ndarray, state: np.ndarray, path: np.ndarray, broken: np.ndarray) -> np.ndarray:
        """Parse lanes (longest first) from their states to their ends; path and broken take the states and the phrases ended so far."""
        ended = np.zeros(len(at), np.int16)
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t, side="left"))  # lanes longer than t
            nxt = self.table[state[:n] + flat[at[:n] + t]]
            broke = nxt >> 31
            ended[:n] -= broke.astype(np.int16)
            state[:n] = nxt ^ broke
            path[t, :n], broken[t, :n] = state[:n], ended[:n]
        return state

    def _mended(self, flat: np.ndarray, at: int, length: int, state: int, path: np.ndarray, broken: np.ndarray) -> None:
        """Parse one lane again from a state inside a phrase, until it meets the parse that is there."""
        ended, codes = 0, flat[at : at + length].astype(np.int64)
        for t in range(length):
            nxt = int(self.table[state + codes[t]])
            if nxt < 0:
                nxt, ended = ~nxt, ended + 1
            if path[t] == nxt:
                broken[t:length] += ended - broken[t]
                return
            path[t], broken[t], state = nxt, ended, nxt

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text in each language, as rows and columns."""
        out, n = np.zeros((len(texts), len(self.langs))), max(1, len(self.langs))
        coded, held, first = [], 0, 0
        for i, text in enumerate(texts):
            coded.append(self.codes(text))
            held += len(coded[-1]) * n
            if held >= SIDE_BY_SIDE or i + 1 == len(texts):
                out[first : i + 1] = self._phrases(coded)
                coded, held, first = [], 0, i + 1
        return out

    def _phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(c) for c in coded])
        out = np.zeros((len(coded), len(self.langs)))
        if not sizes.sum():
            return out
        flat = np.concatenate(coded)
        owner = np.repeat(np.arange(len(coded)), -(-sizes // SEGMENT))
        within = np.concatenate([np.arange(0, n, SEGMENT) for n in sizes])
        length = np.minimum(SEGMENT, sizes[owner] - within)
        at = np.concatenate([[0], np.cumsum(sizes)])[owner] + within
        order = np.argsort(-length, kind="stable")
        last = np.append(owner[1:] != owner[:-1], True)  # segments that end their text
        for k, root in enumerate(self.roots.tolist()):
            path, broken = np.empty((int(length.max()), len(at)), np.int32), np.zeros((int(length.max()), len(at)), np.int16)
            self._advance(flat, at[order], length[order], np.full(len(at), root, np.int32), path, broken)
            place = np.empty(len(at), np.int64)
            place[order] = np.arange(len(at))
            end = path[length[order] - 1, np.arange(len(at))]
            for j in np.flatnonzero(within > 0):
                entry, lane = int(end[place[j - 1]]), int(place[j])
                if entry != root:
                    self._mended(flat, int(at[j]), int(length[j]), entry, path[:, lane], broken[:, lane])
                    end[lane] = path[length[j] - 1, lane]
            count = broken[length[order] - 1, np.arange(len(at))][place].astype(np.int64)
            count += last & (end[place] != root)
            out[:, k] = np.bincount(owner, count, len(coded))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and bits a character of each text; the score is the weight of the winner among all, from 0 to 1."""
        n = self.phrases(texts)
        langs, scores, bits = [], [], []
        for text, row in zip(texts, n, strict=True):
            if not self.langs or not any(c.isalpha() for c in text):
                langs.append(UNDETERMINED), scores.append(0.0), bits.append(0.0)
                continue
            cost = row * self.bits / self.bits.mean()
            k = int(cost.argmin())
            langs.append(self.langs[k])
            scores.append(float(1 / np.exp(-np.minimum(cost - cost[k], 700)).sum()))
            bits.append(float(row[k] * self.bits[k] / len(text)))
        return langs, scores, bits


def parser_of(sample: tuple[tuple[str, str], ...]) -> CrossParser:
    return held_model(CrossParser, sample)


def predict(docs: DataFrame, sample: list[tuple[str, str]], keep: list[str] | None = None) -> DataFrame:
    """lang_pred, score and bits_per_char of each text beside the columns to keep; the sample goes to the tasks as text."""
    arrow_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    sample = tuple(sample)

    def make():
        parser = parser_of(sample)
        return lambda texts: dict(zip(("lang_pred", "score", "bits_per_char"), parser.predict(texts), strict=True))

    return mapped(docs.select(*keep, whole_text().alias("__text")), keep, ["__text"], make, {"lang_pred": "string", "score": "double", "bits_per_char": "double"})


def accepted(docs: DataFrame, sample: list[tuple[str, str]]) -> DataFrame:
    """The rows whose language can be told, with all their columns; decided row by row."""
    arrow_batches(docs.sparkSession)
    sample = tuple(sample)

    def make():
        parser = parser_of(sample)
        return lambda texts: [lang != UNDETERMINED for lang in parser.predict([t or "" for t in texts])[0]]

    return filtered(docs, "text", make)

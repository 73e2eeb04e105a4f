"""SentencePiece encoding and decoding by N-best segmentation.

A text (with one space put ahead) is cut where a run of spaces begins; no piece of the
vocabulary goes on past a word into the next space, so the piece lattice of a text is a
chain of the lattices of its units.  Forward Viterbi scores of a lattice are exact
heuristics for an A* search backwards from its end, which yields the segmentations of a
unit in order of score; those of a text combine its units.  Each batch solves its
distinct units side by side in numpy, and the A* search runs only on the units whose
second choice costs least: no other unit can differ in the N best.

The vocabulary file is of the BPE kind and gives ranks, not probabilities; a piece scores
the logarithm of its rank, after Zipf, in whole ten-thousandths, so that sums are exact.  A
character that is no piece becomes its UTF-8 bytes.  Ties go to the shorter last piece.

Nulls: a null text is empty, and the empty text has no pieces.  Texts that hold the
vocabulary's own space mark round-trip as bytes.  Repeated rows give repeated results;
an empty table none.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from math import log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import arrow_batches, held_model, mapped, whole_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
MARK = "▁"
UNIT = re.compile(" +[^ ]*|[^ ]+")
NONE = -(1 << 60)
#: No path, in the 32-bit tables; three such still fit, and no unit of SIDE_BY_SIDE characters scores as low as a quarter of it.
LOW = -600_000_000
#: A score unit is a ten-thousandth.
UNITS = 10_000
BYTE_SCORE = -120_000
#: Units up to this length are solved side by side; longer ones one by one.
SIDE_BY_SIDE = 64
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


class Vocabulary:
    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece_of: dict[str, tuple[int, int]] = {}
        self.byte_id = [0] * 256
        self.bytes_of: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace(MARK, " ")
                self.piece_of.setdefault(text, (i, -round(UNITS * log(max(2, i - 256)))))
                self.bytes_of.append(text.encode())
        self.longest = max(map(len, self.piece_of))
        if any(re.search("[^ ] ", p) for p in self.piece_of):
            raise ValueError("a piece goes on past a word; units would not be independent")
        keys = {p: self._key(p) for p in self.piece_of}
        order = sorted(keys, key=keys.get)
        self.keys = np.array([keys[p] for p in order], np.uint64)
        self.ids = np.array([self.piece_of[p][0] for p in order], np.int32)
        self.scores = np.array([self.piece_of[p][1] for p in order], np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys * _MIX) >> np.uint64(44)] = True

    @staticmethod
    def _key(piece: str) -> int:
        k = 0
        for c in piece:
            k = (k * int(_P) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return k

    def fallback(self, char: str) -> tuple[tuple[int, ...], int]:
        raw = char.encode("utf-8", "surrogatepass")
        return tuple(self.byte_id[b] for b in raw), BYTE_SCORE * len(raw)

    def edges(self, unit: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """By end: (start, score, ids) of the edges of the lattice, the shortest first."""
        out: list[list] = [[] for _ in range(len(unit) + 1)]
        for j in range(1, len(unit) + 1):
            for m in range(1, min(j, self.longest) + 1):
                hit = self.piece_of.get(unit[j - m : j])
                if hit:
                    out[j].append((j - m, hit[1], (hit[0],)))
                elif m == 1:
                    ids, score = self.fallback(unit[j - 1])
                    out[j].append((j - 1, score, ids))
        return out

    def search(self, unit: str) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(score, ids) of the segmentations of a unit, the best first: A* backwards under forward Viterbi scores."""
        edges = self.edges(unit)
        ahead = [0] + [NONE] * len(unit)
        for j in range(1, len(unit) + 1):
            ahead[j] = max(ahead[i] + s for i, s, _ in edges[j])
        tick = 0
        heap: list = [(-ahead[-1], 0, len(unit), 0, None)]
        while heap:
            _, _, j, behind, path = heapq.heappop(heap)
            if j == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                yield behind, tuple(ids)
                continue
            for i, s, piece in edges[j]:
                tick += 1
                heapq.heappush(heap, (-(ahead[i] + s + behind), tick, i, behind + s, (piece, path)))

    def n_best(self, unit: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        out = []
        for found in self.search(unit):
            out.append(found)
            if len(out) == n:
                break
        return out

    def solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Best score, what the second choice loses (-NONE without one) and the best ids as bytes of each unit."""
        best, loss, blobs = np.zeros(len(units), np.int64), np.full(len(units), -NONE), [b""] * len(units)
        lengths = np.array([len(u) for u in units])
        low = 0
        for high in (6, 9, 12, 16, 24, 40, SIDE_BY_SIDE):
            pick = np.flatnonzero((lengths > low) & (lengths <= high))
            for at in range(0, len(pick), 20_000):
                part = pick[at : at + 20_000]
                best[part], loss[part], found = self._side_by_side([units[i] for i in part], lengths[part])
                for i, blob in zip(part, found, strict=True):
                    blobs[i] = blob
            low = high
        for i in np.flatnonzero(lengths > SIDE_BY_SIDE):
            best[i], loss[i], blobs[i] = self._alone(units[i])
        return best, loss, blobs

    def _alone(self, unit: str) -> tuple[int, int, bytes]:
        edges, n = self.edges(unit), len(unit)
        ahead, back = [0] + [NONE] * n, [None] * (n + 1)
        for j in range(1, n + 1):
            for e in edges[j]:
                if ahead[e[0]] + e[1] > ahead[j]:
                    ahead[j], back[j] = ahead[e[0]] + e[1], e
        behind = [NONE] * n + [0]
        for j in range(n, 0, -1):
            for i, s, _ in edges[j]:
                behind[i] = max(behind[i], behind[j] + s)
        path, j = [], n
        while j:
            path.append(back[j])
            j = back[j][0]
        on = {id(e) for e in path}
        other = max((ahead[e[0]] + e[1] + behind[j] for j in range(1, n + 1) for e in edges[j] if id(e) not in on), default=NONE)
        ids = [i for e in reversed(path) for i in e[2]]
        return ahead[n], ahead[n] - other if other > NONE // 2 else -NONE, np.array(ids, "<i4").tobytes()

    def _side_by_side(self, units: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """solve() for units of similar length; a row of each table is one place in all units."""
        width, n = int(lengths.max()), len(units)
        codes = np.frombuffer("".join([u.ljust(width, "\0") for u in units]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.ascontiguousarray(codes.reshape(n, width).T)
        points = codes.astype(np.uint64) + np.uint64(1)
        scores, ids = [], []
        key = np.zeros((width + 1, n), np.uint64)
        for m in range(1, min(width, self.longest) + 1):
            key = key[: width - m + 1] * _P
            key += points[m - 1 :]
            s, d = np.full(key.shape, LOW, np.int32), np.zeros(key.shape, np.int16)
            where = np.flatnonzero(self.maybe[(key * _MIX) >> np.uint64(44)])
            k = key.ravel()[where]
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            ok = self.keys[at] == k
            where, at = where[ok], at[ok]
            s.ravel()[where], d.ravel()[where] = self.scores[at], self.ids[at]
            if m == 1:
                bare = s == LOW
                s[bare] = BYTE_SCORE * (1 + (codes[bare] > 0x7F) + (codes[bare] > 0x7FF) + (codes[bare] > 0xFFFF)).astype(np.int32)
                d[bare] = -1
                s[np.arange(width)[:, None] >= lengths] = LOW
            scores.append(s), ids.append(d)
        ahead, back = np.full((width + 1, n), LOW, np.int32), np.zeros((width + 1, n), np.int8)
        ahead[0] = 0
        for j in range(1, width + 1):
            for m in range(1, min(j, self.longest) + 1):
                c = ahead[j - m] + scores[m - 1][j - m]
                up = c > ahead[j]
                np.copyto(ahead[j], c, where=up)
                back[j][up] = m
        rows = np.arange(n)
        behind = np.full((width + 1, n), LOW, np.int32)
        behind[lengths, rows] = 0
        for i in range(width - 1, -1, -1):
            for m in range(1, min(width - i, self.longest) + 1):
                np.maximum(behind[i], behind[i + m] + scores[m - 1][i], out=behind[i])
        best = ahead[lengths, rows].astype(np.int64)
        path, count, bare = np.zeros((n, width), np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
        taken = [np.zeros(s.shape, bool) for s in scores]
        at, live = lengths.copy(), rows
        while len(live):
            m = back[at[live], live]
            start = at[live] - m
            for size in np.unique(m):
                w = m == size
                u, i = live[w], start[w]
                piece = ids[size - 1][i, u]
                taken[size - 1][i, u] = True
                path[u, width - 1 - count[u]] = piece
                bare[u] |= piece < 0
            count[live] += 1
            at[live] = start
            live = live[at[live] > 0]
        second = np.full(n, LOW, np.int32)
        for m, s in enumerate(scores, 1):
            total = ahead[: width - m + 1] + s
            total += behind[m:]
            total[taken[m - 1]] = LOW
            np.maximum(second, total.max(0), out=second)
        blobs, raw, step = [], path.astype("<i4").tobytes(), 4 * width
        for u, c in enumerate(count.tolist()):
            blobs.append(raw[(u + 1) * step - 4 * c : (u + 1) * step])
        for u in np.flatnonzero(bare):
            blobs[u] = np.array(self._spelled(units[u], path[u, width - count[u] :]), "<i4").tobytes()
        return best, np.where(second > LOW // 4, best - second, -NONE), blobs

    def _spelled(self, unit: str, row: np.ndarray) -> list[int]:
        """Ids of a best path with its bare characters spelled in bytes."""
        out, at = [], 0
        for piece in row:
            if piece < 0:
                out += self.fallback(unit[at])[0]
                at += 1
            else:
                out.append(int(piece))
                at += len(self.bytes_of[piece].decode())
        return out

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "surrogatepass")
        return out[1:] if out[:1] == " " else out


def vocabulary(path: str = MODEL) -> Vocabulary:
    return held_model(Vocabulary, path)


def segment(texts: list[str], vocab: Vocabulary, n: int = N_BEST) -> list[list[tuple[int, bytes]]]:
    """Up to n (score, ids as bytes) of each text, the best first."""
    split = [UNIT.findall(" " + t) if t else [] for t in texts]
    number: dict[str, int] = {}
    for units in split:
        for u in units:
            if u not in number:
                number[u] = len(number)
    best, loss, blobs = vocab.solve(list(number))
    out = []
    for units in split:
        at = np.fromiter(map(number.__getitem__, units), np.int64, len(units))
        parts = [blobs[k] for k in at]
        found = [(int(best[at].sum()), {})]
        if n > 1 and len(units):
            near = loss[at]
            for place in np.argsort(near, kind="stable")[: n - 1]:
                if near[place] >= -NONE:
                    break
                choices = vocab.n_best(units[place], n)
                top = choices[0][0]
                merged = [(s + c[0] - top, k, len(f), i, f, c) for i, (s, f) in enumerate(found) for k, c in enumerate(choices)]
                merged.sort(key=lambda x: (-x[0], x[2] + (x[1] > 0), x[3], x[1]))
                found = [(s, f | {int(place): c[1]} if k else f) for s, k, _, _, f, c in merged[:n]]
        rows = []
        for s, changed in found:
            these = parts
            if changed:
                these = parts.copy()
                for place, ids in changed.items():
                    these[place] = np.array(ids, "<i4").tobytes()
            rows.append((s, b"".join(these)))
        out.append(rows)
    return out


def encode(docs: DataFrame, n_best: int = N_BEST, model: str = MODEL) -> DataFrame:
    """doc_id, ids of each of the n best segmentations, their scores, and whether the best decodes to the text."""
    return _run(docs, n_best, model, "ids array<array<int>>", lambda found: [np.frombuffer(b, "<i4") for _, b in found])


def encode_best(docs: DataFrame, n_best: int = N_BEST, model: str = MODEL) -> DataFrame:
    """As encode, with the ids of the best segmentation only; the scores are of the n best."""
    return _run(docs, n_best, model, "ids array<int>", lambda found: np.frombuffer(found[0][1], "<i4"))


def encode_digest(docs: DataFrame, n_best: int = N_BEST, model: str = MODEL) -> DataFrame:
    """As encode, with the hash of each segmentation's little-endian ids for the ids."""
    return _run(docs, n_best, model, "ids_sha256 array<string>", lambda found: [hashlib.sha256(b).hexdigest() for _, b in found])


def _run(docs: DataFrame, n_best: int, model: str, column: str, made: Callable[[list[tuple[int, bytes]]], object]) -> DataFrame:
    arrow_batches(docs.sparkSession)
    name, kind = column.split()

    def make():
        vocab = vocabulary(model)

        def work(texts):
            found = segment(texts, vocab, n_best)
            best = [np.frombuffer(rows[0][1], "<i4") for rows in found]
            return {
                "n_pieces": [len(x) for x in best],
                name: [made(rows) for rows in found],
                "scores": [[s / UNITS for s, _ in rows] for rows in found],
                "round_trip": [vocab.decode(x) == t for x, t in zip(best, texts, strict=True)],
            }

        return work

    added = {"n_pieces": "long", name: kind, "scores": "array<double>", "round_trip": "boolean"}
    return mapped(docs.select("doc_id", whole_text().alias("__text")), ["doc_id"], ["__text"], make, added)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text of the best segmentation."""

    def make():
        vocab = vocabulary(model)
        return lambda found: {"text": [vocab.decode(np.array(x, np.int64)) for x in found]}

    return mapped(encoded.select("doc_id", F.col("ids")[0].alias("__ids")), ["doc_id"], ["__ids"], make, {"text": "string"})

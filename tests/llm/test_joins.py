"""The n-gram join against every pair, on sets made to lie at the threshold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from medlake.llm import ngramjoin

from .test_operators import DOCS, fixture_texts, words


def grams(text, n=3):
    split = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    split = [w for w in split if w]
    if not split:
        return frozenset()
    return frozenset(tuple(split[i : i + n]) for i in range(max(1, len(split) - n + 1)))


def plain(rows, percent=90):
    """doc_id -> (size, component) of (doc_id, text) rows."""
    sets = {i: grams(t) for i, t in rows}
    of = {i: i for i in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                of[high] = low
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_texts():
    """Texts of all sizes with a few words changed, added or cut, so that similarities lie around the threshold; chains of such."""
    rng = random.Random(9)
    out = fixture_texts()
    for n in [3, 5, 9, 11, 12, 13, 20, 22, 30, 31, 47, 60, 100, 180, 400]:
        base = words(rng, n, "abcdefghijkl").split(" ")
        now = list(base)
        for _ in range(6):
            now = list(now)
            kind, at = rng.randrange(3), rng.randrange(len(now))
            if kind == 0:
                now[at] = "changed"
            elif kind == 1:
                now.insert(rng.choice([0, at, len(now)]), "added")
            elif len(now) > 3:
                del now[rng.choice([0, at, -1])]
            out += [" ".join(now), " ".join(now).upper()]
    passage = words(rng, 300)
    out += [passage + " " + words(rng, rng.randint(5, 40)) for _ in range(12)]
    return out


def test_join_finds_every_link(spark):
    texts = near_texts()
    df = spark.createDataFrame([(i, t, "a", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(3)
    want = plain(list(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.joined(df).collect()}
    assert got == want
    assert 20 < len({c for _, c in want.values()}) < len(texts) - 40


def test_linked_sets_share_a_key():
    """Whatever the sizes, two sets at the threshold or above meet under a key."""
    rng = np.random.default_rng(3)
    for n in [9, 10, 12, 17, 18, 19, 27, 40, 63, 64, 100, 333, 1000, 5000]:
        for _ in range(8):
            both = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
            spare = len(both) * 10 // 90
            a, b = sorted((int(rng.integers(0, spare + 1)), int(rng.integers(0, spare + 1))))
            only_x, only_y = a, min(spare - a, b)
            x = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, only_x, np.uint64) * np.uint64(2) + np.uint64(1)]))
            y = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, only_y, np.uint64) * np.uint64(2) + np.uint64(1)]))
            assert 100 * len(both) >= 90 * (len(x) + len(y) - len(both))
            if len(x) != len(y) or only_x or only_y:
                assert set(ngramjoin.keys_of(x).tolist()) & set(ngramjoin.keys_of(y).tolist())


def test_most_apart_bounds_every_pair():
    for percent in (80, 90):
        for x in range(1, 200):
            for y in range(x, 100 * x // percent + 1):
                least = -(-percent * (x + y) // (100 + percent))
                below, own, after = ngramjoin.class_of(x, percent)
                assert x + y - 2 * least <= ngramjoin.most_apart(after - 1, percent)
                assert ngramjoin.class_of(y, percent)[1] == own or ngramjoin.class_of(y, percent)[0] == own


def test_overlaps_are_summed_over_fragments(spark):
    texts = [words(random.Random(k), 200, "abc") for k in range(4)]
    df = spark.createDataFrame([(i, t, "a", "s", 0) for i, t in enumerate(texts)], DOCS)
    at = df.select(F.col("doc_id").alias("id"), "doc_id", ngramjoin.text_key())
    parts = ngramjoin.segments(df, at, 3)
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(a)], "b long, a long")
    sets = [grams(t) for t in texts]
    got = {(r.a, r.b): (r.size_a, r.size_b, r.overlap) for r in ngramjoin.overlaps(pairs, parts).collect()}
    assert got == {(b, a): (len(sets[b]), len(sets[a]), len(sets[a] & sets[b])) for a in range(4) for b in range(a)}
    assert parts.select("fragment").distinct().count() == ngramjoin.FRAGMENTS


@pytest.mark.parametrize("rows", [[], [(None, "a b c d", None, None, None)], [(1, None, None, None, None), (1, "", None, None, None)]])
def test_join_edges(spark, rows):
    got = ngramjoin.joined(spark.createDataFrame(rows, DOCS)).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == [(r[0], 0, r[0]) for r in rows if r[0] is not None]


def test_join_repeated_ids_extra_columns_and_large_groups(spark):
    """Rows of one doc_id with other texts are documents of their own; a long text and a group of copies keep their class."""
    rng = random.Random(4)
    long = words(rng, 30_000)
    many = words(rng, 40)
    rows = [(1, long, "x"), (2, long + " more", "x"), (3, "one two three four", "x"), (3, many, "x"), (3, many, "x")] + [(10 + i, many, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumns({"key": F.lit(1), "component": F.lit("c"), "a": F.lit(2), "set_key": F.lit(b"q")})
    got = sorted((r.doc_id, r.component_id) for r in ngramjoin.joined(df).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (3, 3), (3, 3)] + [(10 + i, 3) for i in range(60)]

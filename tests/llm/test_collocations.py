"""Phrase collocations against a plain count of every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from medlake.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string"


def lower(text):
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")


def counts_of(rows, longest=5):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            split = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(split)
            for k in range(1, longest + 1):
                f[lang or "und"].update(" ".join(split[i : i + k]) for i in range(len(split) - k + 1))
    return f, n


def plain(rows, least, top=2000, held=100):
    f, n = counts_of(rows)
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least and " " in p}
        best = []
        for p, a in found.items():
            split = p.split(" ")
            if any(len(q) > len(p) and 100 * b >= held * a and f" {p} " in f" {q} " for q, b in found.items()):
                continue
            cuts = [(1000 * a * n[lang] // (counts[" ".join(split[:k])] * counts[" ".join(split[k:])]), k) for k in range(1, len(split))]
            score, k = min(cuts)
            best.append((-score, -a, p.encode(), counts[" ".join(split[:k])], counts[" ".join(split[k:])]))
        for rank, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def sample():
    rng = random.Random(8)
    pool = ["the", "of", "and", "Paris", "città", "straße", "naïve", "x y", "𠮷", "\x1c", "new", "york"]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 8)):
            run = rng.choices(pool, k=rng.randint(1, 9)) + rng.choice([[], ["New", "York", "city", "of", "light"], ["sine", "qua", "non"]])
            parts.append(rng.choice([" ", "  ", "\t"]).join(run))
        rows.append((i, rng.choice([". ", ", ", "\n", "?!", "\r\n", " "]).join(parts), rng.choice(["en", "fr", None, "und"])))
    return rows + [(900, None, "en"), (901, "", None), (901, "", None), (902, " . , ", "xx"), (None, "new york new york", "en")] + [(903, "only one", "one")]


def test_collocations_match_a_plain_count(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for least, held in ((12, 100), (30, 60)):
        got = sorted(tuple(r) for r in c.collocations(df, least=least, held=held).collect())
        assert got == plain(rows, least, held=held) and len(got) > 5


def test_top_and_ties(spark):
    rows = [(1, "b a. a b. b c. c b. " * 30, "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in c.collocations(df, least=30, top=3).collect())
    assert got == plain(rows, 30, top=3) and [r[2] for r in got] == ["a b", "b a", "b c"]


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b", "en")]])
def test_no_candidates(spark, rows):
    assert c.collocations(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_extra_columns_clash(spark):
    df = spark.createDataFrame([(1, "x y. " * 40, "en", 5, "p")], "doc_id long, text string, lang string, n long, phrase string")
    assert [tuple(r) for r in c.collocations(df, least=10).collect()] == [("en", 1, "x y", 40, 40, 40, 80, 2000)]


def test_sketch_never_counts_too_little():
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, 1 << 63, 500, np.uint64)
    drawn = kinds[np.minimum(rng.geometric(0.01, 40_000), 500) - 1]
    whole = c.Sketch(1 << 10, 100)
    whole.add(drawn)
    flat = (whole.counts >= 100).reshape(c.DEPTH, -1)
    passed = c.Passed(1 << 10, np.packbits(flat, axis=1, bitorder="little"))
    true = Counter(drawn.tolist())
    hit = passed.test(kinds)
    assert all(hit[i] for i, k in enumerate(kinds.tolist()) if true[k] >= 100)
    assert whole.counts.max() == 100


@pytest.mark.parametrize("most", [7, 40, 300])
def test_slices_of_long_texts_count_as_one(most):
    """A text cut into small slices gives the counts of the whole, phrases over the cuts included."""
    rows = [(i, t, "en") for i, (_, t, _) in enumerate(sample()) if t]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(rows), "text": [t.encode() for _, t, _ in rows]})
    every = c.Passed(1 << 10, np.full((c.DEPTH, 1 << 7), 255, np.uint8))
    total = Counter()
    for sums in c.tallies(c._slices(iter([batch]), most), every, every, 5):
        total.update(sums)
    f, n = counts_of(rows)
    assert total.pop(("en", b"")) == n["en"]
    assert {k[1].decode(): v for k, v in total.items()} == dict(f["en"])


def test_sketches_of_slices_hold_every_phrase_once():
    text = "a b c d e f a b c d e f " * 20
    for most in (11, 10_000):
        parts = [c.Slice("en", *p) for p in c._cut(text.encode(), most)]
        n = sum(int(p.phrases(3).sum()) for p in parts)
        assert n == len(text.split()) - 2

"""The training-data operators against plain versions, on planted fixtures with hard edges."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from medlake.llm import components, decontaminate, htmltext, langid, linededup, minhash, pieces, secrets, sharding, suffixdedup, syncmers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(n))


def fixture_texts():
    """Copies, near copies, shared passages and lines, edges: nulls, empties, no letters, one word, control and wide characters."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(20, 160)) for _ in range(30)]
    passage = words(rng, 130)
    texts = [None, "", "   ", "\n\n", "12 34 !!", "word", "é", "a\x00b", "𠮷野家 𠮷", "x" * 900, "x" * 450 + "y", "ab " * 400]
    texts += base + base[:4] + base[:1] * 6
    for b in base[:8]:
        w = b.split(" ")
        w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [words(rng, 10) + "\n" + passage + "\n" + words(rng, 12) for _ in range(5)]
    texts += ["one common line that many hold\n" + words(rng, 30) for _ in range(6)]
    texts += ["one common line that many hald\nshort\n" + words(rng, 30), "one commn line that many hold!\nshort"]
    return texts


@pytest.fixture(scope="module")
def texts():
    return fixture_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "ab"[i % 2], "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1 secrets


def plain_base(text):
    import re

    out = []
    for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32)), 1):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return ",".join(x[2] for x in sorted(out))


SECRETS = [
    None, "", "token=secret=abcdefgh", "secret=api_key:abcdefghijk", "PassWord: 'hunter2hunter2'", "ſecret=abcdefghij", "toKen = abcdefghij", "password=short",
    "AKIAAKIA AKIAABCDEFGHIJKL AKIAABC", "é" * 5 + "f" * 31 + " " + "0123456789abcdef" * 2, "apikey=" + "a" * 5000, "token:" + "0123456789abcdef" * 3,
    "credential: Zm9vYmFyMTIzNDU2Nzg5MA== ok", "see ghp_abcdEFGH1234ijklMNOP5678qrstUVWX9012 there",
]


def test_secrets_base_is_exact(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SECRETS)], "doc_id long, text string")
    got = by_id(secrets.digest(secrets.scan(df.withColumn("kinds", F.lit(1)))))
    for i, t in enumerate(SECRETS):
        assert got[i].base_sha256 == hashlib.sha256(plain_base(t or "").encode()).hexdigest(), t
        assert set(x for x in plain_base(t or "").split(",") if x) <= set(got[i].spans.split(","))
    assert got[12].n_learned == 1 and got[13].n_learned == 1


#: Labelled by hand, in forms of their own: text, and the value to find or None.
BY_HAND = [
    ("pwd: correcthorsebattery ok", "correcthorsebattery"), ("my passphrase = tiger-lemon-boat", "tiger-lemon-boat"), ("credential: Zm9vYmFyMTIzNDU2Nzg5MA== ok", "Zm9vYmFyMTIzNDU2Nzg5MA=="),
    ("see ghp_abcdEFGH1234ijklMNOP5678qrstUVWX9012 there", "ghp_abcdEFGH1234ijklMNOP5678qrstUVWX9012"), ("export SIGNING_KEY=q8Zr1tYw7Lk2Pd5Nf3Vb", "q8Zr1tYw7Lk2Pd5Nf3Vb"),
    ("ref ABC-123456-2024-0099-XY end", None), ("built 20240131T101500Z-3321 done", None), ("build: 2024-01-31T101500", None), ("title: correcthorsebattery", None),
    ("id: 550e8400-e29b-41d4-a716-446655440000 x", None), ("get https://files.example.com/releases/app-installer-10.4.2-beta1.zip now", None), ("invoice: 20240011223344", None),
    ("order no: DE-99-8877-AB", None), ("phone: 030-5550-123456", None), ("see chapter-seven-appendix-12 for it", None),
]


def test_secrets_by_hand():
    net = secrets.model()
    for text, value in BY_HAND:
        found = [text[s:e] for s, k, e, _ in secrets.scan_text(text, net) if k == "learned"]
        assert (value is None and not found) or (len(found) == 1 and value in found[0]), (text, found)


def test_every_candidate_is_scored_and_names_may_be_long():
    net = secrets.model()
    (found,) = secrets.scan_text("token=abcdefgh1", net)
    assert found[1] == "assign" and found[3] < 1
    assert secrets.candidates("x" * 90 + " " * 90 + "= abcdefghij") == [(182, 192)] and secrets.candidates(" = abcdefghij") == []


def test_secrets_network_keeps_its_recall():
    net = secrets.model()
    x, y = secrets.labelled_findings(600, seed=77)
    hit = net.scores(x) >= net.threshold
    assert hit[y > 0].mean() >= 0.95 and hit[y == 0].mean() <= 0.05


def test_redaction():
    text = "a token=abcdefgh1 b"
    assert secrets.redact(text, secrets.scan_text(text, secrets.model())) == "a [secret] b"


# 2 language


def test_suffix_automaton_knows_all_substrings():
    rng = random.Random(3)
    s = [rng.randrange(3) for _ in range(60)]
    t = langid.suffix_automaton(s, 3)
    subs = {tuple(s[i:j]) for i in range(60) for j in range(i + 1, min(60, i + 8) + 1)}
    for _ in range(500):
        q = tuple(rng.randrange(3) for _ in range(rng.randint(1, 8)))
        state = 0
        for c in q:
            state = t[state, c] if state >= 0 else -1
        assert (state >= 0) == (q in subs)


def test_phrases_match_a_greedy_parse():
    sample = (("a", "banana band"), ("b", "cabbage can"))
    p = langid.CrossParser(sample)
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("abncdge ") for _ in range(rng.randint(0, 40)))
        while "  " in text:
            text = text.replace("  ", " ")
        for k, (_, ref) in enumerate(sample):
            n, at = 0, 0
            while at < len(text):
                size = 1
                if text[at] not in ref and not text[at].isspace():  # a character the language lacks is a phrase
                    n, at = n + 1, at + 1
                    continue
                while at + size < len(text) and text[at : at + size + 1] in ref:
                    size += 1
                n, at = n + 1, at + size
                if at < len(text) and text[at] not in ref:
                    at += 1  # it ends the phrase before it
            assert p.phrases([text])[0, k] == n, (text, ref)


def test_language_of_held_out_rows(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 40, "abcdef" if i % 2 else "uvwxyz") if i % 20 else None, None if i % 7 == 0 else ("p" if i % 2 else "q"), "s", 0) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x"))
    got = by_id(langid.predict(df, langid.labelled_sample(df)))
    for i, t, *_ in rows:
        assert got[i].lang_pred == ("und" if t is None else "p" if i % 2 else "q")
        assert 0 <= got[i].score <= 1
    held = by_id(df.select("doc_id", langid.held_out().alias("h")))
    assert all(held[i].h == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(200))
    assert all(r.lang_pred == "und" for r in langid.predict(df, []).collect())
    assert langid.accepted(df, langid.labelled_sample(df)).columns == df.columns
    assert langid.accepted(df, langid.labelled_sample(df)).count() == 190


def plain_phrases(parser, text, k):
    state, n = int(parser.roots[k]), 0
    for c in parser.codes(text).tolist():
        state = int(parser.table[state + c])
        if state < 0:
            state, n = ~state, n + 1
    return n + (state != parser.roots[k])


def test_no_result_depends_on_segments(monkeypatch):
    monkeypatch.setattr(langid, "SEGMENT", 7)
    monkeypatch.setattr(langid, "SIDE_BY_SIDE", 500)
    rng = random.Random(21)
    parser = langid.CrossParser((("a", words(rng, 80)), ("b", "ab" * 60), ("c", "é漢字 " * 20)))
    texts = [words(rng, rng.randrange(60), "abcé漢") for _ in range(40)] + ["ab" * 100, "", "a", "b" * 500, words(rng, 80)]
    got = parser.phrases(texts)
    assert [[plain_phrases(parser, t, k) for k in range(3)] for t in texts] == got.tolist()


def test_scripts_of_many_letters_are_told_apart():
    parser = langid.CrossParser((("ja", "これは日本語の文章です。私は毎日学校へ行きます。"), ("zh", "这是一个中文句子。我每天去学校学习。"), *((f"x{i}", "abcdefghijklmnopqrstuvwxyz") for i in range(3))))
    assert parser.predict(["私は学校へ行きます", "我去学校学习", "12 ?!"])[0] == ["ja", "zh", "und"]


def test_long_rows_are_learned_from_anywhere(spark):
    rows = [(i, "a" * 1500 + "b" * 1500, "l", "s", 0) for i in range(60)] + [(100, "short whole row", "m", "s", 0), (103, "short whole row", "m", "s", 0)]
    sample = dict(langid.labelled_sample(spark.createDataFrame(rows, DOCS)))
    assert "b" in sample["l"] and "a" in sample["l"] and "short whole row" in sample["m"]
    assert max(map(len, sample["l"].split("\n"))) == langid.SAMPLE_CHARS and sample["l"].count("\n") < langid.SAMPLE_DOCS


# 3 pages

PAGE = (
    '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav>Home</nav><div class="ad">Buy</div>{before}<article><h1>Head &amp; x</h1>'
    '<p>One  <b>two</b><br>three<p>Four &lt;five<div class="comments"><p>me too</p></div></article>{after}<footer>F</footer></body></html>'
)


def test_blocks():
    assert [t for t, _ in htmltext.blocks(PAGE.format(before="", after=""))] == ["Head & x", "One two three", "Four <five"]
    assert htmltext.blocks("") == [] and htmltext.blocks("plain < text") == [("plain < text", False)]
    assert htmltext.blocks("<div class='ad'>open<article>in</article>") == [("in", True)]
    assert htmltext.blocks("a<!-- b --><style>c</style><p>d<script>e") == [("a", False), ("d", False)]


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(4)

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        got = htmltext.common(a, b)
        assert len(got) == lcs(a, b) and got == sorted(set(got))


def test_shared_lines_outside_the_article_go(spark):
    loose = "<html><body><p>site line one</p><p>site line two</p><div><p>{0} only here</p><p>{0} and here</p><p>{0} more</p><p>{0} last</p></div><p>site end</p></body></html>"
    rows = [(i, f"http://h.example/a/p{i}", loose.format(f"text {i}")) for i in range(6)]
    rows += [(10, "http://h.example/b/1", PAGE.format(before="", after="")), (11, "http://h.example/b/2", PAGE.format(before="", after="")), (12, None, None), (13, "http://h.example/b/3", ""), (None, "http://h.example/b/3", "x")]
    got = {r.page_id: r for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("mate", F.lit(1))).collect()}
    assert all(got[i].text == f"text {i} only here\ntext {i} and here\ntext {i} more\ntext {i} last" for i in range(6))
    assert got[10].text == got[11].text == "Head & x\nOne two three\nFour <five" and got[10].n_chars == len(got[10].text)
    assert got[12].text == got[13].text == "" and got[None].text == "x"
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shared_lines_go_from_articles_short_pages_and_copies(spark):
    short = "<body><{1}><p>menu</p><p>notice</p><p>share this</p><p>{0} one</p><p>{0} two</p><p>{0} three</p><p>all rights</p></{1}></body>"
    rows = [(i, f"http://a.example/x/p{i}", short.format(f"text {i}", "article" if i < 3 else "div")) for i in range(6)]
    rows += [(10, "http://b.example/x/p1", short.format("text 10", "div")), (11, "http://b.example/x/p1-print", short.format("text 10", "div")), (12, "http://b.example/x/q1", short.format("text 12", "div"))]
    rows += [(20, "http://c.example/x/p1", short.format("text 20", "div")), (21, "http://c.example/x/p1-print", short.format("text 20", "div"))]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = {i: f"text {i} one\ntext {i} two\ntext {i} three" for i in (*range(6), 10, 12)} | {11: "text 10 one\ntext 10 two\ntext 10 three"}
    assert {i: got[i] for i in own} == own
    assert got[20] == got[21] == "menu\nnotice\nshare this\ntext 20 one\ntext 20 two\ntext 20 three\nall rights"


def test_results_come_from_pairing(spark, monkeypatch):
    """Without article tags, site lines go only because a neighbour has them."""
    loose = "<body><p>menu</p><p>notice</p><p>{0} one</p><p>{0} two</p><p>{0} three</p><p>all rights</p></body>"
    df = spark.createDataFrame([(i, f"http://a.example/x/p{i}", loose.format(f"text {i}")) for i in range(4)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert got == {i: f"text {i} one\ntext {i} two\ntext {i} three" for i in range(4)}
    alone = htmltext.nearest(df).limit(0)
    monkeypatch.setattr(htmltext, "nearest", lambda pages: alone)
    assert all(r.text.startswith("menu\nnotice\n") for r in htmltext.extract(df).collect())


def test_names_inside_articles():
    page = "<div class='header'>H</div><p class='social'>S</p><article><p class='social'>kept</p><div class='header'>kept too</div><div class='comments'>me</div><h2 id='notice'>stays</h2></article>"
    assert [t for t, _ in htmltext.blocks(page)] == ["kept", "kept too", "stays"]


def test_pages_of_one_id(spark):
    rows = [(1, "http://a.example/1", "<p>one</p>"), (1, "http://a.example/1", "<p>two</p>"), (2, "http://a.example/2", "<p>x</p>")]
    got = sorted(r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == ["one", "two", "x"]


# 4 suffixes


def plain_suffix_dedup(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    out = []
    for b in raw:
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                mark[i] += 1
                mark[i + 400] -= 1
        gone = np.cumsum(mark)[: len(b)] > 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("bucket", [20_000, 1])
def test_suffix_dedup(spark, docs, texts, none, monkeypatch, bucket):
    monkeypatch.setattr(suffixdedup, "BUCKET", bucket)
    got = by_id(suffixdedup.digest(docs.withColumn("row", F.lit(0))))
    for i, want in enumerate(plain_suffix_dedup(texts)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
    assert suffixdedup.digest(none).count() == 0


def test_suffix_dedup_sorts_no_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "BUCKET", 5)
    sizes, sort = [], suffixdedup.sort_buckets

    def spied(rows):
        sizes.append(max([r["count"] for r in rows.groupBy("bucket").count().collect()], default=0))
        return sort(rows)

    monkeypatch.setattr(suffixdedup, "sort_buckets", spied)
    rng = random.Random(41)
    passage = words(rng, 120)
    texts = [words(rng, 90) + " " + passage + " " + words(rng, 90) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(suffixdedup.digest(df))
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in (got[i] for i in range(20))] == plain_suffix_dedup(texts)
    assert sizes and max(sizes) <= 5


def test_suffix_dedup_shuffles_only_texts_that_meet_something(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "BROADCAST_ENTRIES", 0)
    rng = random.Random(43)
    passage = words(rng, 120)
    texts = [words(rng, 200) for _ in range(60)]
    texts += [words(rng, 90) + " " + passage + " " + words(rng, 90) for _ in range(4)]
    met, likely = [], suffixdedup.likely

    def spied(rows, few, keys):
        out = likely(rows, few, keys)
        if "text" in rows.columns:
            met.append({r.doc_id for r in out.where("met").select("doc_id").collect()})
        return out

    monkeypatch.setattr(suffixdedup, "likely", spied)
    got = by_id(suffixdedup.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in (got[i] for i in range(64))] == plain_suffix_dedup(texts)
    assert len(met) == 2 and all(m <= {60, 61, 62, 63} for m in met) and met[-1] == {60, 61, 62, 63}


@pytest.mark.parametrize("n_words", [1, 4, 1 << 19])
def test_likely_rows_hold_all_that_meet(spark, monkeypatch, n_words):
    monkeypatch.setattr(suffixdedup, "WORDS", n_words)
    rows = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    few = rows.where("a % 50 = 3").unionByName(rows.where("a % 50 = 3"))
    got = suffixdedup.likely(rows, few, ["a", "b"])
    assert got.columns == ["a", "b", "met"] and got.count() == 2000
    met = {r.a for r in got.where("met").collect()}
    assert met >= set(range(3, 2000, 50)) and (n_words < 1 << 19 or len(met) < 60)


# 5 shards


def test_sharding(spark, docs, texts, none, tmp_path):
    got = by_id(sharding.shard(docs.withColumn("shard", F.lit(9)), 4, 64))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (got[i].size, got[i].text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    places, loads = {}, Counter()
    for r in got.values():
        places.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    slot_bytes = Counter()
    for r in got.values():
        slot_bytes[r.vslot] += r.size
    assert max(loads.values()) - min(loads.values()) <= max(slot_bytes.values())
    assert sharding.shard(none, 4, 64).count() == 0
    records = sharding.sized(docs, 64)
    totals = sharding.slot_totals(records, 64)
    first = sharding.first_map(totals, 4)
    second = sharding.grown_map(first, totals, 4)
    old, new = ({r.vslot: r.shard for r in m.collect()} for m in (first, second))
    assert all(new[v] in (s, 4) for v, s in old.items()) and 4 in new.values()
    path = str(tmp_path / "maps")
    sharding.store_map(first, path), sharding.store_map(second, path)
    assert {r.vslot: r.shard for r in sharding.load_map(spark, path).collect()} == new
    assert {r.vslot: r.shard for r in sharding.load_map(spark, path, 1).collect()} == old
    grown = by_id(sharding.shard(docs, 4, 64, path))
    assert all(grown[i].shard in (r.shard, 4) for i, r in got.items()) and any(r.shard == 4 for r in grown.values())


# 6 benchmark


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_myers_is_the_best_substring_distance():
    rng = random.Random(6)
    for _ in range(150):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (8, 14))
        want = min(edit_distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert decontaminate.Pattern(0, p, 1.0).best(t)[0] == want


def test_leaks(spark, none):
    rng = random.Random(7)
    items = [words(rng, 25) for _ in range(6)]
    bench = spark.createDataFrame([*((i, t) for i, t in enumerate(items)), (6, None), (7, "tiny"), (None, "x" * 50)], "item_id long, text string")
    rows = [(i, words(rng, 40)) for i in range(20)] + [(20, None), (21, "")]
    edits = {}
    for k in range(12):
        item = list(items[k % 6])
        for _ in range(decontaminate.budget(len(item)) if k >= 6 else 0):
            item[rng.randrange(len(item))] = rng.choice("xyz")
        rows.append((30 + k, words(rng, 9) + "  " + "".join(item).upper().replace(" ", "\n") + " " + words(rng, 5)))
        edits[30 + k] = k % 6
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    got = decontaminate.leaks(df, bench).collect()
    assert {r.doc_id: r.item_id for r in got} == edits and len(got) == 12
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {d for d, _ in rows} - set(edits)
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0 and decontaminate.leaks(none, bench).count() == 0
    assert len(decontaminate.item_blocks(bench, 3)) > 1 and sum(map(len, decontaminate.item_blocks(bench, 3))) == 7


def plain_leak(item, text):
    """Least edit distance of an item to any stretch of a text if within the budget, else None; for items that are not short."""
    item, text = (re.sub(r"\s+", " ", x or "").strip().lower() for x in (item, text))
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) if item and min(row) <= int(len(item) * decontaminate.RATE) else None


def test_leaks_of_every_pair_by_brute_force(spark):
    """Each document against each item: substitutions, insertions and deletions below, at and above the budget."""
    rng = random.Random(16)
    items = [words(rng, n) for n in (8, 10, 12, 16, 24)]
    assert min(map(len, items)) >= decontaminate.SHORT
    texts = [None, "", " \n"]
    for k in range(60):
        item = list(items[k % 5])
        for _ in range(rng.randint(0, 2 * decontaminate.budget(len(item)) + 1)):
            at = rng.randrange(len(item))
            item[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        texts.append(words(rng, rng.randint(0, 8)) + rng.choice(["", " ", "\n\t"]) + "".join(item) + rng.choice(["", " "]) + words(rng, rng.randint(0, 8)))
    texts += [items[0] + " " + items[3], items[1] * 2, items[4][:-1]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {(d, i): n for d, t in enumerate(texts) for i, item in enumerate(items) if (n := plain_leak(item, t)) is not None}
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(df, bench).collect()}
    assert got.keys() == want.keys() and len(want) > 25
    assert all(want[k] <= n <= decontaminate.budget(len(items[k[1]])) for k, n in got.items())
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_short_items_match_as_whole_words(spark):
    docs = spark.createDataFrame([(1, "a Tiny thing"), (2, "tinyness"), (3, "so tiny!"), (4, None), (5, "xx")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "tiny"), (8, " "), (9, "xx")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(1, 7), (3, 7), (5, 9)}


# 7 fingerprints


def test_fingerprints(spark, docs, texts, none):
    got = by_id(syncmers.fingerprints(docs.withColumn("anchors", F.lit(0))))
    order = sorted(got)
    shown = {}
    for at, i in enumerate(order):
        t, n = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert shown.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert syncmers.fingerprints(none).count() == 0


def test_successors_cross_groups(spark):
    rng = random.Random(8)
    keys = sorted({rng.randrange(1 << 40) for _ in range(200)} | {0, 1, 1 << 40})
    got = {r.k: r.next_key for r in syncmers.successors(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 42).collect()}
    assert got == dict(zip(keys, keys[1:] + keys[:1], strict=True))


@pytest.mark.parametrize("bits", [20, 43, 63])
def test_next_rows_of_sparse_ids(spark, bits):
    rng = random.Random(bits)
    ids = sorted({rng.randrange(-(1 << bits), 1 << bits) for _ in range(60)})
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    got = syncmers.fingerprints(df).collect()
    assert sorted(r.doc_id for r in got) == ids and all(r.edited_sha256 for r in got)
    nexts = {r.doc_id: r.next_text for r in syncmers.with_next(df, ["text"]).collect()}
    assert nexts == {i: f"text {j}" for i, j in zip(ids, ids[1:] + ids[:1], strict=True)}


def plain_anchors(text):
    return [x.split(":")[1] for x in (plain_fingerprint(text) if text.split() else "").split(",") if x]


def test_likeness_is_that_of_plain_syncmers(spark):
    rng = random.Random(16)
    texts = [words(rng, rng.randint(1, 90)) for _ in range(25)] + ["", None, "word"]
    texts += [texts[3] + " " + words(rng, 20), texts[4], texts[4]]
    got = by_id(syncmers.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    texts = [t or "" for t in texts]

    def likeness(a, b):
        x, y = set(plain_anchors(a)), set(plain_anchors(b))
        return len(x & y) / len(x | y) if x | y else 1.0

    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].fingerprint == plain_fingerprint(t) and got[i].edited_fingerprint == plain_fingerprint(edited), i
        assert got[i].near_edited == pytest.approx(likeness(t, edited)) and got[i].near_next == pytest.approx(likeness(t, after))


def test_shared_anchors_give_the_places(spark):
    rng = random.Random(17)
    shared = words(rng, 60)
    df = spark.createDataFrame([(words(rng, 5) + " " + shared, words(rng, 25) + " " + shared)], "x string, y string")
    df = syncmers.with_anchors(syncmers.with_anchors(df, "x", "a"), "y", "b")
    (row,) = df.select(syncmers.shared_anchors("a", "b").alias("m")).collect()
    assert len(row.m) >= 4 and {m.at_b - m.at_a for m in row.m} == {20}


def test_letters_of_scripts_without_spaces_are_words(spark):
    text = "".join(chr(0x4E00 + i) for i in range(80))
    (row,) = syncmers.with_anchors(spark.createDataFrame([(text,)], "t string"), "t", "a").collect()
    assert len(row.a) > 3


def test_anchors_do_not_depend_on_their_place(spark):
    rng = random.Random(9)
    shared = words(rng, 60)
    df = spark.createDataFrame([(0, words(rng, 10) + " " + shared), (1, words(rng, 33) + " " + shared + " " + words(rng, 4))], "doc_id long, text string")
    a, b = (set(x.split(":")[1] for x in r.f.split(",")) for r in syncmers.with_anchors(df, "text", "a").select(syncmers.as_text("a").alias("f")).collect())
    assert len(a & b) >= 5


def plain_fingerprint(text):
    """Closed syncmers of a text of syncmers.K words or more, else its least k-mer, by plain loops."""

    def chained(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little"), seed=seed)
        return seed

    hashes = [chained([w.encode()]) for w in text.split()]
    inner = [chained(hashes[i : i + syncmers.S]) for i in range(len(hashes) - syncmers.S + 1)]
    if not hashes:
        return ""
    if len(hashes) < syncmers.K:
        return f"0:{chained(hashes) & 0x7FFFFFFF:x}"
    signed = [h - (1 << 64) if h >> 63 else h for h in inner]
    n = syncmers.K - syncmers.S + 1
    kmers = [(chained(inner[i : i + n : syncmers.S]) & 0x7FFFFFFF, i) for i in range(len(inner) - n + 1)]
    chosen = [k for k in kmers if min(signed[k[1] : k[1] + n]) in (signed[k[1]], signed[k[1] + n - 1])]
    return ",".join(f"{i:x}:{h:x}" for h, i in chosen or [min(kmers)])


def test_texts_of_few_kmers_have_anchors(spark):
    rng = random.Random(31)
    rows = [(i, words(rng, 12 + i % 14)) for i in range(280)]
    got = {r.doc_id: r.f for r in syncmers.with_anchors(spark.createDataFrame(rows, "doc_id long, text string"), "text", "a").select("doc_id", syncmers.as_text("a").alias("f")).collect()}
    assert all(got.values())
    assert got == {i: plain_fingerprint(t) for i, t in rows}



# 8 lines


def test_within_is_edit_distance():
    rng = random.Random(10)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(2))
        for k in (1, 2, 3):
            assert linededup.within(a, b, k) == (edit_distance(a, b) <= k), (a, b, k)


def test_near_lines_share_a_key():
    rng = random.Random(11)
    for _ in range(2000):
        a = b = "".join(rng.choice("abcdé") for _ in range(rng.randint(26, 40)))
        for _ in range(2):
            i = rng.randrange(len(b) + 1)
            b = rng.choice((b[:i] + "x" + b[i:], b[:i] + b[i + 1 :], b[:i] + "y" + b[i + 1 :]))
        assert linededup.keys_of(a, 2) & linededup.keys_of(b, 2)


def blank(line):
    return not line.strip(" \t\n\x0b\f\r\xa0")


def plain_line_dedup(texts):
    lines = sorted({x for t in texts for x in (t or "").split("\n") if not blank(x)})
    of = {x: x for x in lines}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if min(len(a), len(b)) >= linededup.LEAST and abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2:
                of[root(a)] = root(b)
    seen, out = set(), []
    for t in texts:
        gone = []
        for p, x in enumerate((t or "").split("\n")):
            if not blank(x):
                if root(x) in seen:
                    gone.append(p)
                seen.add(root(x))
        out.append(gone)
    return out


def test_line_dedup(spark, docs, texts, none):
    want = plain_line_dedup(texts)
    got = by_id(linededup.digest(docs.withColumn("place", F.lit(0))))
    assert [list(got[i].removed) for i in range(len(texts))] == want and sum(map(len, want)) > 10
    kept = by_id(linededup.dedup(docs.withColumn("class", F.lit("x"))))
    for i, t in enumerate(texts):
        parts = [] if t is None else t.split("\n")
        left = [x for p, x in enumerate(parts) if p not in want[i]]
        assert (i in kept) == (not want[i] or not all(map(blank, left)))
        if i in kept:
            assert kept[i].text == (None if t is None else "\n".join(left))
    assert linededup.digest(none).count() == linededup.dedup(none).count() == 0


def test_rows_of_one_doc_id_are_documents_of_their_own(spark):
    same, alone = "the same line that both of them hold", "another first line that is unique"
    rows = [(1, f"{same}\nshort"), (2, f"{same}\nmore of two"), (2, f"{alone}\n{same}"), (3, "short\n \n"), (4, " \n\nxyz"), (None, same)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in linededup.dedup(df).where("doc_id is not null").collect())
    assert kept == [(1, f"{same}\nshort"), (2, alone), (2, "more of two"), (4, " \n\nxyz")]
    assert sorted((r.doc_id, r.n_removed) for r in linededup.digest(df).where("doc_id is not null").collect()) == [(1, 0), (2, 1), (2, 1), (3, 1), (4, 0)]
    texts = [words(random.Random(i), 40) for i in range(3)]
    rows = [(5, texts[0]), (5, texts[1]), (6, texts[1]), (7, texts[0]), (8, texts[2]), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.duplicates(df, 2).collect())
    assert got == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True), (9, 9, True), (9, 9, True)]
    assert sorted((r.doc_id, r.text or "") for r in minhash.one_of_each(df).collect()) == sorted([(5, texts[0]), (5, texts[1]), (8, texts[2]), (9, ""), (9, "")])
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffixdedup.digest(spark.createDataFrame([(1, "a" * 399), (1, words(random.Random(9), 200)), (1, words(random.Random(8), 200))], "doc_id long, text string")).collect())
    assert len(got) == 3 and all(r[2] == 0 for r in got)


def test_ids_beside_nulls_stay(spark):
    big = (1 << 53) + 1
    df = spark.createDataFrame([(None, "text one", "p", "s", 1), (big, "text two", "p", "s", big), (big + 2, "token=abcdefgh12", None, None, None)], DOCS).coalesce(1)
    want = {None, big, big + 2}
    sample = langid.labelled_sample(df)
    pages_ = df.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example/x").alias("url"), F.col("text").alias("html"))
    bench = spark.createDataFrame([(big, "text two")], "item_id long, text string")
    for got in (secrets.scan(df), langid.predict(df, sample), langid.accepted(df, sample), decontaminate.clean(df, bench.limit(0)), pieces.encode(df), pieces.decode(pieces.encode(df))):
        assert {r.doc_id for r in got.collect()} == want
    assert {r.n_chars for r in langid.accepted(df, sample).collect()} == {1, big, None}
    assert {r.page_id for r in htmltext.extract(pages_).collect()} == want
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()] == [(big, big)]
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {None, big + 2}
    assert {r.doc_id for r in sharding.shard(df, 4, 64).collect()} == want
    for got in (suffixdedup.digest(df), syncmers.fingerprints(df), minhash.duplicates(df, 2)):
        assert {r.doc_id for r in got.collect()} == {big, big + 2}
    assert {r.doc_id for r in linededup.digest(df).collect()} == {r.doc_id for r in minhash.one_of_each(df).collect()} == want


def test_empty_tables_and_very_long_texts(spark, none):
    assert secrets.scan(none).count() == langid.predict(none, []).count() == langid.accepted(none, []).count() == 0
    long = "token=" + "a1" * 20_000 + " " + " ".join(f"word{i}" for i in range(30_000)) + "\n" + "漢" * 30_000
    df = spark.createDataFrame([(1, long), (2, "x")], "doc_id long, text string")
    assert by_id(secrets.digest(secrets.scan(df)))[1].base_sha256 == hashlib.sha256(plain_base(long).encode()).hexdigest()
    assert by_id(langid.predict(df, [("l", "word")]))[1].lang_pred == "l"
    assert by_id(pieces.encode_digest(df))[1].round_trip
    assert by_id(linededup.digest(df))[1].n_lines == 2 and by_id(minhash.duplicates(df, 2))[1].n_shingles > 30_000
    assert by_id(suffixdedup.digest(df))[1].n_bytes == len(long.encode()) and by_id(syncmers.fingerprints(df))[1].n_chars == len(long)


# 9 pieces


def test_a_star_finds_the_n_best():
    v = pieces.vocabulary()

    def every(unit):
        edges, out = v.edges(unit), []

        def back(j, score):
            if j == 0:
                out.append(score)
            for i, s, _ in edges[j]:
                back(i, score + s)

        back(len(unit), 0)
        return sorted(out, reverse=True)

    rng = random.Random(12)
    units = [" there", " naïve", "   b", "x▁y\n", " 漢字𠮷", "\x00"] + ["".join(rng.choice(" theranéñ,.1") for _ in range(8)) for _ in range(40)]
    for u in units:
        best = every(u)
        assert [s for s, _ in v.n_best(u, 5)] == best[:5]
        score, loss, blobs = v.solve([u])
        assert score[0] == best[0] and loss[0] == (best[0] - best[1] if len(best) > 1 else -pieces.NONE)
        assert v._alone(u) == (score[0], loss[0], blobs[0])
    text = "the ab an"
    assert [s for s, _ in pieces.segment([text], v, 4)[0]] == every(" " + text)[:4]


def test_encoding_round_trips(spark, docs, texts, none):
    more = spark.createDataFrame([(900, "a▁b ▁"), (901, "z" * 3000 + " q"), (902, " \x07 \t")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more).withColumn("ids", F.lit(1))
    encoded = pieces.encode(every).cache()
    assert all(r.round_trip for r in encoded.collect())
    back = by_id(pieces.decode(encoded))
    assert all(back[i].text == (t or "") for i, t in enumerate(texts)) and back[900].text == "a▁b ▁"
    for r in encoded.collect():
        assert list(r.scores) == sorted(r.scores, reverse=True) and len({tuple(x) for x in r.ids}) == len(r.ids)
    assert pieces.encode(none).count() == 0


# 10 near duplicates


def plain_components(texts, n):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    of = list(range(len(texts)))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                of[y] = x
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, docs, texts, none, n):
    want, sizes = plain_components(texts, n)
    got = by_id(minhash.duplicates(docs.withColumn("id", F.lit(0)).unionByName(docs.withColumn("id", F.lit(0)).limit(3)), n))
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert minhash.duplicates(none, n).count() == 0


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", 7)
    rng = random.Random(13)
    base = words(rng, 60).split(" ")
    texts = []
    for _ in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(60)] = words(rng, 1)
        texts.append(" ".join(w))
    want, _ = plain_components(texts, 2)
    got = by_id(minhash.duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2))
    assert [got[i].component_id for i in range(80)] == want and len(set(want)) > 1


def test_pruning_keeps_true_pairs():
    rng = random.Random(14)
    least = minhash.least_matches()
    for _ in range(30):
        a = {rng.getrandbits(63) for _ in range(200)}
        b = set(list(a)[:180]) | {rng.getrandbits(63) for _ in range(20)}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        same = minhash.signature(x) == minhash.signature(y)
        assert all(same[:n].sum() >= least[n] for n in range(minhash.BATCH, 241, minhash.BATCH))


@pytest.mark.parametrize("last", [200_000, 40])
def test_components_of_paths_and_stars(spark, monkeypatch, last):
    monkeypatch.setattr(components, "LAST_LINKS", last)
    links = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_chain_and_a_forest(spark, monkeypatch):
    monkeypatch.setattr(components, "LAST_LINKS", 20)
    rng = random.Random(15)
    ids = [rng.randrange(1 << 62) - (1 << 61) for _ in range(3000)]
    links = list(zip(ids[:1000], ids[1:1001], strict=True)) + [(ids[i], ids[rng.randrange(1001, i)]) for i in range(1002, 3000) if rng.random() < 0.9]
    of = {x: x for e in links for x in e}

    def root(x):
        while of[x] != x:
            of[x] = x = of[of[x]]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        of[high] = low
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in of}

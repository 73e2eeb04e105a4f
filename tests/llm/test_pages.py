"""Page differencing against a plain search for neighbours."""

import random
from urllib.parse import urlsplit

import pytest

from medlake.llm import htmltext as h

SCHEMA = "page_id long, url string, html string"
SF_DIR = "/root/testdata/sf0.001"


def place_of(url):
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path.rstrip("/")
    except ValueError:
        return "", ""


def shared_prefix(a, b):
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def plain_nearest(urls):
    """(page_id, mate_id) -> place, of {page_id: url}."""
    rows = sorted((*place_of(u), i) for i, u in urls.items())
    out = {}
    for k, (host, path, i) in enumerate(rows):
        for by in range(1, h.REACH + 1):
            for side, j in enumerate((k - by, k + by)):
                if 0 <= j < len(rows) and rows[j][0] == host:
                    out[i, rows[j][2]] = (1 << 20) - shared_prefix(rows[j][1], path) * 16 + 2 * by + side
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_neighbours_of_whole_hosts(spark, n):
    rng = random.Random(n)
    urls = {i: f"https://h{min(rng.randrange(9), 2)}.org/" + "/".join(rng.choice("abcd") for _ in range(rng.randrange(4))) + rng.choice(["", "/", "?q=1", "/page-%d" % i]) for i in range(n)}
    df = spark.createDataFrame([(i, u, "") for i, u in urls.items()], SCHEMA).repartition(5)
    got = {(r.page_id, r.mate_id): r.place for r in h.nearest(df).collect()}
    assert got == plain_nearest(urls)


def test_pages_in_folders_of_their_own_lose_what_they_share(spark):
    rows = [(i, f"https://x.org/f{i}/p", f"<body><p>Shared line of the site</p><p>Own words of page number {i}</p><p>More of {i}, only here</p><p>Last shared words</p></body>") for i in range(8)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == {i: f"Own words of page number {i}\nMore of {i}, only here" for i in range(8)}


def test_every_page_of_the_tables_agrees_with_a_plain_differ(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    near = plain_nearest({r.page_id: r.url for r in pages})
    hashes = {r.page_id: [h.line_hash(t) for t, _ in h.blocks(r.html or "")] for r in pages}
    want = {}
    for r in pages:
        mates = sorted((place, hashes[m]) for (i, m), place in near.items() if i == r.page_id)
        want[r.page_id] = "\n".join(h.without_shared(h.blocks(r.html or ""), [m for _, m in mates]))
    got = {r.page_id: (r.text, r.n_chars) for r in h.extract(spark.read.parquet(f"{SF_DIR}/pages.parquet")).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()} and len(got) == len(pages)


def test_no_pages_long_pages_and_clashing_columns(spark):
    assert h.extract(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "".join(f"<p>paragraph {k} of a very long page</p>" for k in range(40_000))
    df = spark.createDataFrame([(1, "https://x.org/a", long, 1), (2, "https://x.org/b", long.replace("very", "quite"), 2), (3, None, None, 3)], SCHEMA + ", part long")
    got = {r.page_id: r.n_chars for r in h.extract(df.withColumnRenamed("part", "mates")).collect()}
    assert got[1] == len("\n".join(f"paragraph {k} of a very long page" for k in range(40_000))) and got[3] == 0

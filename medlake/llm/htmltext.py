"""Main text of web pages: markup zones, then nearest-URL page differencing.

A page is cut into text blocks.  Blocks in navigation, headers, footers, sidebars,
adverts, notices, forms and comments, as elements or class names declare them, go.
Each page is then paired with the page of its host whose path stands nearest, the
blocks of both are aligned by longest common subsequence, and shared blocks are
deleted, inside declared articles too: site furniture repeats, prose does not.  A page
that shares COPY of the blocks of either is a near copy, whose shared blocks tell
nothing; the next nearest takes its place, and a page with near copies only stays whole.

Nulls: null html is empty text; a null or unreadable url has the empty host and path; a
null page_id has no neighbour.  Repeated rows give repeated results; an empty table
none.  Of several pages with one page_id each has its own text, and their least list of
blocks stands for all as a neighbour.  Further columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.llm.common import arrow_batches, mapped, written

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.DOTALL)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
SPACE = re.compile(r"\s+")
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
DROPPED = {"nav", "header", "footer", "aside", "form", "head", "menu", "button", "select", "dialog", "object", "canvas", "video", "audio", *RAW}
MAIN = {"article", "main"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Within a declared article, names decide on containers only, and only those of zones that stand inside articles too.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "fieldset", "details", "figure", "center"}
INSIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|notices?|cookies?|consent|comments?|replies|respond|subscribe|newsletter|signup|share|sharing|"
    r"related|sidebar|popup|modal)(?=$|[\s_-])",
    re.IGNORECASE,
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Class names and ids of zones that are none of a page's text.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|masthead|"
    r"notices?|cookies?|consent|comments?|replies|respond|subscribe|newsletter|signup|share|sharing|social|related|popup|modal|toolbar|pager|pagination)(?=$|[\s_-])",
    re.IGNORECASE,
)


def blocks(page: str) -> list[tuple[str, bool]]:
    """(text, declared main) of the blocks left after markup zones are dropped, in page order."""
    out: list[tuple[str, bool]] = []
    buffer: list[str] = []
    main = 0
    skip, depth = "", 0
    at = 0

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            out.append((text, main > 0))

    scan = TOKEN.finditer(page)
    resume = 0
    for m in scan:
        if m.start() < resume:
            continue
        if not skip:
            buffer.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if skip:
            if tag in MAIN and not closing and skip not in MAIN:
                skip = ""  # what was dropped had no end
            else:
                if tag == skip:
                    depth += -1 if closing else 0 if m[3].endswith("/") else 1
                    if depth == 0:
                        skip = ""
                continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            buffer.append(" ")
        if tag in MAIN:
            main = max(0, main + (-1 if closing else 1))
        elif not closing and tag not in VOID and not m[3].endswith("/"):
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = resume = end.end() if end else len(page)
                continue
            own_header = tag == "header" and main  # the head of an article belongs to it
            names = None if tag in ("html", "body") else FURNITURE if not main else INSIDE if tag in CONTAINERS else None
            if (tag in DROPPED and not own_header) or (names and any(names.search(a or b or c) for a, b, c in NAMES.findall(m[3]))):
                skip, depth = tag, 1
    if not skip:
        buffer.append(page[at:])
    flush()
    return out


def line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in a of one longest common subsequence with b, by the thresholds of Hunt and Szymanski."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    ends: list[int] = []
    tails: list[tuple | None] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, tails[k - 1] if k else None)
            if k == len(ends):
                ends.append(j), tails.append(link)
            else:
                ends[k], tails[k] = j, link
    out, node = [], tails[-1] if tails else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


#: Two pages are near copies from this share of shared blocks on, of the one that has fewer.
COPY = 0.8


def without_shared(own: list[tuple[str, bool]], mates: list[list[int]]) -> list[str]:
    """The block texts without those that the first of the mates, nearest first, that is no near copy shares."""
    texts = [t for t, _ in own]
    hashes = [line_hash(t) for t in texts]
    for mate in mates:
        shared = set(common(hashes, list(mate)))
        if len(mate) and len(shared) < COPY * min(len(hashes), len(mate)):
            return [t for i, t in enumerate(texts) if i not in shared]
    return texts


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def _path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


#: Pages before and after a page, by path within the host, that are candidates for its mate.
REACH = 2


def _with_guests(rows: DataFrame) -> DataFrame:
    """Rows in range partitions by host, path and page_id, each with the REACH rows before and after it as guests: part, at (the order) and guest.

    The edges of all partitions, a few rows each, are ordered by themselves; no group of rows stands in one task.
    """
    by = ["host", "path", "page_id"]
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*by, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "placed")
    up, down = Window.partitionBy("part").orderBy("at"), Window.partitionBy("part").orderBy(F.desc("at"))
    edges = placed.withColumns({"nth": F.row_number().over(up), "last": F.row_number().over(down)}).where((F.col("nth") <= REACH) | (F.col("last") <= REACH))
    whole, sides = Window.orderBy("at"), []
    for nth, f in (("nth", F.lag), ("last", F.lead)):
        row = F.struct(*by, "at")
        beyond = edges.withColumns({f"g{k}": f(row, k).over(whole) for k in range(1, REACH + 1)}).where(F.col(nth) == 1)
        sides.append(beyond.select("part", F.explode(F.array_compact(F.array(*(f"g{k}" for k in range(1, REACH + 1))))).alias("g")).select("g.host", "g.path", "g.page_id", "part", "g.at"))
    guests = sides[0].unionByName(sides[1])
    return placed.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))


def nearest(pages: DataFrame) -> DataFrame:
    """page_id, mate_id and place: the pages before and after it by path within the host, least place for who shares most of the path.

    Only ids and urls take part.  Every page of a host with other pages has a mate.
    """
    rows = pages.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.min("url").alias("url"))
    rows = _with_guests(rows.select("page_id", _host(F.col("url")).alias("host"), F.regexp_replace(_path(F.col("url")), "/+$", "").alias("path")))
    w = Window.partitionBy("part").orderBy("at")
    at = [(f, by, 2 * by + side) for by in range(1, REACH + 1) for side, f in enumerate((F.lag, F.lead))]
    sides = rows.withColumns({f"{c}_{n}": f(c, by).over(w) for f, by, n in at for c in ("page_id", "path", "host")}).where("not guest")
    mates = [
        F.when(F.col(f"host_{n}") == F.col("host"), F.struct((F.lit(1 << 20) - _shared_prefix(f"path_{n}", "path") * 16 + n).alias("place"), F.col(f"page_id_{n}").alias("mate_id")))
        for _, _, n in at
    ]
    return sides.select("page_id", F.inline(F.array_compact(F.array(*mates)))).groupBy("page_id", "mate_id").agg(F.min("place").alias("place"))


def _shared_prefix(a: str, b: str) -> Column:
    """Shared leading parts of two paths; -1 where one is missing."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(F.slice(x, 1, F.least(F.size(x), F.size(y))), F.slice(y, 1, F.least(F.size(x), F.size(y))), lambda p, q: (p == q).cast("int"))
    at = F.array_position(same, F.lit(0))
    return F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit(-1)).otherwise(F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int"))


def block_hashes(pages: DataFrame) -> DataFrame:
    """page_id and the hashes of its blocks, for pages that have any."""

    def run(batches):
        for batch in batches:
            hashes = [np.array([line_hash(t) for t, _ in blocks(p)], np.int64) for p in batch["html"]]
            yield pd.DataFrame({"mate_id": batch["page_id"], "mate": hashes})

    rows = pages.where(F.col("page_id").isNotNull()).select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    # of several pages with one id the least list of hashes is the mate of others
    return rows.mapInPandas(run, "mate_id long, mate array<long>").groupBy("mate_id").agg(F.min("mate").alias("mate"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    arrow_batches(pages.sparkSession)
    mates = nearest(pages).join(block_hashes(pages), "mate_id")
    mates = mates.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", "mate"))).alias("mates")).select("page_id", F.col("mates.mate").alias("mates"))
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("__html"))

    def work(texts, mates):
        found = ["\n".join(without_shared(blocks(p), m or ())) for p, m in zip(texts, mates, strict=True)]
        return {"text": found, "n_chars": [len(t) for t in found]}

    rows = own.join(mates.withColumnRenamed("mates", "__mates"), "page_id", "left")
    return mapped(rows, ["page_id", "url"], ["__html", "__mates"], lambda: work, {"text": "string", "n_chars": "long"})

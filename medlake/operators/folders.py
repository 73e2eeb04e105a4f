"""Folder trees of any depth: paths, and plans that repair them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.operators.relations import _cut
from medlake.session import FEW, PART_BYTES, PART_ROWS, dealt

MONTH = "^\\d{4}-\\d{2}$"
#: Bytes of ways that may be broadcast once they were counted.
FEW_BYTES = 16 << 20


def _kept(df: DataFrame, rows: int, size: int = 0) -> DataFrame:
    """df as a table written by as many tasks as its counted rows and bytes, and the cores, need: each takes several partitions, one after the other."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return _cut(df.coalesce(max(3 * cores, -(-rows // PART_ROWS), -(-size // PART_BYTES))))


def _often(key: str) -> Column:
    """The keys that stand most often, with estimated counts: they decide how rows are joined, not what comes out."""
    return F.expr(f"approx_top_k({key}, 1000, 10000)")


def _hot(top: list | None) -> list:
    return [x["item"] for x in top or [] if x["item"] is not None and x["count"] > PART_ROWS]


def _met(left: DataFrame, right: DataFrame, key: str, rows: int, hot: list, how: str = "inner", size: int = 0) -> DataFrame:
    """left joined with right, which has a row a key; rows of hot keys and of none stay where they are, the others are dealt by key."""
    if not hot and how == "inner":
        return dealt(left, rows, key, size=size).join(dealt(right, rows, key, size=size), key)
    here = F.col(key).isNull() | F.col(key).isin(hot)
    apart = dealt(left.where(~here), rows, key, size=size).join(dealt(right, rows, key, size=size), key, how)
    return apart.unionByName(left.where(here).join(F.broadcast(right.where(F.col(key).isin(hot))), key, how))


def _ways(folders: DataFrame, own: Column, joined: Callable[[str, str], Column], size_of: Column) -> DataFrame:
    """id, way and depth of the folders below a root: way is what joined() makes of the ways above and below, from own of each folder on; size_of, its bytes.

    Each round joins a folder with the folder that its way has reached so far, which doubles the way, so rounds grow
    with the logarithm of the depth.  Folders that have reached a root are not joined again, and a few that have not
    go to the others.  How a way is put together is the same for folders of equal depth.
    """
    way = _cut(folders.select("id", F.col("parent").alias("up"), own.alias("way"), F.lit(0).alias("depth")))
    done, rows, size = [], 0, 0
    while True:
        open_ = F.col("up").isNotNull()
        n, left, long, top = way.agg(F.count(F.lit(1)), F.count_if(open_), F.struct(F.coalesce(F.sum(size_of), F.lit(0)), F.coalesce(F.sum(F.when(open_, size_of)), F.lit(0))), _often("up")).first()
        if not done:
            rows = n
        elif left == n:  # depths have no gaps: if no folder of the next ones has reached a root, none will
            break
        size += long[0]
        done.append(way.where("up is null"))
        if not left:
            break
        way = way.where("up is not null")
        above = reduce(DataFrame.unionByName, [*done, way]).select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("way").alias("head"), F.col("depth").alias("more"))
        few = left <= FEW and long[1] <= FEW_BYTES
        longer = above.join(F.broadcast(way), "up") if few else _met(way, above, "up", rows, _hot(top), size=size)
        way = _kept(longer.select("id", F.col("next").alias("up"), joined("head", "way").alias("way"), (F.col("depth") + F.col("more") + 1).alias("depth")), left, size)
    return reduce(DataFrame.unionByName, done).select("id", "way", "depth")


def paths(folders: DataFrame, separator: str = "/") -> DataFrame:
    """Folders (id, parent, name) with path and depth from a root, whose parent is null.

    Folders whose parents lead to no root, in cycles among them, have no row.
    """
    return _ways(folders, F.col("name"), lambda head, way: F.concat_ws(separator, head, way), F.octet_length("way")).withColumnRenamed("way", "path")


def _digest(*parts: Column) -> Column:
    return F.struct(*(F.xxhash64(F.lit(seed), *parts).alias(half) for half, seed in (("high", 1), ("low", 2))))


def merges(folders: DataFrame) -> DataFrame:
    """Twin folders and the one that each is merged into, as rows id, keeper.

    Folders are twins if they have the same parent, or parents that are merged, and names that agree but for case.
    That is so exactly if their whole paths agree, so that no level waits for the one above.  The keeper is the
    twin with most children of its own, of equals the one of least id.  Paths are told by 128 bits: a way is the
    digest of the digests of its halves.
    """
    return _merges(_cut(folders))


def _merges(folders: DataFrame) -> DataFrame:
    """merges() of written folders."""
    n = folders.count()
    halves = [F.col(f"{side}.{half}") for side in ("head", "way") for half in ("high", "low")]
    ways = _ways(folders, _digest(F.lit("name"), F.lower("name")), lambda head, way: _digest(F.lit("halves"), *halves), F.lit(16))
    own = folders.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    rows = _kept(dealt(ways.select("id", "way.high", "way.low"), n, "id").join(own, "id", "left").fillna(0, ["children"]), n)
    keeper = F.first("id").over(Window.partitionBy("high", "low").orderBy(F.desc("children"), "id"))
    return dealt(rows, n, "high", "low").select("id", keeper.alias("keeper")).where("id <> keeper")


def repair_plan(folders: DataFrame, items: DataFrame, categories: list[str], other: str = "other") -> DataFrame:
    """Moves that mend a tree, as rows op, id, target, in three kinds; nothing is changed.

    merge: a twin goes into its keeper, with reparent for each of its children (folders and items of items (id, parent))
    and trash for itself.  nested: what lies in a month folder below a month folder moves up, and the inner one is
    trashed.  category: a month folder below what is no category moves below `other`, if the root has such a folder;
    else its target is null.  Items outside the tree (parent unknown) are consolidated below the root of least id.

    A twin is no nested folder, so that a child moves for one reason at most, and each child meets its parent once.
    """
    folders = _cut(folders)
    n, top = folders.agg(F.count(F.lit(1)), _often("parent")).first()
    n_items, top_items = items.agg(F.count(F.lit(1)), _often("parent")).first()
    twins = _kept(_merges(folders), n)
    name, month = F.col("name"), F.col("name").rlike(MONTH)
    marked = dealt(folders, n, "id").join(dealt(twins, n, "id"), "id", "left")
    marked = _kept(marked.select("id", "parent", "keeper", month.alias("month"), (~month & ~name.isin(categories)).alias("astray"), (name == other).alias("other")), n)
    kept = marked.where("keeper is null")
    up = marked.where("month or astray").select(F.col("id").alias("parent"), F.col("month").alias("inner"))
    placed = _kept(_met(kept.where("month").select("id", "parent"), up, "parent", n, _hot(top)), n)
    nested = placed.where("inner").select("id", F.col("parent").alias("above"))

    children = kept.select("id", "parent", F.lit(False).alias("item")).unionByName(items.select("id", "parent", F.lit(True).alias("item")))  # a twin goes by its own merge
    rows = n + n_items
    known = dealt(marked.select("id", "keeper"), rows, "id").join(dealt(nested, rows, "id"), "id", "left").select(F.col("id").alias("parent"), "keeper", "above", F.lit(True).alias("known"))
    target = F.coalesce("keeper", "above")
    hot = list({*_hot(top), *_hot(top_items)})
    led = _met(children, known, "parent", rows, hot, "left").select("id", F.when(F.col("keeper").isNotNull(), "reparent").when(F.col("above").isNotNull(), "raise").when(F.col("item") & F.col("known").isNull(), "consolidate").alias("op"), target.alias("target"))
    led = _kept(led.where("op is not null"), rows)
    least, most = twins.agg(F.min("id"), F.max("id")).first()
    maybe = F.coalesce((F.col("op") != "consolidate") & F.col("id").between(least, most), F.lit(False))  # only these may have the id of a twin
    led = led.where(~maybe).unionByName(dealt(led.where(maybe), rows, "id").join(dealt(twins.select("id"), rows, "id"), "id", "left_anti"))
    roots = marked.where("parent is null").select(F.col("id").alias("root"))
    led = led.join(F.broadcast(roots.agg(F.min("root").alias("root"))), F.lit(True))  # one row
    led = led.select("op", "id", F.when(F.col("op") == "consolidate", F.col("root")).otherwise(F.col("target")).alias("target"))

    merged = twins.select(F.lit("merge").alias("op"), "id", F.col("keeper").alias("target")).unionByName(twins.select(F.lit("trash").alias("op"), "id", F.lit(None).cast("long").alias("target")))
    emptied = nested.select(F.lit("trash_nested").alias("op"), "id", F.lit(None).cast("long").alias("target"))
    places = kept.where("other").join(roots, F.col("parent") == F.col("root"), "left_semi").agg(F.min("id").alias("target"))
    strays = placed.where("not inner").select("id").join(F.broadcast(places), F.lit(True))  # one row
    return merged.unionByName(led).unionByName(emptied).unionByName(strays.select(F.lit("category").alias("op"), "id", "target"))


def merged_tree(folders: DataFrame) -> DataFrame:
    """The folders that are left after merges(), under their new parents."""
    twins = merges(folders)
    to = twins.select(F.col("id").alias("parent"), "keeper")
    left = folders.join(twins.select("id"), "id", "left_anti")
    return left.join(to, "parent", "left").select("id", F.coalesce("keeper", "parent").alias("parent"), "name")

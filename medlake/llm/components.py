"""Groups of rows that share buckets: candidate pairs, their links, and connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import checkpoint


#: Links left at or under this number are joined up in one task; more go through another round.
LAST_LINKS = 200_000


def _roots_at_once(links: DataFrame) -> DataFrame:
    """id and root of the ids of a bounded number of links, by union and find in one task."""

    def run(batches):
        of: dict[int, int] = {}

        def root(x: int) -> int:
            while of.setdefault(x, x) != x:
                of[x] = x = of[of[x]]
            return x

        for batch in batches:
            for x, y in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                low, high = sorted((root(x), root(y)))
                of[high] = low
        ids = list(of)
        yield pd.DataFrame({"id": np.array(ids, np.int64), "root": np.array([root(x) for x in ids], np.int64)})

    return links.select("a", "b").repartition(1).mapInPandas(run, "id long, root long")


def _hung(links: DataFrame, salt: int) -> DataFrame:
    """id and root: each node hangs under the neighbour of least hash, if that is less than its own, and then under the top of its tree.

    The hash changes from round to round, so that half of the nodes or more hang under another on average, whatever
    the shape of the links; trees are shallow, and jumping to the parent's parent halves their depth.
    """

    def rank(c: str) -> Column:
        return F.struct(F.xxhash64(c, F.lit(salt)).alias("hash"), F.col(c).alias("node"))

    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("id")).agg(F.min(rank("b")).alias("least"))
    up = checkpoint(least.select("id", F.least(rank("id"), "least")["node"].alias("root")))
    while True:
        above = up.where("id <> root").select(F.col("id").alias("root"), F.col("root").alias("top"))
        higher = checkpoint(up.join(above, "root", "left").select("id", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        up = higher.select("id", "root")
        if higher.where("moved").isEmpty():
            return up


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of each id in the links (a, b); ids without links have no row.

    Rounds contract the links: every node takes the root that it hangs under, and links inside a tree vanish.  A round
    halves the nodes on average, so rounds grow with the logarithm of their number, in chains too, and each is written
    to the checkpoint folder.  Joins and aggregates are by node; no task holds a component.
    """
    links = checkpoint(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, salt = None, 0
    while (n := links.count()) or labels is None:
        roots = _roots_at_once(links) if n <= LAST_LINKS else _hung(links, salt)
        if labels is None:
            labels = roots
        else:
            labels = labels.join(roots.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
        labels = checkpoint(labels)
        if n <= LAST_LINKS:
            break
        up_a, up_b = (roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        ends = links.join(up_a, "a").join(up_b, "b").where("ra <> rb")
        links, salt = checkpoint(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()), salt + 1
    least = labels.groupBy("root").agg(F.min("id").alias("component"))
    return checkpoint(labels.join(least, "root").select("id", "component"))


def shared_members(pairs: DataFrame) -> DataFrame:
    """The distinct (key, id) of keys with two ids or more.

    One shuffle by key; each task reads its sorted rows as a stream and keeps the last one in mind.
    """

    def run(batches):
        key = first = None  # the key read last; its only id so far, or None once it was shown to be shared
        last = None
        for batch in batches:
            k, i = batch["key"].to_numpy(), batch["id"].to_numpy()
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
            new[0] = k[0] != key or i[0] != last
            key_was, k_end, i_end = key, k[-1], i[-1]
            k, i = k[new], i[new]
            if len(k):
                held = first is not None and k[0] == key_was
                if held:
                    k, i = np.concatenate([[key_was], k]), np.concatenate([[first], i])
                begins = np.ones(len(k), bool)
                begins[1:] = k[1:] != k[:-1]
                group = np.cumsum(begins) - 1
                size = np.bincount(group)
                goes_on = not held and first is None and k[0] == key_was
                shared = size >= 2
                if goes_on:
                    shared[0] = True
                out = shared[group]
                first = None if shared[-1] else i[-1]
                if out.any():
                    yield pd.DataFrame({"key": k[out], "id": i[out]})
            key, last = k_end, i_end

    return pairs.repartition("key").sortWithinPartitions("key", "id").mapInPandas(run, "key long, id long")


#: Members of a key that stand in one block; ids of other components pass by every block of their key.
BLOCK = 1000

#: Takes the payloads of a block's members; gives what tells, of one payload, which of them it links to.
Prepare = Callable[[list[bytes]], Callable[[bytes], np.ndarray]]


def meet(rows: DataFrame, payload: DataFrame, prepare: Prepare) -> DataFrame:
    """Links (a, b) between ids of the same key that lie in different components.

    rows: (key, id, of).  The members of a key stand in blocks of bounded size, and those
    outside its largest component pass by each block as a stream, so no task holds a key
    and no pair leaves a task unless it is a link.
    """
    by = rows.groupBy("key", "of").agg(F.count(F.lit(1)).alias("n"))
    keys = by.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "of")).alias("largest"))
    keys = keys.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.col("largest.of").alias("largest"))
    placed = rows.join(keys, "key").join(payload, "id")
    members = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("passing", F.lit(0))
    passing = placed.where("of <> largest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("passing", F.lit(1))
    both = members.unionByName(passing).select("key", "block", "passing", "id", "of", "largest", "data")

    def run(batches):
        here, ids, ofs, data, test, largest = None, [], [], [], None, None
        for batch in batches:
            a, b = [], []
            for key, block, late, i, of, major, d in zip(*(batch[c] for c in batch.columns), strict=True):
                if (key, block) != here:
                    here, ids, ofs, data, test, largest = (key, block), [], [], [], None, major
                if not late:
                    ids.append(i), ofs.append(of), data.append(d)
                    continue
                if not len(ids):
                    continue
                if test is None:
                    test, ids, ofs = prepare(data), np.array(ids), np.array(ofs)
                # two that both pass by meet twice; once is enough
                for j in np.flatnonzero(test(d) & (ofs != of) & ((ofs == largest) | (ids < i))):
                    a.append(min(i, ids[j])), b.append(max(i, ids[j]))
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    dealt = both.repartition("key", "block").sortWithinPartitions("key", "block", "passing", "id")
    return dealt.mapInPandas(run, "a long, b long").distinct()


def grouped(
    pairs: DataFrame, linked: Callable[[DataFrame], DataFrame], payload: Callable[[DataFrame], DataFrame], prepare: Prepare
) -> DataFrame:
    """id and component of all ids that a link joins to another.

    pairs: (key, id), ids of a key being candidates of each other.  linked keeps the true
    links of candidate pairs (a, b); payload and prepare serve meet().  First every id is
    compared with the most central id of its keys, then members of other components with
    the centres, and last all ids of a centre that still lie in different components.
    Pairs inside a component could not change it.
    """
    members = checkpoint(shared_members(pairs))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    weight = members.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("weight"))
    heaviest = F.max(F.struct("weight", (-F.col("id")).alias("less"))).alias("c")
    centres = members.join(weight, "id").groupBy("key").agg(heaviest).select("key", "c.weight", (-F.col("c.less")).alias("centre"))
    # ids that share a key share its centre, itself among them
    spokes = checkpoint(members.join(centres, "key").groupBy("id", "centre").agg(F.max("weight").alias("weight")))
    rays = spokes.where("id <> centre")

    def ordered(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    best = F.max_by("centre", F.struct("weight", (-F.col("centre")).alias("less"))).alias("centre")
    tested = checkpoint(rays.groupBy("id").agg(best).select(*ordered("id", "centre")).distinct())
    found = checkpoint(linked(tested))
    labels = components(found)

    def label(df: DataFrame, column: str, to: str) -> DataFrame:
        known = labels.select(F.col("id").alias(column), F.col("component").alias(to))
        return df.join(known, column, "left").withColumn(to, F.coalesce(to, column))

    apart = label(label(rays, "id", "of"), "centre", "to").where("of <> to").select(*ordered("id", "centre")).distinct()
    apart = checkpoint(apart.join(tested, ["a", "b"], "left_anti"))
    if not apart.isEmpty():
        more = checkpoint(linked(apart))
        if not more.isEmpty():
            found = checkpoint(found.unionByName(more))
            labels = components(found)
    rows = label(spokes.select(F.col("centre").alias("key"), "id"), "id", "of")
    mixed = rows.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.count(F.lit(1)).alias("n"))
    # a key of two ids was decided with its centre
    rows = checkpoint(rows.join(mixed.where("low <> high and n > 2").select("key"), "key", "left_semi"))
    if not rows.isEmpty():
        more = checkpoint(meet(rows, payload(checkpoint(rows.select("id").distinct())), prepare))
        if not more.isEmpty():
            labels = components(found.unionByName(more))
    return labels

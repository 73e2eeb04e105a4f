"""Prefix tries of conversations as succinct level-order tries.

Conversations are rebuilt first: the leading turns that a hundred of them share come from
the first of the hundred, the rest are a conversation's own.  A node is a distinct sequence
of turns (role, text) from the root on, told by a 128-bit hash.

1. Positions of turns and hashes of prefixes are running counts and sums; they run over
   range partitions, whose totals are carried on, so a conversation may be of any length
2. conversations with equal turns count as one, with their number
3. nodes below which SHARD nodes or fewer may lie, under a parent below which there may be
   more, are the roots of tries; tries are dealt to shards of bounded size.  A task builds
   its shard's level-order bit vector and labels (louds), reads parents and children out
   of the bits, and adds up subtrees from the last level to the first
4. the heavy nodes above are merged by themselves: what hangs under each is summed, and
   running sums along one conversation through each give their subtrees

Order of turns: by turn, nulls first, then role and text; a null role or text is empty.
Repeated rows are turns of their own.  A null conv_id is passed over.  An empty table gives
an empty result, without a root.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.llm.common import broadcast_if_small, whole_text, written

#: Nodes to a shard, and the most that may lie below the root of a trie of its own.
SHARD = 20_000
#: Conversations that share leading turns, and how many turns these are at most, plus one.
HUNDRED, SHARED = 100, 6
KEY = ["depth", "k1", "k2"]
#: Bytes of joined ids that are handed on as one.
CHUNK = 1 << 20


def running(rows: DataFrame, group: str, order: list[Column], keep: list[str | Column], sums: dict[str, tuple[str, object]]) -> DataFrame:
    """rows (group and `keep`) with running values: {name: (column, aggregate)}, up to and with each row of its group in the order given.

    Rows are sorted into range partitions; a group that goes on in the next partition takes its totals along.
    """
    by = [F.col(group), *order]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = written(sorted_rows.select(group, *keep, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), "sorted")
    inside = Window.partitionBy("__part", group).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy(group, "__part").agg(*(f(c).alias(f"__{n}") for n, (c, f) in sums.items()))
    over = totals.withColumn("__parts", F.count(F.lit(1)).over(Window.partitionBy(group))).where("__parts > 1")
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = written(over.select(group, "__part", *((F.sum if f is F.count else f)(f"__{n}").over(before).alias(f"__{n}") for n, (_, f) in sums.items())), "carried")
    local = placed.select("*", *(f(c).over(inside).alias(n) for n, (c, f) in sums.items()))
    # two groups a partition go over its edges at most
    local = local.join(broadcast_if_small(carried, carried.count()), [group, "__part"], "left")
    both = {n: F.col(n).bitwiseXOR(F.coalesce(f"__{n}", F.lit(0))) if f is F.bit_xor else F.col(n) + F.coalesce(f"__{n}", F.lit(0)) for n, (c, f) in sums.items()}
    return local.withColumns(both).drop("__part", "__at", *(f"__{n}" for n in sums))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, e1, e2, chars) of all rebuilt conversations, and conversations (conv_id, length), turnless ones included."""
    text, role = whole_text(), whole_text("role")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    labels = [F.xxhash64(F.lit(k), "role", "text").alias(f"l{k}") for k in (1, 2)]
    keep = [*labels, F.length("text").cast("long").alias("chars")]
    turns = written(running(rows, "conv_id", [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], keep, {"pos": ("conv_id", F.count)}), "turns")
    base, h = F.col("conv_id") - F.col("conv_id") % HUNDRED, F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", base.alias("base"), h.alias("h"))
    shared = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = own.join(shared, "base", "left").withColumn("from_base", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "from_base", (F.col("from_base") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    n_convs = convs.count()
    heads = turns.where((F.col("pos") < SHARED) & (F.col("conv_id") % HUNDRED == 0)).select(F.col("conv_id").alias("base"), "l1", "l2", "chars", "pos")
    led = convs.join(heads, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "l1", "l2", "chars")
    # a conversation may hold a large part of all turns: this join splits its rows, as its other side has one row a conversation
    rest = turns.join(broadcast_if_small(convs.select("conv_id", "h", "from_base"), n_convs), "conv_id").where("pos > h")
    rest = rest.select("conv_id", (F.col("from_base") + F.col("pos") - F.col("h")).alias("depth"), "l1", "l2", "chars")
    both = led.unionByName(rest)
    return both.select("conv_id", "depth", *(F.xxhash64(F.lit(k), "depth", "l1", "l2").alias(f"e{k}") for k in (1, 2)), "chars"), convs.select("conv_id", "length")


class Louds:
    """A level-order trie over a root that stands for what lies above it.

    bits: for each node in level order, a one for each child and a zero.  labels: of each node but the root.
    """

    def __init__(self, bits: np.ndarray, labels: np.ndarray):
        self.bits, self.labels = bits, labels
        ones, zeros = np.flatnonzero(bits), np.flatnonzero(~bits)
        # child j + 1 is the j-th one; the zeros before it are the nodes that were closed
        self.parent = np.concatenate([[-1], ones - np.arange(len(ones))])
        self.children = np.diff(zeros, prepend=-1) - 1

    def child(self, node: int, label: tuple[int, int]) -> int:
        """The child of a node by its label, or -1."""
        low, high = np.searchsorted(self.parent[1:], [node, node + 1]) + 1
        for at in range(low, high):
            if tuple(self.labels[at - 1]) == label:
                return at
        return -1

    def levels(self) -> list[tuple[int, int]]:
        """First node and end of each level."""
        out, low, high = [], 0, 1
        while low < high:
            out.append((low, high))
            low, high = high, high + int(self.children[low:high].sum())
        return out

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sums of the nodes' values over subtrees: levels are added to their parents, the last one first."""
        out = values.copy()
        for low, high in self.levels()[:0:-1]:
            np.add.at(out, self.parent[low:high], out[low:high])
        return out


def louds(parent: np.ndarray, labels: np.ndarray) -> tuple[Louds, np.ndarray]:
    """The trie of nodes with the given parents (-1: the root above) and labels, and the nodes in level order."""
    by_parent = np.lexsort((labels[:, 1], labels[:, 0], parent))
    first = np.searchsorted(parent[by_parent], np.arange(-1, len(parent) + 1))
    order, level, bits = [], np.array([-1]), []
    while len(level):
        low, high = first[level + 1], first[level + 2]
        n = high - low
        bits.append(np.ones(int(n.sum()) + len(level), bool))
        bits[-1][np.cumsum(n + 1) - 1] = False
        starts = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        level = by_parent[starts + np.arange(int(n.sum()))]
        order.append(level)
    at = np.concatenate(order)
    return Louds(np.concatenate(bits), labels[at]), at


def _shard_trie(t: pa.Table) -> tuple[Louds, np.ndarray, np.ndarray]:
    """The trie of a shard's rows, the rows in level order, and each row's parent row (-1 outside the shard)."""
    keys = {k: i for i, k in enumerate(zip(t["k1"].to_pylist(), t["k2"].to_pylist(), strict=True))}
    parent = np.array([keys.get(k, -1) for k in zip(t["p1"].to_pylist(), t["p2"].to_pylist(), strict=True)], np.int64)
    trie, at = louds(parent, np.stack([t["e1"].to_numpy(), t["e2"].to_numpy()], 1))
    return trie, at, parent


def _rolled_up(t: pa.Table) -> pa.Table:
    """What the trie of a shard tells of its nodes."""
    trie, at, parent = _shard_trie(t)
    conv, n, chars = (t[c].to_numpy()[at] for c in ("conv_id", "n_convs", "chars"))
    above = np.concatenate([[0], parent])[at + 1]
    root = [[0]]
    leaves = trie.summed(np.concatenate([*root, trie.children[1:] == 0]).astype(np.int64))
    saved = trie.summed(np.concatenate([*root, (n - 1) * chars]).astype(np.int64))
    out = t.take(pa.array(at)).select(["depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs"])
    added = {"parent_conv_id": pa.array(t["conv_id"].to_numpy()[above], pa.int64(), mask=above < 0), "n_children": trie.children[1:], "n_leaves": leaves[1:], "saved_tokens": saved[1:], "top": above < 0}
    for name, values in added.items():
        out = out.append_column(name, values if isinstance(values, pa.Array) else pa.array(values))
    return out


_ROLLED = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, top boolean"


class Forest:
    """Nodes of all rebuilt conversations, split into light ones, dealt to shards, and heavy ones."""

    def __init__(self, conversations: DataFrame, shard: int = SHARD):
        turns, convs = rebuilt(conversations)
        order, keep = [F.col("depth")], ["depth", "e1", "e2", "chars"]
        keyed = written(running(turns, "conv_id", order, keep, {"k1": ("e1", F.bit_xor), "k2": ("e2", F.bit_xor)}), "prefixes")
        last = keyed.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("end")).select("conv_id", "end.*")
        zero = F.lit(0).cast("long")
        self.ends = written(convs.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(c, zero).alias(c) for c in KEY)), "ends")
        whole = written(self.ends.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("same")), "whole")
        whole = whole.select("conv_id", "same", F.col("depth").alias("length"))
        self.paths = keyed.join(broadcast_if_small(whole, whole.count()), "conv_id")
        nodes = self.paths.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.sum("same").alias("n_convs"), F.sum(F.col("length") - F.col("depth") + 1).alias("below"),
            *(F.min(c).alias(c) for c in ("e1", "e2", "chars")),
        )
        nodes = nodes.withColumns({f"p{k}": F.col(f"k{k}").bitwiseXOR(F.col(f"e{k}")) for k in (1, 2)})
        self.nodes = written(nodes, "nodes")
        self.heavy = self.nodes.where(F.col("below") > shard)
        self.n_heavy = self.heavy.count()
        shards = max(1, -(-self.nodes.count() // shard))
        # a path's trie is that of the node after its last heavy one
        cut = self.paths.join(broadcast_if_small(self.heavy.select(*KEY), self.n_heavy), KEY).groupBy("conv_id").agg(F.max("depth").alias("cut"))
        tops = self.paths.select("conv_id", *KEY).join(cut, "conv_id", "left").where(F.col("depth") == F.coalesce("cut", zero) + 1)
        tops = tops.select("conv_id", F.pmod(F.xxhash64("k1", "k2"), F.lit(shards)).alias("shard"))
        self.light = self.nodes.where(F.col("below") <= shard).join(tops, "conv_id")

    def rolled_up(self) -> DataFrame:
        """Light nodes with what their shard's trie tells of them."""
        rows = self.light.select("shard", *KEY, "p1", "p2", "e1", "e2", "conv_id", "n_convs", "chars")
        return rows.groupBy("shard").applyInArrow(_rolled_up, _ROLLED)

    def merged(self, light: DataFrame) -> DataFrame:
        """Heavy nodes with what hangs under them, from rolled up light ones."""
        up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
        tops = light.where("top").select(*up, "n_leaves", "saved_tokens")
        others = self.heavy.select(*up, F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        under = tops.unionByName(others).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        own = (F.col("n_convs") - 1) * F.col("chars")
        direct = self.heavy.join(under, KEY, "left").select(
            *KEY, "p1", "p2", "conv_id", "n_convs", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_children", "n_leaves")), (own + F.coalesce("saved_tokens", F.lit(0))).alias("saved_tokens")
        )
        direct = written(direct, "heavy")
        # each heavy node lies on the path of its smallest member; sums from the path's last heavy node up, then over the paths through a node
        paths = self.paths.select("conv_id", *KEY).join(broadcast_if_small(direct.select("conv_id").distinct(), self.n_heavy), "conv_id", "left_semi")
        mine = direct.select("conv_id", *KEY, F.col("n_leaves").alias("a"), F.col("saved_tokens").alias("b"))
        on_path = paths.join(direct.select(*KEY), KEY, "left_semi").join(mine, ["conv_id", *KEY], "left").na.fill(0, ["a", "b"])
        sums = running(on_path, "conv_id", [F.desc("depth")], [*KEY, "a", "b"], {"leaves": ("a", F.sum), "saved": ("b", F.sum)})
        sums = sums.groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        return direct.drop("n_leaves", "saved_tokens").join(sums, KEY)

    def end_hashes(self) -> DataFrame:
        """Of each node that conversations end at, the SHA-256 of their ids, ascending and joined by commas.

        Ids are joined in range partitions; one stream an end reads the joined bytes, in chunks of bounded size.
        """

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, ids, size = None, [], 0
            out: list[tuple] = []
            for batch in batches:
                for *now, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id")), strict=True):
                    if now != key or size > CHUNK:
                        if ids:
                            out.append((*key, ids[0], ",".join(map(str, ids)).encode()))
                        key, ids, size = now, [], 0
                    ids.append(conv)
                    size += 12
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "first", "ids"), r, strict=True)) for r in out], schema=chunk)
                    out = []
            if ids:
                yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "first", "ids"), (*key, ids[0], ",".join(map(str, ids)).encode()), strict=True))], schema=chunk)

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, sha = None, None
            for batch in batches:
                out = []
                for *now, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                    if now != key:
                        if key is not None:
                            out.append((*key, sha.hexdigest()))
                        key, sha = now, hashlib.sha256(ids)
                    else:
                        sha.update(b"," + ids)
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "sha"), r, strict=True)) for r in out], schema=named)
            if key is not None:
                yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "sha"), (*key, sha.hexdigest()), strict=True))], schema=named)

        longs = [pa.field(c, pa.int64()) for c in KEY]
        chunk, named = pa.schema([*longs, pa.field("first", pa.int64()), pa.field("ids", pa.binary())]), pa.schema([*longs, pa.field("sha", pa.string())])
        rows = self.ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
        parts = rows.mapInArrow(joined, "depth long, k1 long, k2 long, first long, ids binary")
        return parts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, "depth long, k1 long, k2 long, sha string")

    def root(self, light: DataFrame, heavy: DataFrame) -> DataFrame:
        """The root, if there is any conversation."""
        members = self.ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
        tops = light.where("top").unionByName(heavy.withColumns({"parent_conv_id": F.lit(None).cast("long"), "top": F.lit(True)})).where("depth = 1")
        tops = tops.agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        zero = F.lit(0).cast("long")
        return members.join(tops).select(
            *(zero.alias(c) for c in KEY), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
            F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        )


def tries(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """The tries of each shard under one root: shard, n_nodes, bits (level order, eight to a byte), labels and conv_ids in level order."""

    def built(t: pa.Table) -> pa.Table:
        trie, at, _ = _shard_trie(t)
        return pa.table(
            {
                "shard": t["shard"].slice(0, 1), "n_nodes": pa.array([len(at)], pa.int64()), "bits": pa.array([np.packbits(trie.bits).tobytes()], pa.binary()),
                "labels": pa.array([trie.labels.ravel().tolist()], pa.list_(pa.int64())), "conv_ids": pa.array([t["conv_id"].to_numpy()[at].tolist()], pa.list_(pa.int64())),
            }
        )

    rows = Forest(conversations, shard).light.select("shard", "k1", "k2", "p1", "p2", "e1", "e2", "conv_id")
    return rows.groupBy("shard").applyInArrow(built, "shard long, n_nodes long, bits binary, labels array<long>, conv_ids array<long>")


def nodes(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    forest = Forest(conversations, shard)
    light = written(forest.rolled_up(), "light")
    heavy = written(forest.merged(light), "merged")
    root = forest.root(light, heavy)
    # parents of heavy nodes and of the tops of tries are heavy, or the root
    parents = heavy.select(*KEY, "conv_id").unionByName(root.select(*KEY, "conv_id"))
    parents = parents.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    columns = [*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    tops = light.where("top").drop("top", "parent_conv_id").unionByName(heavy)
    tops = tops.join(broadcast_if_small(parents, forest.n_heavy + 1), ["depth", "p1", "p2"], "left").withColumnRenamed("above", "parent_conv_id")
    found = light.where("not top").select(columns).unionByName(tops.select(columns)).unionByName(root.select(columns))
    none = hashlib.sha256(b"").hexdigest()
    return found.join(forest.end_hashes(), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(none)).alias("ends_sha256")
    )

"""Prefix tries against a dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from medlake.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    members = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = turns.get(c - c % 100, [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    children = {k: [x for x in members if len(x) == len(k) + 1 and x[: len(k)] == k] for k in members}
    out = []

    def told(k):
        ids = [c for c, _ in members[k]]
        below = [told(x) for x in children[k]]
        leaves = sum(x[0] for x in below) or 1
        saved = sum(x[1] for x in below) + ((len(ids) - 1) * len(k[-1][1]) if k else 0)
        ends = sorted(c for c, e in members[k] if e)
        parent = min(c for c, _ in members[k[:-1]]) if k else None
        out.append((min(ids), len(k), parent, len(ids), len(below), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, saved

    if members:
        told(())
    return sorted(out, key=repr)


def sample(n=260, seed=2):
    """Shared first turns, copies, missing bases, turnless conversations, nulls, ties and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 20), *range(100, 130), *range(207, 240), 300, 301, *range(1000, 1000 + n)]:
        kind = rng.randrange(5)
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            text = ["hello", "hello", rng.choice(["yes", "no", "𠮷野家", ""]), "why", "so"][t % 5] if kind < 4 else f"own {c} {t}"
            rows.append((c, t, rng.choice(["user", "user", "assistant"]) if t > 3 else "user", text))
    rows += [(5, None, None, None), (5, None, "user", "first"), (6, 0, "user", "tie"), (6, 0, "user", "tie"), (6, 0, "assistant", "tie"), (None, 0, "user", "lost")]
    rng.shuffle(rows)
    return rows


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shard", [3, 40, 20_000])
def test_nodes_match_a_plain_trie(spark, shard):
    """With small shards most nodes are heavy and merged; with large ones all are in tries."""
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(tries.nodes(df, shard)) == plain(rows)


def test_a_conversation_longer_than_a_partition(spark):
    """Positions and hashes run on from one range partition to the next."""
    rows = [(7, t, "user", f"turn {t % 11}") for t in range(700)] + [(8, t, "user", f"turn {t % 11}") for t in range(400)] + [(9, 0, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    with_parts = tries.running(df, "conv_id", [F.col("turn")], ["turn"], {"pos": ("conv_id", F.count), "sum": ("turn", F.sum), "x": ("turn", F.bit_xor)})
    got = {(r.conv_id, r.turn): (r.pos, r.sum, r.x) for r in with_parts.collect()}
    want = {}
    for c, n in ((7, 700), (8, 400), (9, 1)):
        s = x = 0
        for t in range(n):
            s, x = s + t, x ^ t
            want[c, t] = (t + 1, s, x)
    assert got == want
    assert found(tries.nodes(df, 50)) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "a")], [(3, None, None, None)], [(101, 0, "user", "a"), (101, 1, "user", "b")]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("d"), "k1": F.lit(1), "n": F.lit(2), "base": F.lit(3), "length": F.lit(4)})
    assert found(tries.nodes(df)) == plain(rows)


def test_large_groups_of_ends_are_hashed_in_chunks(spark):
    rows = [(1000 + i, 0, "user", "same") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(tries.nodes(df)) == plain(rows)


def test_louds_bits():
    """root -> 0, 1; 0 -> 2, 3; 3 -> 4."""
    parent = np.array([-1, -1, 0, 0, 3])
    labels = np.array([[1, 0], [2, 0], [5, 0], [6, 0], [7, 0]])
    trie, at = tries.louds(parent, labels)
    assert at.tolist() == [0, 1, 2, 3, 4]
    assert trie.bits.astype(int).tolist() == [1, 1, 0, 1, 1, 0, 0, 0, 1, 0, 0]
    assert trie.parent.tolist() == [-1, 0, 0, 1, 1, 4] and trie.children.tolist() == [2, 2, 0, 0, 1, 0]
    assert trie.summed(np.array([0, 1, 1, 1, 1, 1])).tolist() == [5, 4, 1, 1, 2, 1]
    assert trie.child(0, (2, 0)) == 2 and trie.child(4, (7, 0)) == 5 and trie.child(2, (7, 0)) == -1


def test_stored_tries_hold_every_light_node(spark):
    df = spark.createDataFrame(sample(), SCHEMA)
    light = tries.Forest(df, 30).light.count()
    stored = tries.tries(df, 30).collect()
    assert sum(r.n_nodes for r in stored) == light
    for r in stored:
        bits = np.unpackbits(np.frombuffer(r.bits, np.uint8))[: 2 * r.n_nodes + 1].astype(bool)
        trie = tries.Louds(bits, np.array(r.labels).reshape(-1, 2))
        assert len(trie.children) == r.n_nodes + 1 and trie.children.sum() == r.n_nodes and len(r.conv_ids) == r.n_nodes

"""The conversation trie against a plain one, with small blocks, many boundaries and odd rows."""

import hashlib
import random
import zlib

import pytest

from storegrain.llm import trie
from storegrain.llm.queries import QUERIES


def plain_trie(sequences):
    """``sequences``: id to a list of (role, text); rows as in the contract."""
    nodes = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv)
    kids, out = {}, []
    for path in nodes:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    leaves, saved = {}, {}
    for path, members in nodes.items():
        own = (len(members) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in kids)
            saved[path[:d]] = saved.get(path[:d], 0) + own
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(sequences[c]) == len(path))))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), kids.get(path, 0), leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


def ordered(rows):
    groups = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            groups.setdefault(conv, []).append((turn, role or "", text or ""))
    key = lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest()[:16])
    return {c: [t[1:] for t in sorted(g, key=key)] for c, g in groups.items()}


def same(found, expected):
    return sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_op13(spark, folder):
    own = ordered(map(tuple, spark.read.parquet(f"{folder}/conversations.parquet").collect()))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    assert same(QUERIES["op13_conversation_trie"](spark, folder).collect(), plain_trie(rebuilt))


def drawn(seed, count=250):
    draw, rows = random.Random(seed), []
    stems = [[draw.choice("ab") for _ in range(14)] for _ in range(5)]
    for conv in range(count):
        turns = draw.choice(stems)[: draw.randint(1, 14)] + [draw.choice("abcd") for _ in range(draw.choice([0, 0, 1, 3]))]
        if draw.random() < 0.2:
            turns = stems[0]
        if draw.random() < 0.1:
            turns = [str(draw.random()) for _ in range(draw.randint(1, 11))]
        rows += [(conv * 3 - 60, i, draw.choice(["u", "u", None]) if draw.random() < 0.1 else "u", t * 3 + "é") for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("block", [3, 32])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = drawn(block)
    draw = random.Random(1)
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert same(trie.prefix_trie(docs).collect(), plain_trie(ordered(rows)))


def test_many_boundaries(spark):
    rows = drawn(9, 120)
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert same(trie.prefix_trie(docs).collect(), plain_trie(ordered(rows)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_long_conversations(spark):
    """A chain of many blocks that one conversation has, and two that share many."""
    rows = [(5, i, "u", f"x{i}") for i in range(500)] + [(c, i, "u", f"y{i}") for c in (7, 9) for i in range(100)] + [(9, 100, "a", "z")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert same(trie.prefix_trie(docs).collect(), plain_trie(ordered(rows)))


def test_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, depth string, n long, before string"
    none = spark.createDataFrame([], schema)
    assert trie.prefix_trie(none).collect() == []
    rows = [(1, None, None, None), (1, 1, "u", "a"), (1, 1, "u", "a"), (2, None, "", ""), (None, 1, "u", "a"), (3, 1, "u", "é" * 300_000)]
    docs = spark.createDataFrame([(*r, "d", 1, "b") for r in rows], schema)
    assert same(trie.prefix_trie(docs).collect(), plain_trie(ordered(rows)))
    members = spark.createDataFrame([(1,), (2,), (8,), (None,)], "conv_id long")
    assert same(trie.trie_nodes(trie.turn_keys(docs.where("conv_id < 3")), members).collect(), plain_trie({1: ordered(rows)[1], 2: ordered(rows)[2], 8: []}))
    assert same(trie.trie_nodes(trie.turn_keys(none), members).collect(), plain_trie({1: [], 2: [], 8: []}))

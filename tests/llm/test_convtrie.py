"""The prefix trie against one built node by node."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from inkstrata.llm import convtrie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, every=100, most=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        turns = tuple(own.get(c - int(math.fmod(c, every)), [])[:h] + turns[h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append((c, len(turns) == d))
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(below[c][0] for c in children[p]) if children[p] else 1
        saved = sum(below[c][1] for c in children[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        below[p] = leaves, saved
    low = lambda p: min(c for c, _ in members[p])
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c, e in members[p] if e))).encode()).hexdigest()
    return sorted((low(p), len(p), low(p[:-1]) if p else -1, len(members[p]), len(children[p]), *below[p], ends(p)) for p in members)


def found(df, **more):
    out = convtrie.prefix_trie(df, **more).collect()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in out)


def table(seed, convs, words, turns, every):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, turns)):
            rows.append((c if c % 7 else c + every, t, rng.choice(["user", "assistant"]), "x" * rng.randrange(words)))
    return rows


@pytest.mark.parametrize(("seed", "convs", "words", "turns", "block"), [(1, 300, 2, 5, 3), (2, 300, 1, 9, 5), (3, 200, 30, 3, 1), (4, 400, 2, 4, None), (5, 250, 3, 40, 16)])
def test_equals_a_trie_built_node_by_node(spark, seed, convs, words, turns, block):
    rows = table(seed, convs, words, turns, 10)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(df, every=10, block=block) == brute(rows, every=10)


def test_many_copies_with_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "PIECE", 7)
    rows = [(100 * c, t, "user", "same") for c in range(120) for t in range(3)] + [(100 * c, 3, "user", str(c)) for c in range(3)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5), block=2) == brute(rows)


def test_odd_conversations(spark):
    rows = [
        (0, None, None, None), (0, None, "user", None), (0, 1, "user", "a" * 300_000), (1, 5, "ü", "é"), (1, 5, "ü", "é"), (1, 5, "ü", "a"), (2, 1, "us", "er"), (3, 1, "user", ""), (3, 1, "use", "r"),
        (None, 0, "user", "left out"), (250, 0, "user", "no conversation to begin with"), (-7, 0, "user", "below zero"), (10**15 + 3, 0, "user", "far"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 key", "2 n", "3 block", "4 depth", "5 conv")
    assert found(df) == brute(rows)
    assert found(df.where("conv_id = 250")) == brute([rows[-3]])
    assert convtrie.prefix_trie(df.limit(0)).collect() == []


def test_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert found(df, block=20) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])

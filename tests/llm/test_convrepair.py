"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from inkstrata.llm import convrepair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
GOAL = re.compile("(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit) by a search in the order of cost. rows: (initial, fault) with fault '', 'trunc' or 'gone'."""
    heap, best = [(0, "", 0, "")], None
    seen = set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if i == len(rows) and GOAL.fullmatch(out):
            best = min(best or (cost, audit), (cost, audit))
            continue
        if (cost, audit, i, out) in seen or not GOAL.fullmatch(out) and not GOAL.fullmatch(out + "a") and not GOAL.fullmatch(out + "ua"):
            continue
        seen.add((cost, audit, i, out))
        for x in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, out + x))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if fault != "gone":
                more = 3 * (fault == "trunc")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, out + initial))
                for x in "ua":
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, out + x))
    return best


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is None:
            continue
        convs[c]
        role, text = " " if role is None else role, " " if text is None else text
        hurt = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hurt == 1 else re.sub("[.!?]", "", text) if hurt == 2 else text
        role = "user" if hurt == 4 else role
        convs[c] += [(turn, role, text)] * {0: 0, 3: 2}.get(hurt, 1)
    out = []
    for c, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = [t for t, _, _ in own if t is not None]
        seen, signs, n = set(), [], defaultdict(int)
        for _, role, text in own:
            left = text.strip(WHITE)
            fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            signs.append((role[:1], {"blank": "gone", "duplicate": "gone", "truncated": "trunc"}.get(fault, "")))
        cost, audit = cheapest(signs)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(signs, signs[1:]))
        lines, i, initials = [], 0, ""
        for e in audit:
            nxt = "assistant" if initials.endswith("u") else "user"
            if e == "I":
                lines.append(nxt + ":")
                initials += nxt[0]
                continue
            _, role, text = own[i]
            i += 1
            if e != "D":
                role = nxt if e == "R" else role
                lines.append(f"{role}:{text}")
                initials += role[:1]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in convrepair.repair(df).collect())


def table(seed, convs, turns):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "three", "  ", "four?  ", "", "five .\n"]
    roles = ["user", "assistant", "assistant", "user", "system", "tool", None]
    return [(c, None if rng.random() < 0.03 else t + rng.randrange(2), rng.choice(roles), rng.choice([*texts, None, f"text {t}."])) for c in range(convs) for t in range(rng.randint(1, turns))]


@pytest.mark.parametrize("small", [True, False])
def test_equals_a_search_over_all_edits(spark, monkeypatch, small):
    rows = table(1, 250, 6)
    if small:
        monkeypatch.setattr(convrepair, "TRIE_ROWS", 9)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "no conversation."), (1, 1, "", "An empty role."), (1, 1, "", "An empty role."), (1, 2, "user", "x" * 400_000), (2, None, None, None), (3, -5, "ürk", "é."), (3, 10**12, "assistant", "."),
        (4, 1, "user", "b."), (4, 1, "user", "a."), (4, 1, "assistant", "c."), (5, 3, "system", "s."), (5, 4, "system", "t."), *((6, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(900)),
    ]
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' audit", "1 same", "2 cut", "3 begin", "4 hurt").repartition(4)
    got = {r[0]: r for r in found(more)}
    want = {r[0]: r for r in brute([r for r in rows if r[0] != 6])}
    assert {c: r for c, r in got.items() if c != 6} == want
    left = {t for t in range(900) if zlib.crc32(f"6:{t}".encode()) % 20}
    assert got[6][1] == max(left) - min(left) + 1 - len(left) and len(got[6][7]) >= 850
    assert convrepair.repair(more.limit(0)).collect() == []


def test_each_shared_ending_has_one_layer():
    rng = np.random.default_rng(3)
    signs = [bytes(rng.integers(0, 15, rng.integers(0, 9)).astype(np.uint8)) for _ in range(400)] + [bytes([5] * 40), bytes([6] + [5] * 40)]
    trie = convrepair.Trie(signs)
    assert len(trie.cost) == len({s[i:] for s in signs for i in range(len(s) + 1)})
    cost, edits = trie.edits()
    initial = {v: k for k, v in convrepair.INITIALS.items()} | {convrepair.OTHER: "t"}
    for s in signs[:400]:
        rows = [(initial[x % 5], ("", "trunc", "gone")[x // 5]) for x in s]
        assert (cost[trie.place[s]], edits[trie.place[s]].decode()) == cheapest(rows)


def test_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert found(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])

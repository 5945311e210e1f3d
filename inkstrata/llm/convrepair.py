"""Repair of the structure of conversations by a dynamic programme over a trie.

A conversation's signature has one byte for each row: the initial of its role and its fault. What the
cheapest edits of a rest of a conversation cost depends on the rest only, so signatures are
read from their ends: they are sorted, their common prefixes make a trie, and each node gets
one layer of costs, one for each state of the grammar, from the layer of its parent. At a terminal
node the edits are read back along the path to the root, the least character first.

Texts never meet in one place: rows are narrow for the signatures, and the repaired texts are
hashed as they stream by, sorted, after the edits of their conversation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Rows of a task that are brought into one trie.
TRIE_ROWS = 200_000

#: The costs of edits.
RETYPE, DELETE, INSERT, LEFT_TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. The next state by initial, -1 where there is none.
NEXT = np.array([[1, 2, -1], [-1, 2, -1], [-1, -1, 3], [-1, 2, -1]])
ENDS = (0, 3)
#: The state after an inserted or retyped row, and whose row it is.
FORCED = np.array([2, 2, 3, 2])
FORCED_ROLE = ("user", "user", "assistant", "user")
#: Initials in a signature; another one fits nowhere, an empty role has none.
INITIALS = {"s": 0, "u": 1, "a": 2, "": 3}
OTHER = 4
KINDS = len(INITIALS) + 1
FINE, TRUNCATED, GONE = 0, 1, 2
FAR = 1 << 40
#: White space, and what ends a text.
SPACES = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")


# --- rows after damage ----------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the rows that damage leaves. Null roles and texts are one
    space, before damage."""
    space = F.lit(" ")
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("hurt", F.pmod(F.crc32(key.cast("binary")), F.lit(20)).cast("int")).where("hurt <> 0")
    text = F.when(F.col("hurt") == 1, F.lit("")).when(F.col("hurt") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hurt") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("hurt") == 3, 2).otherwise(1))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def _tie():
    """What orders rows of one turn and role: the text's beginning, then a digest of role and text."""
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return F.substring("text", 1, 32).alias("begin"), F.unhex(digest).alias("same")


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, begin, same, blank, cut) of damaged rows."""
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    return rows.select("conv_id", "turn", "role", *_tie(), (last == "").alias("blank"), (~last.isin(*STOPS)).alias("cut"))


# --- the trie and its layers ----------------------------------------------------------


def _relaxed(cost: np.ndarray) -> np.ndarray:
    """Costs of all states when rows may be inserted first."""
    for _ in range(len(NEXT)):
        cost = np.minimum(cost, INSERT + cost[:, FORCED])
    return cost


def last_layer() -> np.ndarray:
    cost = np.full((1, 4), FAR)
    cost[:, ENDS] = 0
    return _relaxed(cost)


def layer(parent: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Costs of nodes from those of their parents (the rest of the conversation) and their rows."""
    initial, fault = sign % KINDS, sign // KINDS
    cost = DELETE + parent
    stays = fault != GONE
    extra = np.where(fault == TRUNCATED, LEFT_TRUNCATED, 0)[:, None]
    retyped = RETYPE + extra + parent[:, FORCED]
    kept = extra + np.take_along_axis(parent, np.maximum(_after(initial), 0), axis=1)
    kept = np.where(_after(initial) < 0, FAR, kept)
    return _relaxed(np.where(stays[:, None], np.minimum(np.minimum(cost, retyped), kept), cost))


#: The state after a kept row, by initial and state; an empty role changes nothing.
AFTER = np.concatenate([NEXT.T, [np.arange(4)], [np.full(4, -1)]])


def _after(initial: np.ndarray) -> np.ndarray:
    return AFTER[initial]


class Trie:
    """Distinct signatures, each read from its last row, with a layer of costs for each node."""

    def __init__(self, signatures: list[bytes]):
        order = sorted(set(s[::-1] for s in signatures))
        self.place = {s[::-1]: i for i, s in enumerate(order)}
        n = np.array([len(s) for s in order], np.int64)
        self.start = np.cumsum(n) - n
        self.flat = np.frombuffer(b"".join(order), np.uint8).astype(np.int64)
        self.node = np.zeros(len(self.flat), np.int64)  # of each signature and depth
        shared = self._shared(n)
        layers, nodes = [last_layer()], 1
        at, above = np.flatnonzero(n > 0), np.zeros(len(n), np.int64)
        d = 0
        while len(at):
            new = shared[at] <= d
            here = nodes + np.cumsum(new) - 1
            first = at[new]
            parents = layers[-1][above[first] - (nodes - len(layers[-1]))]
            layers.append(layer(parents, self.flat[self.start[first] + d]))
            self.node[self.start[at] + d] = here
            above[at] = here
            nodes += len(first)
            d += 1
            at = at[n[at] > d]
        self.n, self.cost = n, np.concatenate(layers)

    def _shared(self, n: np.ndarray) -> np.ndarray:
        """Rows that each signature shares with the one before it."""
        out = np.zeros(len(n), np.int64)
        at = np.arange(1, len(n))
        d = 0
        while len(at):
            at = at[np.minimum(n[at - 1], n[at]) > d]
            at = at[self.flat[self.start[at - 1] + d] == self.flat[self.start[at] + d]]
            out[at] += 1
            d += 1
        return out

    def edits(self) -> tuple[np.ndarray, list[bytes]]:
        """The least cost of each signature and its ASCII-least edits: from the terminal node up,
        the first of D, I, K, R that keeps the cost."""
        m = len(self.n)
        depth, state = self.n.copy(), np.zeros(m, np.int64)
        node = lambda i: np.where(depth[i] > 0, self.node[np.maximum(self.start[i] + depth[i] - 1, 0)] if len(self.node) else 0, 0)
        cost = self.cost[node(np.arange(m)), 0] if m else np.zeros(0, np.int64)
        who, what = [], []
        at = np.arange(m)
        while True:
            # done: no row left and no cost left in a state at which a conversation may end
            at = at[(depth[at] > 0) | (self.cost[0, state[at]] > 0)]
            if not len(at):
                break
            here = self.cost[node(at), state[at]]
            row = depth[at] > 0
            sign = np.where(row, self.flat[np.maximum(self.start[at] + depth[at] - 1, 0)] if len(self.flat) else 0, 0)
            rest = np.where(depth[at] > 1, self.node[np.maximum(self.start[at] + depth[at] - 2, 0)] if len(self.node) else 0, 0)
            fault, stays = sign // KINDS, row & (sign // KINDS != GONE)
            extra = np.where(fault == TRUNCATED, LEFT_TRUNCATED, 0)
            after, forced = _after(sign % KINDS)[np.arange(len(at)), state[at]], FORCED[state[at]]
            deleted = row & (DELETE + self.cost[rest, state[at]] == here)
            inserted = ~deleted & (INSERT + self.cost[node(at), forced] == here)
            kept = ~deleted & ~inserted & stays & (after >= 0) & (extra + self.cost[rest, np.maximum(after, 0)] == here)
            who.append(at)
            what.append(np.select([deleted, inserted, kept], [ord("D"), ord("I"), ord("K")], ord("R")).astype(np.uint8))
            state[at] = np.select([deleted, kept], [state[at], after], forced)
            depth[at] -= ~inserted
        if not who:
            return cost, [b""] * m
        who, what = np.concatenate(who), np.concatenate(what)
        what = what[np.argsort(who, kind="stable")].tobytes()
        cut = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=m))])
        return cost, [what[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]


# --- conversations of a task ----------------------------------------------------------

FOUND = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
FINDS = [x.split()[0] for x in FOUND.split(", ")]
LEGAL = {"su", "ua", "au"}


class _Open:
    """The rows of one conversation so far."""

    def __init__(self, conv: int):
        self.conv, self.seen, self.sign = conv, set(), bytearray()
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None

    def add(self, turn, role: str, same: bytes, blank: bool, cut: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.high = self.turn = turn
        again = same in self.seen
        self.seen.add(same)
        fault = GONE if blank or again else TRUNCATED if cut else FINE
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += fault == TRUNCATED
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        self.sign.append(fault * KINDS + INITIALS.get(initial, OTHER))

    def counts(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _repairs(batches):
    """Marked rows sorted by (conv_id, turn, ...) -> FOUND, one trie for many conversations."""
    done, rows, one = [], 0, None

    def flush():
        trie = Trie([bytes(x.sign) for x in done])
        cost, edits = trie.edits()
        places = [trie.place[bytes(x.sign)] for x in done]
        columns = [*zip(*(x.counts() for x in done), strict=True), cost[places].tolist(), [edits[p].decode() for p in places]]
        return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in columns], names=FINDS)

    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if one is None or one.conv != conv:
                if one is not None:
                    one.seen = None
                    done.append(one)
                    rows += len(one.sign)
                    if rows >= TRIE_ROWS:
                        yield flush()
                        done, rows = [], 0
                one = _Open(conv)
            one.add(*row)
    if one is not None:
        done.append(one)
        yield flush()


def _applied(batches):
    """(conv_id, audit, turn, role, text), the row with the audit before the rows of its conversation
    -> (conv_id, repaired_sha256, and the repaired text's pieces if asked for)."""
    conv, out = None, []
    audit, at, state, sha, first = "", 0, 0, None, True

    def line(role: str, text: str) -> None:
        nonlocal first
        sha.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            line(FORCED_ROLE[state], "")
            state, at = int(FORCED[state]), at + 1

    def close() -> None:
        if conv is not None:
            inserts()
            out.append((conv, sha.hexdigest()))

    for batch in batches:
        for c, edits, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if edits is not None:
                close()
                conv, audit, at, state, sha, first = c, edits, 0, 0, hashlib.sha256(), True
                continue
            inserts()
            what, at = audit[at], at + 1
            if what == "K":
                line(role, text)
                state = int(AFTER[INITIALS.get(role[:1], OTHER), state])
            elif what == "R":
                line(FORCED_ROLE[state], text)
                state = int(FORCED[state])
        if out:
            yield _hashes(out)
            out = []
    close()
    if out:
        yield _hashes(out)


def _hashes(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=["conv_id", "repaired_sha256"])


def repair(conversations: DataFrame) -> DataFrame:
    """One row for every conv_id: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) of the damaged rows, as the contract of the query states them.

    Rows are ordered by turn, null ones first, ties by role, the first 32 characters of the text
    and a digest; a null turn counts as a space
    in the key of the damage. Rows without conv_id belong to no conversation and are left out.
    A role's initial is its first character; an empty role has none, so that keeping its row changes no
    state, and with its neighbours it is illegal. Repeated rows are duplicates. Texts of any length
    stream by; a conversation of any number of rows is held as a byte and a digest a row in its task,
    its texts never. An empty table gives an empty one; other columns are not read.
    """
    bounded_batches(conversations.sparkSession)
    rows = damaged(conversations)
    # the same order for the narrow rows and for the texts
    order = ["conv_id", "turn", "role", "begin", "same"]
    narrow = marked(rows).repartition("conv_id").sortWithinPartitions(*order)
    found = narrow.select("conv_id", "turn", "role", "same", "blank", "cut").mapInArrow(_repairs, FOUND)
    found = written(found, "repairs")
    texts = rows.select("conv_id", "turn", "role", "text", *_tie()).withColumn("audit", F.lit(None).cast("string"))
    both = texts.unionByName(found.select("conv_id", "audit"), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").desc_nulls_last(), *order[1:])
    hashes = both.select("conv_id", "audit", "role", "text").mapInArrow(_applied, "conv_id bigint, repaired_sha256 string")
    ids = conversations.where("conv_id is not null").select("conv_id").distinct()
    out = ids.join(found, "conv_id", "left").join(hashes, "conv_id", "left")
    nothing = {c: 0 for c in FINDS[1:-1]} | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return out.fillna(nothing).select(*FINDS, "repaired_sha256")

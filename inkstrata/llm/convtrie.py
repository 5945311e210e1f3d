"""The prefix trie of conversations, from the sorted conversations and their common prefixes.

Equal conversations become one row with a weight; the rows are put in one order over all
partitions, and L[i] is the number of turns that row i shares with the row before it. The nodes
at which the trie branches are the nodes of the Cartesian tree of L, those of equal L below
one parent merged: for each i the nearest smaller values of L on both sides bound the rows
below the node. Blocks of rows find these values inside; what is open at a border is looked
up in the block that the minima of the blocks name, among the few values that are smaller than all
between them and that border. The nodes between a branching node and its parent have the same rows
below them and are put in at the end. All that is counted over rows below a node comes
from prefix sums, the smallest member from minima of blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Rows, and eighths of their turns, that are one block.
BLOCK = 65_536
#: Ids that are one piece of the list of a node's ends.
PIECE = 50_000
DIGEST = 16  # bytes for each turn
NO_ENDS = hashlib.sha256(b"").hexdigest()
UNKNOWN, OPEN = -2, -1
FAR = np.iinfo(np.int64).max


# --- conversations --------------------------------------------------------------------


def rebuilt(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, key, points) for every conversation: the first h turns of conversation
    c - c % every, then its own after its first h, with h = crc32(c) % most. The key holds 16
    bytes for each turn, from a SHA-256 of role and text; points are the code points of
    each text. Turns of one number follow by these bytes."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", digest.alias("digest"), F.length(text).alias("points"))
    own = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.struct(x.digest.alias("digest"), x.points.alias("points"))).alias("turns"))
    first = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("lent"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(first, "base", "left")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    lent = F.coalesce(F.slice("lent", F.lit(1), h), F.slice("turns", 1, 0))
    turns = F.concat(lent, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0))))
    return both.select("conv_id", turns.alias("turns")).select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("key"), F.col("turns.points").alias("points"))


def _pieces(batches):
    """Rows sorted by (same, conv_id) -> (same, first, n, ids): runs of equal ``same``, in pieces."""
    last, ids = None, []

    def piece():
        return last, ids[0], len(ids), ",".join(map(str, ids))

    for batch in batches:
        out = []
        for same, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (same != last or len(ids) >= PIECE) and ids:
                out.append(piece())
                ids = []
            last = same
            ids.append(conv)
        if out:
            yield _batch(zip(*out, strict=True), PIECES)
    if ids:
        yield _batch(([x] for x in piece()), PIECES)


def _batch(columns, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in columns], names=names)


PIECES = ["same", "first", "n", "ids"]


def _hashed(batches):
    """Pieces sorted by (same, first) -> (conv, n, ends): one row for each ``same``. A long
    list is hashed piece by piece as it comes."""
    last, first, n, sha = None, 0, 0, None
    for batch in batches:
        out = []
        for same, one, many, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if same == last:
                sha.update(b"," + ids.encode())
                n += many
                continue
            if sha is not None:
                out.append((first, n, sha.hexdigest()))
            last, first, n, sha = same, one, many, hashlib.sha256(ids.encode())
        if out:
            yield _batch(zip(*out, strict=True), ["conv", "n", "ends"])
    if sha is not None:
        yield _batch(([first], [n], [sha.hexdigest()]), ["conv", "n", "ends"])


def classes(convs: DataFrame) -> DataFrame:
    """(key, points, conv, n, ends): each different conversation once, with its smallest id,
    how many there are and the digest of their ids. Copies are counted before they are
    shuffled; the ids of many copies are sorted over many tasks and come together as text."""
    same = F.substring(F.sha2("key", 256), 1, 32).alias("same")
    ids = convs.select(same, "conv_id").repartitionByRange("same", "conv_id").sortWithinPartitions("same", "conv_id")
    pieces = ids.mapInArrow(_pieces, "same string, first bigint, n bigint, ids string").repartition("same").sortWithinPartitions("same", "first")
    ends = pieces.mapInArrow(_hashed, "conv bigint, n bigint, ends string")
    one = convs.groupBy("key").agg(F.min("conv_id").alias("conv"), F.first("points").alias("points"))
    return one.join(ends, "conv").select("key", "points", "conv", "n", "ends")


# --- order and common prefixes --------------------------------------------------------


def common_turns(words: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Turns that each row shares with the row before it (first row: 0). words: a row of
    two numbers for each turn; start, n: where a row's turns begin and how many there are."""
    out = np.zeros(len(n), np.int64)
    at = np.arange(1, len(n))
    d = 0
    while len(at):
        at = at[np.minimum(n[at - 1], n[at]) > d]
        at = at[(words[start[at - 1] + d] == words[start[at] + d]).all(axis=1)]
        out[at] += 1
        d += 1
    return out


def _turns(keys: pa.Array):
    keys = keys.cast(pa.large_binary())
    _, offs, data = keys.buffers()
    offs = np.frombuffer(offs, np.int64)[keys.offset : keys.offset + len(keys) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    offs = (offs - offs[0]) // DIGEST
    return np.ascontiguousarray(data).view(np.uint64).reshape(-1, 2), offs[:-1], np.diff(offs)


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the nearest smaller one to its left and right; OPEN where there is none."""
    left, right = np.full(len(values), OPEN, np.int64), np.full(len(values), OPEN, np.int64)
    stack, held = [], values.tolist()
    for i, v in enumerate(held):
        while stack and held[stack[-1]] > v:
            right[stack.pop()] = i
        if stack:
            left[i] = left[stack[-1]] if held[stack[-1]] == v else stack[-1]
        stack.append(i)
    return left, right


def _sums(points: pa.Array):
    """Prefix sums over the code points of all rows, and where each row's begin."""
    flat = np.asarray(points.flatten(), np.int64)
    start = np.concatenate([[0], np.cumsum(np.diff(points.offsets.to_numpy()))]).astype(np.int64)
    return np.concatenate([[0], np.cumsum(flat)]), start


ROWS = (
    "block bigint, pos bigint, key binary, lcp bigint, depth bigint, left bigint, right bigint, tail boolean, head boolean, conv bigint, n bigint, points array<int>, ends string, "
    "total bigint, fresh bigint, before_n bigint, before_leaves bigint, before_total bigint, before_fresh bigint, min_from bigint, min_before bigint"
)
NAMES = [x.split()[0] for x in ROWS.split(", ")]


def _exclusive(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)[:-1]]) if len(x) else x


def _block(block: int, first: int, table: pa.Table, lcp: np.ndarray, ends_partition: bool) -> pa.RecordBatch:
    """The rows of one block with their nearest smaller values inside it, and what is before each."""
    col = lambda name: table.column(name).combine_chunks()
    m = len(lcp)
    conv, n = np.asarray(col("conv")), np.asarray(col("n"))
    sums, start = _sums(col("points"))
    depth = np.diff(start)
    unknown = lcp == UNKNOWN
    total = sums[start[1:]] - sums[start[:-1]]
    fresh = np.where(unknown, 0, sums[start[1:]] - sums[start[:-1] + np.maximum(lcp, 0)])
    left, right = nearest_smaller(lcp)
    low = np.minimum.accumulate
    tail, head = np.ones(m, bool), np.ones(m, bool)
    tail[:-1] = lcp[:-1] < low(lcp[::-1])[::-1][1:]
    head[1:] = lcp[1:] < low(lcp)[:-1]
    leaf = np.append(depth[:-1] > lcp[1:], False)
    keyed = np.zeros(m, bool)
    keyed[0] = unknown[0]
    keyed[-1] |= ends_partition
    keys = col("key").to_pylist() if keyed.any() else [None] * m
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(m, block)), pa.array(first + np.arange(m)), pa.array([k if x else None for k, x in zip(keys, keyed, strict=True)], pa.binary()), pa.array(lcp, mask=unknown), pa.array(depth),
            pa.array(first + left, mask=left == OPEN), pa.array(first + right, mask=right == OPEN), pa.array(tail), pa.array(head), pa.array(conv), pa.array(n), col("points"), col("ends"),
            pa.array(total), pa.array(fresh), pa.array(_exclusive(n)), pa.array(_exclusive(leaf.astype(np.int64))), pa.array(_exclusive(n * total)), pa.array(_exclusive(fresh)),
            pa.array(low(conv[::-1])[::-1]), pa.array(np.append([FAR], low(conv)[:-1])),
        ], names=NAMES,
    )


def ordered(found: DataFrame, block: int | None = None) -> DataFrame:
    """The classes in the order of their keys, with blocks and places; the first row of a
    partition is a block of its own, of which ``lcp`` is not known yet."""
    limit = block or BLOCK

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        no, pos, cost, held, lcps, last = 0, 0, 0, [], [], None

        def flush(end=False):
            nonlocal no, pos, cost, held, lcps
            lcp = np.concatenate(lcps)
            out = _block(part + no, pos, pa.Table.from_batches(held), lcp, end)
            no, pos, cost, held, lcps = no + 1, pos + len(lcp), 0, [], []
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            words, start, n = _turns(keys if last is None else pa.concat_arrays([pa.array([last], keys.type), keys]))
            lcp = common_turns(words, start, n)
            if last is None:
                lcp[0] = UNKNOWN
            else:
                lcp, n = lcp[1:], n[1:]
            last = keys[-1].as_py()
            # a block is full before the row that would make it too large
            at = 0
            costs = np.cumsum(1 + n // 8)
            while at < len(lcp):
                spent = costs[at - 1] if at else 0
                to = 1 if lcp[at] == UNKNOWN else max(at + 1, int(np.searchsorted(costs, spent + limit - cost, side="right")))
                if cost and costs[to - 1] - spent + cost > limit:
                    yield flush()
                    continue
                held.append(batch.slice(at, to - at))
                lcps.append(lcp[at:to])
                cost += int(costs[to - 1] - spent)
                if lcp[at] == UNKNOWN and to < len(lcp):
                    yield flush()
                at = to
                if lcps and lcps[0][0] == UNKNOWN and at == len(lcp):
                    cost = limit  # the first row stays alone also if its batch ends with it
        if held:
            yield flush(True)

    return found.select("key", "points", "conv", "n", "ends").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, ROWS)


def _borders(batches):
    for batch in batches:
        before, keys, points = batch.column(1), batch.column(2), batch.column(3)
        out = []
        for a, b, p in zip(before.to_pylist(), keys.to_pylist(), points.to_pylist(), strict=True):
            if a is None:
                out.append((-1, sum(p)))
            else:
                shared = int(common_turns(*_turns(pa.array([a, b], pa.binary())))[1])
                out.append((shared, sum(p[shared:])))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))], names=["block", "b_lcp", "b_fresh"])


def bordered(rows: DataFrame) -> DataFrame:
    """``rows`` with the common turns of each partition's first row and the last of the partition
    before. Two rows a partition are compared, so the table that is broadcast has one."""
    ends = rows.where("key is not null").select("block", "key", "points", F.shiftright("block", 32).alias("part"))
    parts = sorted(r["part"] for r in ends.select("part").distinct().collect())
    before = ends.sparkSession.createDataFrame(list(zip(parts[1:], parts[:-1], strict=True)) or [(-1, -1)], "part bigint, previous bigint")
    last = ends.groupBy(F.col("part").alias("previous")).agg(F.max("key").alias("before"))
    first = ends.where("block = part * 4294967296L").join(F.broadcast(before), "part", "left").join(last, "previous", "left")
    found = first.select("block", "before", "key", "points").mapInArrow(_borders, "block bigint, b_lcp bigint, b_fresh bigint")
    out = rows.drop("key").join(F.broadcast(found), "block", "left")
    return out.withColumns({"lcp": F.coalesce("lcp", "b_lcp"), "fresh": F.when(F.col("b_fresh").isNotNull(), F.col("b_fresh")).otherwise(F.col("fresh"))}).drop("b_lcp", "b_fresh")


# --- values open at borders -----------------------------------------------------------


class Blocks:
    """One entry for each block of rows, in order: minima, sums before it, and its first L."""

    def __init__(self, rows: DataFrame):
        found = rows.groupBy("block").agg(
            F.min("lcp").alias("low"), F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("total")).alias("total"), F.sum("fresh").alias("fresh"),
            F.max_by("before_leaves", "pos").alias("leaves"), F.max_by("depth", "pos").alias("depth"), F.min_by("lcp", "pos").alias("first"),
        ).orderBy("block").collect()
        get = lambda name: np.array([r[name] for r in found], np.int64)
        self.ids, self.first = get("block"), np.append(get("first"), -1)
        leaves = get("leaves") + (get("depth") > self.first[1:])
        self.before = {k: np.concatenate([[0], np.cumsum(x)]) for k, x in (("n", get("n")), ("leaves", leaves), ("total", get("total")), ("fresh", get("fresh")))}
        self.low, self.conv = self._levels(get("low")), self._levels(get("conv"))

    @staticmethod
    def _levels(x: np.ndarray) -> list[np.ndarray]:
        """Minima of all runs of 1, 2, 4, ... blocks."""
        out = [x]
        while len(out[-1]) > 2 ** (len(out) - 1):
            k = 2 ** (len(out) - 1)
            out.append(np.minimum(out[-1][:-k], out[-1][k:]))
        return out

    def smaller(self, block: np.ndarray, value: np.ndarray, step: int) -> np.ndarray:
        """The nearest block before (step -1) or after (1) one whose minimum is below the value; -1 or
        the number of blocks where there is none."""
        at = block + step
        for k in reversed(range(len(self.low))):
            size, level = 2**k, self.low[k]
            begin = at - size + 1 if step < 0 else at
            inside = (begin >= 0) & (begin < len(level))
            skip = inside & (level[np.clip(begin, 0, len(level) - 1)] >= value)
            at = np.where(skip, at + step * size, at)
        return at

    def least_between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The smallest id in blocks a + 1 .. b - 1."""
        out = np.full(len(a), FAR)
        for i, (lo, hi) in enumerate(zip(a + 1, b, strict=True)):
            if lo < hi:
                k = int(hi - lo).bit_length() - 1
                out[i] = min(self.conv[k][lo], self.conv[k][hi - 2**k])
        return out


def _answers(rows: DataFrame, blocks: Blocks) -> DataFrame:
    """For each block what it can't know by itself, one row each: kind 'node' (a node that begins in
    the block and ends in another, all its counts), 'right' and 'left' (the smallest member of the
    node of the values ``v`` of the block that are open to that side) and 'next' (the same for the first
    value of the block after it)."""
    shared = rows.sparkSession.sparkContext.broadcast(blocks)
    end = len(blocks.ids)

    def targets(batches):
        b = shared.value
        for batch in batches:
            block, v, open_left, open_right = (np.asarray(batch.column(i)) for i in range(4))
            at = np.searchsorted(b.ids, block)
            to_left = np.where(open_left, b.smaller(at, v, -1), at)
            to_right = np.where(open_right, b.smaller(at, v, 1), at)
            ids = np.append(b.ids, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids[to_left]), pa.array(ids[to_right])], names=[*batch.schema.names, "to_left", "to_right"])

    is_open = F.col("left").isNull() | F.col("right").isNull()
    asked = rows.where(is_open & (F.col("lcp") >= 0)).groupBy("block", F.col("lcp").alias("v"), F.col("left").isNull().alias("open_left"), F.col("right").isNull().alias("open_right")).agg(F.count("*").alias("k"))
    asked = asked.mapInArrow(targets, "block bigint, v bigint, open_left boolean, open_right boolean, k bigint, to_left bigint, to_right bigint")
    asked = written(asked, "trie-asked")
    numbers = ["before_n", "before_leaves", "before_total", "before_fresh"]
    tails = rows.where("tail").select(F.col("block").alias("to_left"), F.col("pos").alias("l_pos"), F.col("lcp").alias("l_lcp"), F.col("depth").alias("l_depth"), "fresh", "min_from", "ends", *numbers)
    heads = rows.where("head").select(F.col("block").alias("to_right"), F.col("pos").alias("r_pos"), F.col("lcp").alias("r_lcp"), "min_before", *[F.col(c).alias(f"r_{c}") for c in numbers])
    key = ["block", "v", "open_left", "open_right"]
    lefts = asked.join(tails, "to_left").where("l_lcp < v").groupBy(*key).agg(F.max_by(F.struct("l_pos", "l_lcp", "l_depth", "fresh", "min_from", "ends", *numbers), "l_pos").alias("l"))
    rights = asked.join(heads, "to_right").where("r_lcp < v").groupBy(*key).agg(F.min_by(F.struct("r_pos", "r_lcp", "min_before", *[f"r_{c}" for c in numbers]), "r_pos").alias("r"))
    both = asked.join(lefts, key).join(rights, key, "left").select(*key, "k", "to_left", "to_right", "l.*", "r.*")

    def counted(batches):
        b = shared.value
        for batch in batches:
            x = {name: np.asarray(c.fill_null(0) if name.startswith("r_") or name == "min_before" else c) for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "ends"}
            a, ended = np.searchsorted(b.ids, x["to_left"]), x["to_right"] < 0
            z = np.where(ended, end, np.searchsorted(b.ids, x["to_right"]))
            over = {k: b.before[k][z] + np.where(ended, 0, x[f"r_before_{k}"]) - b.before[k][a] - x[f"before_{k}"] for k in ("n", "leaves", "total", "fresh")}
            least = np.minimum(np.minimum(x["min_from"], np.where(ended, FAR, x["min_before"])), b.least_between(a, z))
            up = np.where(ended, -1, x["r_lcp"])
            # the parent is the node of the larger of the two values at the borders
            side = np.where(x["l_lcp"] >= up, "right", "left")
            at = np.where(x["l_lcp"] >= up, x["to_left"], x["to_right"])
            columns = [x["block"], x["v"], x["open_left"], x["open_right"], x["k"], x["to_left"], x["l_pos"], x["l_depth"], over["n"], over["leaves"], over["total"], over["fresh"] - x["fresh"], least, np.maximum(x["l_lcp"], up), at, side]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(batch.schema.get_field_index("ends"))], names=COUNTED)

    nodes = written(both.mapInArrow(counted, ", ".join(f"{c} {'boolean' if c.startswith('open') else 'string' if c in ('p_side', 'ends') else 'bigint'}" for c in COUNTED)), "trie-nodes")
    sides = nodes.where("open_right").select("block", "v", F.lit("right").alias("side"), "least").unionByName(nodes.where("open_left").select("block", "v", F.lit("left").alias("side"), "least"))
    parents = sides.select(F.col("block").alias("p_block"), F.col("v").alias("p_v"), F.col("side").alias("p_side"), F.col("least").alias("p_conv"))
    one = nodes.groupBy(F.col("to_left").alias("block"), "l_pos", "v").agg(F.sum("k").alias("k"), *(F.first(c).alias(c) for c in COUNTED[7:]))
    one = one.join(parents, ["p_block", "p_v", "p_side"], "left")
    after = rows.sparkSession.createDataFrame([(int(a), int(z), int(v)) for a, z, v in zip(blocks.ids[:-1], blocks.ids[1:], blocks.first[1:-1], strict=True)] or [(-1, -1, -1)], "block bigint, p_block bigint, v bigint")
    after = after.join(parents.where("p_side = 'left'").withColumnRenamed("p_v", "v"), ["p_block", "v"]).select("block", "v", F.lit("next").alias("kind"), F.col("p_conv").alias("least"))
    given = sides.select("block", "v", F.col("side").alias("kind"), "least").unionByName(after)
    return given.unionByName(one.select("block", "v", F.lit("node").alias("kind"), "least", *ANSWER), allowMissingColumns=True).select("block", "v", "kind", "least", *ANSWER)


COUNTED = ["block", "v", "open_left", "open_right", "k", "to_left", "l_pos", "l_depth", "n", "leaves", "total", "fresh", "least", "p_v", "p_block", "p_side", "ends"]
ANSWER = ["l_pos", "k", "n", "leaves", "total", "fresh", "p_v", "p_conv"]


# --- nodes of a block -----------------------------------------------------------------

OUT = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


class _Least:
    """Minima of any run of an array."""

    def __init__(self, x: np.ndarray):
        self.levels = Blocks._levels(x)

    def of(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The minimum of a .. z, z included."""
        k = np.frexp((z - a + 1).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for j in np.unique(k):
            m = k == j
            out[m] = np.minimum(self.levels[j][a[m]], self.levels[j][z[m] - 2**j + 1])
        return out


def _nodes(rows: pa.Table, answers: pa.Table, next_lcp: int) -> pa.Table:
    """All nodes that begin in one block, with the missing depths put in."""
    rows = rows.sort_by("pos").combine_chunks()
    col = lambda name: np.asarray(rows.column(name))
    m, base = rows.num_rows, int(col("pos")[0]) if rows.num_rows else 0
    lcp, depth, conv, n, total, fresh = (col(x) for x in ("lcp", "depth", "conv", "n", "total", "fresh"))
    inner = lambda name: np.where(np.asarray(rows.column(name).is_null()), OPEN, np.asarray(rows.column(name).fill_null(0)) - base)
    left, right = inner("left"), inner("right")
    sums, start = _sums(rows.column("points").combine_chunks())
    ends = rows.column("ends").to_pylist()
    given = {kind: {} for kind in ("right", "left", "next")}
    crossing = []
    for a in answers.to_pylist():
        if a["kind"] == "node":
            crossing.append(a)
        else:
            given[a["kind"]][a["v"]] = a["least"]
    after = np.append(lcp[1:], next_lcp)
    leaf = depth > after
    upto = lambda x: np.concatenate([[0], np.cumsum(x)])
    s_n, s_leaf, s_total, s_fresh = upto(n), upto(leaf.astype(np.int64)), upto(n * total), upto(fresh)
    least = _Least(conv)
    # the smallest member of the node of each value
    closed = (left != OPEN) & (right != OPEN)
    own = np.zeros(m, np.int64)
    own[closed] = least.of(left[closed], right[closed] - 1)
    for i in np.flatnonzero(~closed & (lcp >= 0)):
        own[i] = given["right" if right[i] == OPEN else "left"][int(lcp[i])]
    own = np.append(own, given["next"].get(next_lcp, 0))
    # branching nodes inside: the same left border and value
    at = np.flatnonzero(closed)
    _, first, k = np.unique(np.stack([left[at], lcp[at]]), axis=1, return_index=True, return_counts=True)
    at = at[first]
    below, above, v = left[at], right[at], lcp[at]
    alone = np.flatnonzero(leaf)
    g = lambda name: np.array([a[name] for a in crossing], np.int64)
    join = lambda *x: np.concatenate([np.asarray(y, np.int64) for y in x])
    row = join(below, alone, g("l_pos") - base)
    last = join(above, alone + 1)  # exclusive, of those that end inside
    inside = len(last)
    r = row[:inside]
    v = join(v, depth[alone], g("v"))
    kids = join(k + 1, np.zeros(len(alone)), g("k") + 1)
    ended = depth[row] == v
    kids -= ended & (np.arange(len(row)) < len(below)) | ended & (np.arange(len(row)) >= inside)
    count = join(s_n[last] - s_n[r], g("n"))
    leaves = join(s_leaf[last] - s_leaf[r], g("leaves"))
    spent = join(s_total[last] - s_total[r], g("total"))
    new = join(s_fresh[last] - s_fresh[r + 1], g("fresh"))
    member = join(least.of(r, last - 1) if inside else [], [a["least"] for a in crossing])
    edge = np.append(lcp, next_lcp)
    larger = np.where(edge[r] >= edge[last], r, last)
    p_v = join(edge[larger], g("p_v"))
    p_conv = join(own[larger], [a["p_conv"] or 0 for a in crossing])
    # depths between parent and node
    steps = v - p_v
    i = np.repeat(np.arange(len(v)), steps)
    d = p_v[i] + 1 + np.arange(len(i)) - np.repeat(np.cumsum(steps) - steps, steps)
    before = sums[start[row[i]] + np.maximum(d - 1, 0)] - sums[start[row[i]]]  # code points above the node
    saved = spent[i] - count[i] * before - (total[row[i]] - before) - new[i]
    top = d == p_v[i] + 1
    bottom = d == v[i]
    here = [ends[row[j]] if b else NO_ENDS for j, b in zip(i, (bottom & ended[i]).tolist(), strict=True)]
    return pa.table(
        [pa.array(member[i]), pa.array(d), pa.array(np.where(top, p_conv[i], member[i]), mask=d == 0), pa.array(count[i]), pa.array(np.where(bottom, kids[i], 1)), pa.array(leaves[i]), pa.array(saved), pa.array(here, pa.string())],
        names=[x.split()[0] for x in OUT.split(", ")],
    )


def trie_of(convs: DataFrame, block: int | None = None) -> DataFrame:
    """The nodes of the trie of (conv_id, key, points); see ``prefix_trie``."""
    rows = written(ordered(classes(convs), block), "trie-rows")
    rows = written(bordered(rows), "trie-bordered")
    blocks = Blocks(rows)
    answers = written(_answers(rows, blocks), "trie-answers")
    after = rows.sparkSession.sparkContext.broadcast((blocks.ids, blocks.first[1:]))

    def nodes(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, firsts = after.value
        return _nodes(left, right, int(firsts[np.searchsorted(ids, left.column("block")[0].as_py())]))

    need = rows.select("block", "pos", "lcp", "depth", "left", "right", "conv", "n", "points", "ends", "total", "fresh")
    return need.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(nodes, OUT)


def prefix_trie(conversations: DataFrame, every: int = 100, most: int = 6, block: int | None = None) -> DataFrame:
    """One row for each different beginning (role and text of the first d turns) of the
    conversations as ``rebuilt`` makes them: (conv_id: smallest member, depth, parent_conv_id: null at
    the root, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Rows without conv_id belong to no conversation and are left out (of a negative one, the remainder
    is negative, as in SQL); null roles and texts are empty ones. Turns are ordered, null ones first; rows of one turn follow by a digest of role and text,
    so equal rows repeat. Conversations without turns are members of the root only. An empty table
    has no node. Other columns are not read. A text of any length is one digest; a conversation
    is one row of 20 bytes a turn, and the driver holds one entry for each block of
    65,536 different conversations.
    """
    bounded_batches(conversations.sparkSession)
    convs = written(rebuilt(conversations, every, most), "trie-conversations")
    return trie_of(convs, block)

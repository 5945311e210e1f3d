"""Repeated byte strings across and within documents, by a sparse suffix array.

A window is a string of ``length`` bytes. Its anchor is the position of the smallest hash of
16 bytes among its first ``reach`` positions, so equal windows have their anchors at equal
distances, and only suffixes that start at anchors need ordering (about one in 150). Windows
with one anchor are consecutive; the bytes they span are the anchor's context.

1. Anchors whose following bytes occur at one anchor only have no repeated window.
2. Anchors with equal contexts are repeated in all their windows.
3. Where contexts differ, the edges of repeats, the strings after and (backwards) before the
   anchors are put in suffix order by deep-shallow sorting: multikey quicksort to a shallow
   depth, then blind tries for the groups with longer common prefixes. The common prefixes
   of neighbours give the windows that another context holds too. Very large groups of
   contexts are instead split by the windows themselves and counted.

Passages of words that several documents hold (``passage_spans``) are found by anchors too: there a
window is a number of words, windows with one anchor are a run, and only runs that stand in one
document while several hold their anchor are taken apart into windows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, SpanHasher, bounded_batches, mix, text_chunks, with_checked_broadcast, word_spans, written, written_alone

GRAM = 16
CHUNK = 1_000_000
#: Words that are hashed at a time.
WORDS = 150_000
LARGE_GROUP = 8192
SHALLOW = 32


# --- deep-shallow sorting -------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, depth: int = 0) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[depth:n], "big") ^ int.from_bytes(b[depth:n], "big")
    return n if not x else n - (x.bit_length() + 7) // 8


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings and the common prefix of each with the next; all share their
    first ``depth`` bytes. Equal strings stay in their given order."""
    order: list[int] = []
    stack = [(list(range(len(strings))), depth)]
    stop = depth + shallow
    while stack:
        group, at = stack.pop()
        if len(group) == 1:
            order += group
        elif at >= stop:
            order += _blind_trie(strings, group, at)
        else:
            # multikey quicksort, eight bytes a key
            keys = [strings[i][at : at + 8] for i in group]
            pivot = keys[len(keys) // 2]
            less = [i for i, k in zip(group, keys, strict=True) if k < pivot]
            same = [i for i, k in zip(group, keys, strict=True) if k == pivot]
            more = [i for i, k in zip(group, keys, strict=True) if k > pivot]
            if more:
                stack.append((more, at))
            stack.append((same, at + 8) if len(pivot) == 8 else (sorted(same)[:1], at))
            if len(pivot) < 8 and len(same) > 1:  # strings that end here are equal
                stack[-1:] = [([i], at) for i in sorted(same, reverse=True)]
            if less:
                stack.append((less, at))
    lcp = [common_prefix(strings[a], strings[b], depth) for a, b in zip(order, order[1:], strict=False)]
    return order, lcp


class _Branch:
    __slots__ = ("depth", "child")

    def __init__(self, depth: int):
        self.depth, self.child = depth, {}


def _blind_trie(strings: list[bytes], group: list[int], depth: int) -> list[int]:
    """Order a group by a trie that holds branching depths and bytes only. A string goes down
    blindly to some leaf; one comparison with that leaf gives the depth where it leaves."""
    end = -1  # the edge of a string that ends at a branch, before all bytes
    byte = lambda i, d: strings[i][d] if d < len(strings[i]) else end
    root: _Branch | list[int] = [group[0]]
    for i in group[1:]:
        node = root
        while isinstance(node, _Branch):
            node = node.child.get(byte(i, node.depth)) or next(iter(node.child.values()))
        at = common_prefix(strings[i], strings[node[0]], depth)
        if at == len(strings[i]) == len(strings[node[0]]):
            node.append(i)
            continue
        edge, above, node = byte(i, at), None, root
        other = byte(_leaf(root), at)
        while isinstance(node, _Branch) and node.depth < at:
            above = (node, byte(i, node.depth))
            node = node.child[above[1]]
        other = byte(_leaf(node), at)
        if isinstance(node, _Branch) and node.depth == at:
            node.child[edge] = [i]
            continue
        branch = _Branch(at)
        branch.child = {other: node, edge: [i]}
        if above is None:
            root = branch
        else:
            above[0].child[above[1]] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Branch):
            stack += [node.child[k] for k in sorted(node.child, reverse=True)]
        else:
            out += node
    return out


def _leaf(node) -> int:
    while isinstance(node, _Branch):
        node = next(iter(node.child.values()))
    return node[0]


class _Minima:
    """Minimum of a list's range, by a table of powers of two."""

    def __init__(self, values: list[int]):
        self.rows = [values]
        while 2 ** len(self.rows) <= len(values):
            half, last = 2 ** (len(self.rows) - 1), self.rows[-1]
            self.rows.append([min(a, b) for a, b in zip(last, last[half:], strict=False)])

    def of(self, a: int, b: int) -> int:
        if a > b:
            a, b = b, a
        k = (b - a).bit_length() - 1
        return min(self.rows[k][a], self.rows[k][b - 2**k])


def shared_windows(befores: list[bytes], afters: list[bytes], length: int, known: int = 0) -> list[list[tuple[int, int]]]:
    """For each context, the distances [lo, hi] before its anchor at which a window of
    ``length`` bytes starts that some other context holds at the same distance.

    Contexts are merged bottom-up along the suffix order of what stands before the anchors
    (sets with an ever shorter common string), the smaller set into the larger; in a set, the
    neighbours in the suffix order of what stands after have the longest match on that side.
    """
    n = len(befores)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n < 2:
        return out
    order, right = deep_shallow(afters, known)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    after = _Minima(right)
    backwards, left = deep_shallow([b[::-1] for b in befores])
    home = list(range(n))
    sets: dict[int, list[int]] = {i: [rank[x]] for i, x in enumerate(backwards)}

    def top(i: int) -> int:
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    for at in sorted(range(n - 1), key=lambda i: -left[i]):
        a, b = top(at), top(at + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small, hi = sets[a], sets.pop(b), left[at]
        for r in small:
            p = bisect_left(large, r)
            for q in large[max(0, p - 1) : p + 1]:
                lo = length - after.of(r, q)
                if lo <= hi:
                    out[order[r]].append((lo, hi))
                    out[order[q]].append((lo, hi))
        for r in small:
            insort(large, r)
        home[b] = a
    return out


# --- anchors --------------------------------------------------------------------------


def window_minima(value: np.ndarray, reach: int, starts: int) -> np.ndarray:
    """The smallest of the ``reach`` values from each of the first ``starts`` positions on."""
    rows = -(-len(value) // reach) + 1
    padded = np.full(rows * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(value)] = value
    padded = padded.reshape(rows, reach)
    prefix = np.minimum.accumulate(padded, axis=1).ravel()
    suffix = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:starts], prefix[reach - 1 : reach - 1 + starts])


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, reach: int):
    """Anchors of all windows inside the documents of a chunk: (document, anchor, first and
    last window start), positions in the chunk."""
    n = len(buf)
    z = np.zeros(0, np.int64)
    if n < length:
        return z, z, z, z
    hasher = SpanHasher(buf)
    gram = mix((hasher.sums[GRAM:] - hasher.sums[:-GRAM]) * hasher.down[: n - GRAM + 1])
    value = (gram & U64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    starts = n - length + 1
    low = window_minima(value, reach, starts)
    anchor = (low & U64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)  # windows that end in their document
    size = np.diff(offs)
    long = np.flatnonzero(size >= length)
    np.add.at(inside, offs[long], 1)
    np.add.at(inside, offs[long] + size[long] - length + 1, -1)
    valid = np.cumsum(inside[:starts]) > 0
    s = np.flatnonzero(valid)
    if not len(s):
        return z, z, z, z
    a = anchor[s]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(s)]]) - 1
    return np.searchsorted(offs, s[new], side="right") - 1, a[new], s[new], s[last]


def _merged(doc, lo, hi):
    """Join consecutive intervals of window starts of one document."""
    if not len(doc):
        return doc, lo, hi
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] != hi[:-1] + 1)]))
    return doc[new], lo[new], hi[np.concatenate([new[1:], [len(doc)]]) - 1]


_ANCHORS = "doc_id bigint, s_lo bigint, s_hi bigint, anchor bigint, key bigint, context bigint, n bigint"


def _anchor_rows(docs: DataFrame, length: int, reach: int) -> DataFrame:
    """A row for each different context of a chunk, and (without key) a row for each interval
    of window starts whose context the chunk itself repeats."""
    names = [x.split()[0] for x in _ANCHORS.split(", ")]

    def rows(ids: pa.Array, buf: np.ndarray, offs: np.ndarray, base: int) -> pa.RecordBatch:
        doc, a, lo, hi = anchors(buf, offs, length, reach)
        one, two = SpanHasher(buf, 1), SpanHasher(buf, 2)
        key = one.of(a, a + length - reach + 1)
        # the distances belong to the context: a window's place in it must not differ
        context = mix(two.of(lo, hi + length) + (a - lo).astype(np.uint64) * U64(0x9E3779B97F4A7C15) + (hi - lo).astype(np.uint64))
        order = np.lexsort((context, key))
        k, c = key[order], context[order]
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])) if len(k) else order
        count = np.diff(np.concatenate([new, [len(k)]]))
        pick = order[new]
        times = np.repeat(count, count)
        again = np.sort(order[times > 1])
        d2, lo2, hi2 = _merged(doc[again], lo[again], hi[again])
        local = lambda x, d: x - offs[d] + base
        none = len(d2)
        doc_ids = pa.concat_arrays([ids.take(pa.array(doc[pick])), ids.take(pa.array(d2))])
        empty = pa.nulls(none, pa.int64())
        join = lambda x, y: pa.concat_arrays([pa.array(x), y])
        return pa.RecordBatch.from_arrays(
            [
                doc_ids, join(local(lo[pick], doc[pick]), pa.array(local(lo2, d2))), join(local(hi[pick], doc[pick]), pa.array(local(hi2, d2))),
                join(local(a[pick], doc[pick]), empty), join(key[pick].view(np.int64), empty), join(context[pick].view(np.int64), empty), join(count.astype(np.int64), empty),
            ],
            names=names,
        )

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, buf, offs in text_chunks(batch.column(1), CHUNK):
                own = ids.slice(at, len(offs) - 1)
                # a very long text in parts that overlap by all but one byte of a window
                for lo in range(0, max(1, len(buf) - length + 1), CHUNK):
                    part = buf[lo : lo + CHUNK + length - 1]
                    yield rows(own, part, offs if len(part) == len(buf) else np.array([0, len(part)]), lo)

    return docs.mapInArrow(run, _ANCHORS)


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted contexts, cut out of their documents."""
    per_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "total", "anchor", "s_lo", "s_hi", "large")).alias("cut"))

    def run(batches):
        for batch in batches:
            cut = batch.column(2)
            flat = cut.flatten()
            row = np.repeat(np.arange(len(cut)), np.diff(np.asarray(cut.offsets)))
            lo, hi = np.asarray(flat.field("s_lo")), np.asarray(flat.field("s_hi"))
            data = [x.as_py().encode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row))] + [flat.field(x) for x in ("key", "total", "anchor", "s_lo", "s_hi", "large")]
                + [pa.array([data[r][a : b + length] for r, a, b in zip(row, lo, hi, strict=True)], pa.binary())],
                names=["doc_id", "key", "total", "anchor", "s_lo", "s_hi", "large", "bytes"],
            )

    # texts are shuffled by doc_id at any size: what they are joined with grows with the repeats
    return docs.join(per_doc.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "cut").mapInArrow(
        run, "doc_id bigint, key bigint, total bigint, anchor bigint, s_lo bigint, s_hi bigint, large boolean, bytes binary"
    )


def _edges(contexts: DataFrame, length: int, reach: int) -> DataFrame:
    """Repeated windows of contexts that occur once, found in the group of their key."""

    def run(group: pa.Table) -> pa.Table:
        data = group["bytes"].to_pylist()
        doc, total = np.asarray(group["doc_id"]), np.asarray(group["total"])
        a, lo, hi = (np.asarray(group[x]) for x in ("anchor", "s_lo", "s_hi"))
        known = length - reach + 1
        # equal keys are equal bytes but for a collision of hashes, which parts here
        alike: dict[bytes, list[int]] = {}
        for i, (d, c) in enumerate(zip(data, (a - lo).tolist(), strict=True)):
            alike.setdefault(d[c : c + known], []).append(i)
        out = []
        for rows in alike.values():
            cut = [(data[i], int(a[i] - lo[i])) for i in rows]
            found = shared_windows([d[:c] for d, c in cut], [d[c:] for d, c in cut], length, known)
            out += [(doc[i], s, e) for i, spans in zip(rows, found, strict=True) if total[i] == 1 for x, y in spans if (s := max(a[i] - y, lo[i])) <= (e := min(a[i] - x, hi[i]))]
        return pa.table({"doc_id": pa.array([x[0] for x in out], pa.int64()), "s_lo": pa.array([x[1] for x in out], pa.int64()), "s_hi": pa.array([x[2] for x in out], pa.int64())})

    return contexts.groupBy("key").applyInArrow(run, "doc_id bigint, s_lo bigint, s_hi bigint")


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """The same for very large groups: every window is a key of its own and is counted."""

    def run(batches):
        for batch in batches:
            data = batch.column("bytes")
            for at, buf, offs in ((at, *x) for at, *x in _binary_chunks(data)):
                size = np.diff(offs) - length + 1
                row = np.repeat(np.arange(len(size)), size)
                s = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                begin = offs[row] + s
                one, two = SpanHasher(buf, 1).of(begin, begin + length), SpanHasher(buf, 2).of(begin, begin + length)
                take = pa.array(row + at)
                lo = np.asarray(batch.column("s_lo"))[row + at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("total").take(take), pa.array(lo + s), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    names=["doc_id", "total", "s", "h1", "h2"],
                )

    windows = contexts.select("doc_id", "total", "s_lo", "bytes").mapInArrow(run, "doc_id bigint, total bigint, s bigint, h1 bigint, h2 bigint")
    often = windows.groupBy("h1", "h2").agg(F.sum("total").alias("n")).where("n >= 2").select("h1", "h2")
    return windows.where("total = 1").join(often, ["h1", "h2"]).select("doc_id", F.col("s").alias("s_lo"), F.col("s").alias("s_hi"))


def _binary_chunks(column: pa.Array):
    size = np.array([len(x.as_py()) for x in column], np.int64)
    for at in range(0, len(column), 1000):
        part = column.slice(at, 1000)
        yield at, np.frombuffer(b"".join(part.to_pylist()), np.uint8), np.concatenate([[0], np.cumsum(size[at : at + 1000])])


# --- passages of words ----------------------------------------------------------------


def word_windows(buf: np.ndarray, offs: np.ndarray, words: int):
    """Yield (document, first byte, end, key, hash) of all windows of ``words`` words inside the
    documents of a chunk. The key is the smallest hash of a quarter of the window's words, in
    their order, so that equal windows have equal keys."""
    gram = max(1, words // 4)
    begin, end, doc = word_spans(buf, offs)
    for at in range(0, len(begin) - words + 1, WORDS):
        b, e, d = (x[at : at + WORDS + words - 1] for x in (begin, end, doc))
        n = len(b)
        own = SpanHasher(buf[b[0] : e[-1]]).of(b - b[0], e - b[0])
        up, down = SpanHasher._grown(n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[:n])])
        of = lambda size: mix((sums[size:] - sums[:-size]) * down[: n - size + 1])  # noqa: B023, E731
        grams = of(gram)
        low = window_minima((grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), words - gram + 1, n - words + 1)
        s = np.flatnonzero(d[: n - words + 1] == d[words - 1 :])
        yield d[s], b[s], e[s + words - 1], grams[(low[s] & U64(0xFFFFFFFF)).astype(np.int64)], of(words)[s]


def _passage_runs(docs: DataFrame, words: int) -> DataFrame:
    """A row for each run of windows of one key: its bytes from first word to last, and the hash
    of all its windows."""

    def run(batches):
        for batch in batches:
            for at, buf, offs in text_chunks(batch.column(1), CHUNK):
                for d, lo, hi, key, whole in word_windows(buf, offs, words):
                    if not len(d):
                        continue
                    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (d[1:] != d[:-1])]))
                    end = np.append(new[1:], len(d))
                    up, down = SpanHasher._grown(len(d) + 1)
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(whole * up[: len(d)])])
                    context = mix((sums[end] - sums[new]) * down[new])
                    base = offs[d[new]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(d[new] + at)), pa.array(lo[new] - base), pa.array(hi[end - 1] - base), pa.array(key[new].view(np.int64)), pa.array(context.view(np.int64))],
                        names=["doc_id", "lo", "hi", "key", "context"],
                    )

    return docs.mapInArrow(run, "doc_id bigint, lo bigint, hi bigint, key bigint, context bigint")


def _passage_windows(docs: DataFrame, runs: DataFrame, words: int) -> DataFrame:
    """The windows of the given runs, with all other columns of these, cut out of their documents."""
    names = [c for c in runs.columns if c not in ("doc_id", "lo", "hi")]
    per_doc = written(runs.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", *names)).alias("cut")), "word-cuts")
    cut = with_checked_broadcast(docs, per_doc, "doc_id", "inner", F.size("cut")).select("doc_id", "text", "cut")

    def run(batches):
        for batch in batches:
            flat = batch.column(2).flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch.column(2).offsets)))
            start, end = np.asarray(flat.field("lo")), np.asarray(flat.field("hi"))
            data = [x.as_py().encode() for x in batch.column(1)]
            pieces = pa.array([data[r][a:b] for r, a, b in zip(row, start, end, strict=True)], pa.binary())
            for at, buf, offs in _binary_chunks(pieces):
                for d, lo, hi, key, whole in word_windows(buf, offs, words):
                    move = start[d + at] - offs[d]
                    of = pa.array(d + at)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row[d + at])), pa.array(lo + move), pa.array(hi + move), pa.array(whole.view(np.int64)), *[flat.field(c).take(of) for c in names]],
                        names=["doc_id", "lo", "hi", "whole", *names],
                    )

    return cut.mapInArrow(run, "doc_id bigint, lo bigint, hi bigint, whole bigint" + "".join(f", {c} bigint" for c in names))


def passage_spans(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, lo, hi): bytes of one or more consecutive sequences of ``words`` words that some other
    document holds too; together all such bytes, with what stands between the words. Words are
    `[^\\x20\\x09-\\x0D]+`; runs and windows with equal hashes (64 bits of all words, 64 of a quarter of a
    window's) count as equal.

    A run that another document holds as a whole is shared in all its windows. Only where a run
    stands in one document alone, its windows are compared, with those of one document for
    each different run of their key."""
    docs = docs.select("doc_id", "text").where("text is not null")

    def several() -> DataFrame:
        made = written(_passage_runs(docs, words), "word-runs")
        keys = made.groupBy("key").agg((F.min("doc_id") < F.max("doc_id")).alias("several")).where("several").select("key")
        return made.join(keys, "key")

    again = written_alone(several, "word-again")
    held = again.groupBy("key", "context").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min(F.struct("doc_id", "lo", "hi")).alias("at"))
    held = written(held, "word-contexts")
    kinds = written(again.join(held.select("key", "context", "least", "most"), ["key", "context"]), "word-kinds")
    whole = kinds.where("least < most").select("doc_id", "lo", "hi")
    alone = kinds.where("least = most").select("doc_id", "lo", "hi", "key", "least", "most")
    mixed = held.groupBy("key").agg(F.min(F.col("least") < F.col("most")).alias("all")).where("not all").select("key")
    others = held.where("least < most").join(mixed, "key").select("at.*", "key", "least", "most")
    windows = written_alone(lambda: _passage_windows(docs, alone.unionByName(others), words), "word-windows")
    often = windows.groupBy("key", "whole").agg((F.min("least") < F.max("most")).alias("several")).where("several").select("key", "whole")
    edges = with_checked_broadcast(windows.where("least = most"), written(often, "word-often"), ["key", "whole"], "left_semi")
    return whole.unionByName(edges.select("doc_id", "lo", "hi"))


def shared_passages(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, lo, hi) of each single sequence of ``words`` words in ``passage_spans``."""
    return _passage_windows(docs, passage_spans(docs, words), words).select("doc_id", "lo", "hi")


def repeated(docs: DataFrame, length: int = 400, large_group: int = LARGE_GROUP, words: int | None = None) -> DataFrame:
    """(doc_id, spans): for each document with repeats, the intervals [s_lo, s_hi] of starts
    of windows of ``length`` bytes that start elsewhere too, in any document. With ``words``, the
    passages of so many words that other documents hold stand there as well, marked as
    ``passage``, as if they ended ``length`` bytes after s_hi."""
    reach = length - max(length // 4, GRAM) + 1
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    made = written(_anchor_rows(docs, length, reach), "anchors")
    at = made.where("key is not null")
    keys = at.groupBy("key").agg(F.sum("n").alias("all")).where("all >= 2").select("key")
    again = written(at.join(keys, "key"), "again")
    kind = again.groupBy("key").agg(F.expr("min(context) = max(context)").alias("pure"))
    again = written(again.join(kind, "key"), "kinds")
    pure = again.where("pure and n = 1").select("doc_id", "s_lo", "s_hi")
    mixed = again.where("not pure")
    total = mixed.groupBy("key", "context").agg(F.sum("n").alias("total"), F.min(F.struct("doc_id", "anchor", "s_lo", "s_hi")).alias("at"))
    total = written(total, "contexts")
    whole = mixed.where("n = 1").join(total.where("total >= 2").select("key", "context"), ["key", "context"]).select("doc_id", "s_lo", "s_hi")
    sizes = total.groupBy("key").agg(F.count("*").alias("contexts"), F.min("total").alias("least")).where("least = 1")
    wanted = total.join(sizes, "key").select("key", "total", "at.*", (F.col("contexts") > large_group).alias("large"))
    contexts = written(_contexts(docs, wanted, length), "contexts")
    edges = _edges(contexts.where("not large"), length, reach)
    found = made.where("key is null").select("doc_id", "s_lo", "s_hi").unionByName(pure).unionByName(whole).unionByName(edges).unionByName(_counted(contexts.where("large"), length))
    found = found.withColumn("passage", F.lit(False))
    if words:
        found = found.unionByName(passage_spans(docs, words).select("doc_id", F.col("lo").alias("s_lo"), (F.col("hi") - length).alias("s_hi"), F.lit(True).alias("passage")))
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("s_lo", "s_hi", "passage")).alias("spans"))


def _covered(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = 400, *, words: int | None = None, keep_passages: bool = False, with_text: bool = False, large_group: int = LARGE_GROUP, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere
    else in the table, the same document included; judged on the input. With ``words``, passages of
    so many words (or more) that another document holds too, however short, go as well; with
    ``keep_passages`` they stay and are only counted.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the
    remaining bytes, with ``words`` n_passage_bytes (bytes of the input that such passages cover,
    removed or not) and, if asked for, the remaining ``text`` (a character that a border
    cuts is dropped); ``carry`` names further columns to pass through. Null texts are empty; texts shorter than ``length`` lose nothing.
    Rows without doc_id are returned but neither searched nor changed. A doc_id should be
    unique: of repeated rows of one doc_id each loses what any of them must lose. An empty
    table gives an empty result; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    spans = written_alone(lambda: repeated(docs, length, large_group, words), "spans")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["n_passage_bytes"] * bool(words) + ["text"] * with_text
    kinds = [pa.string() if n in ("kept_sha256", "text") else pa.int64() for n in names]

    def run(batches):
        for batch in batches:
            out = []
            flat = batch.column(2).flatten()
            start, end = np.asarray(flat.field("s_lo")), np.asarray(flat.field("s_hi")) + length
            passage = flat.field("passage").to_numpy(zero_copy_only=False)
            borders = np.asarray(batch.column(2).offsets)
            borders = (borders - borders[0]).tolist()
            for i, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode()
                own = np.arange(borders[i], borders[i + 1])
                own = own[end[own] <= len(data)]
                kept, runs, covered = data, 0, 0
                if len(own):
                    passages = own[passage[own]]
                    cut = own[~passage[own]] if keep_passages else own
                    gone = _covered(len(data), start[cut], end[cut])
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + bool(len(gone) and gone[0])
                    covered = int(np.count_nonzero(_covered(len(data), start[passages], end[passages]))) if len(passages) else 0
                found = (len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest())
                out.append(found + (covered,) * bool(words) + (kept.decode("utf-8", "ignore"),) * with_text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)] + batch.columns[3:],
                names=["doc_id", *names, *[f"_{c}" for c in carry]],
            )

    schema = ", ".join(["doc_id bigint", *[f"{n} {'string' if t == pa.string() else 'bigint'}" for n, t in zip(names, kinds, strict=True)]])
    schema += "".join(f", `_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    texts = docs.select("doc_id", "text", *[F.col(c).alias(f"_{c}") for c in carry])
    columns = ["doc_id", "text", "spans", *[f"_{c}" for c in carry]]
    joined = texts.where("doc_id is not null").join(spans.hint("shuffle_hash"), "doc_id", "left").select(*columns)
    rest = texts.where("doc_id is null").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).select(*columns)
    return joined.unionByName(rest).mapInArrow(run, schema)

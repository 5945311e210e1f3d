"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each text becomes its set of distinct word shingles (64-bit hashes) and the k smallest of
   them, its sketch. Texts with equal sets form one class; the class's smallest id stands
   for it from here on.
2. Inverted lists of the retained values find overlaps. Two sets with Jaccard >= 0.8 share
   at least ``need(m)`` of their retained values, so a document that shares fewer with all
   others together is out, and it is enough to list its rarest ``shared - need + 1`` values
   (prefix filter): values that most documents hold are hardly ever listed. Lists are kept
   by size class, as the sizes of two such sets differ by a factor of 1.25 at most.
3. Round one compares each document with the smallest id of each of its lists, a number of
   pairs linear in the lists' length; the union-sketch estimate filters, the exact Jaccard of
   the full sets decides. Round two compares, in blocks, only members of one list that
   verified links have not yet brought together, and returns the links that join them. Both
   leave the same components as all pairs would.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, SpanHasher, bounded_batches, components, give_back, long_list, mix, text_chunks, with_checked_broadcast, word_spans, written

K = 32
BLOCK = 1024  # members of a list that are one block, fewer if their sets are large
SET_VALUES = 2_000_000  # hashes in all sets of a block
PAIRS = 65_536  # looked at together
SIZE_CLASS = math.log(1.2501)


def need(m, k: int = K):
    """Least number of common retained values for sketch size m at Jaccard 0.8. Small sets
    are kept whole, so that the overlap is at least 0.8 m; of larger ones the overlap of the
    sketches is hypergeometric with mean 0.8 k, and 0.5 k is 4.5 standard deviations below
    (a link of exactly 0.8 is missed 3 times in 100,000, a closer one less often)."""
    whole = F.ceil(m * F.lit(0.8))
    return F.when(m * F.lit(1.25) <= k, whole).otherwise(F.lit(k // 2)).cast("int")


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents of a chunk, and each document's count."""
    low = LOWER[buf]
    hasher = SpanHasher(low)
    start, end, doc = word_spans(low, offs)
    h = hasher.of(start, end)
    n_docs = len(offs) - 1
    per_doc = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    sets = []
    rolled = h.copy()
    for j in range(1, words):
        rolled = mix(rolled[: len(h) - j] * U64(0xD6E8FEB86659FD93) + h[j:]) if len(h) > j else h[:0]
    counts = np.zeros(n_docs, np.int64)
    for d in range(n_docs):
        a, b = first[d], first[d + 1]
        if b - a >= words:
            s = rolled[a : b - words + 1].copy()
        elif b > a:
            s = h[a : a + 1]
            for x in h[a + 1 : b]:
                s = mix(s * U64(0xD6E8FEB86659FD93) + x)
            s = mix(s + U64(b - a))  # shorter sequences never equal a shingle
        else:
            continue
        s.sort()
        s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        counts[d] = len(s)
        sets.append(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), counts


def _sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at, buf, offs in text_chunks(batch.column(1)):
                sets, counts = shingle_sets(buf, offs, words)
                ends = np.cumsum(counts)
                kept = np.minimum(counts, k)
                index = np.repeat(ends - counts, kept) + np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
                one = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sets)])
                two = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets + U64(1)))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(counts)), pa.array(counts),
                        pa.array((one[ends] - one[ends - counts]).view(np.int64)),
                        pa.array((two[ends] - two[ends - counts]).view(np.int64)),
                        long_list(sets[index], kept),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "sketch"],
                )

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sketch array<bigint>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at, buf, offs in text_chunks(batch.column(1)):
                sets, counts = shingle_sets(buf, offs, words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(counts)), long_list(sets, counts)], names=["doc_id", "set"]
                )

    return docs.mapInArrow(run, "doc_id bigint, set array<bigint>")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()


def _sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    return written(_sets(with_checked_broadcast(docs, written(ids, "ids"), "doc_id", "left_semi"), words), "sets")


def _rows(column: pa.Array) -> list[np.ndarray]:
    """Views of a list<int64> column's rows as uint64."""
    offs = np.asarray(column.offsets)
    values = np.asarray(column.values).view(np.uint64)
    return [values[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """How many of the k smallest values of the union are in both sketches."""
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    distinct = np.concatenate([[True], ~twice])
    upto = np.cumsum(distinct)
    return int(np.count_nonzero(twice & (upto[1:] <= k)))


def _least(m: int, k: int) -> int:
    return int(np.ceil(m * 0.8 - 1e-9)) if m * 1.25 <= k else k // 2


def _estimated(pairs: DataFrame, sketches: DataFrame, k: int) -> DataFrame:
    """The pairs (u, v) whose union-sketch estimate does not rule out a Jaccard of 0.8."""
    left = sketches.select(F.col("doc_id").alias("u"), F.col("sketch").alias("su"))
    right = sketches.select(F.col("doc_id").alias("v"), F.col("sketch").alias("sv"))

    def run(batches):
        for batch in batches:
            a, b = _rows(batch.column(2)), _rows(batch.column(3))
            keep = [union_estimate(x, y, k) >= max(_least(len(x), k), _least(len(y), k)) for x, y in zip(a, b, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(right, "v").join(left, "u").select("u", "v", "su", "sv").mapInArrow(run, "u bigint, v bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("u"), F.col("set").alias("su"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("set").alias("sv"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(_rows(batch.column(2)), _rows(batch.column(3)), strict=True):
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(right, "v").join(left, "u").select("u", "v", "su", "sv").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each distinct doc_id.

    Links join documents whose shingle sets have a Jaccard similarity of at least
    ``percent`` / 100 (80 or more: the retained overlaps are set for that). ``component_id``
    is the smallest id reachable, ``kept`` marks it. Texts with fewer than ``words`` words
    are one shingle; null, empty and blank texts have none and link with nothing. Repeated
    rows of one doc_id count as one document (their first text in binary order); rows
    without doc_id are left out. An empty table gives an empty result.
    """
    if percent < 80:
        raise ValueError("retained overlaps are set for similarities of 80 % and more")
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    made = written(_sketches(docs, words, k), "sketches")
    if not made.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = written(docs.groupBy("doc_id").agg(F.min("text").alias("text")), "documents")
        made = written(_sketches(docs, words, k), "sketches")

    classes = made.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    member = written(
        made.join(classes, ["n_shingles", "d1", "d2"]).select(
            "doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("sketch")).alias("sketch")
        ),
        "classes",
    )
    reps = member.where("sketch is not null").select("doc_id", "n_shingles", "sketch")

    # inverted lists of retained values that at least two classes hold
    posting = reps.select("doc_id", "n_shingles", F.explode("sketch").alias("value"))
    held = posting.groupBy("value").agg(F.count("*").alias("df")).where("df >= 2")
    m = F.least(F.first("n_shingles"), F.lit(k)).cast("int")
    rare = (
        posting.join(held, "value")
        .groupBy("doc_id")
        .agg(F.first("n_shingles").alias("n_shingles"), m.alias("m"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"))
        .withColumn("need", need(F.col("m"), k))
        .where(F.size("found") >= F.col("need"))
        .withColumn("own", F.floor(F.log("n_shingles") / F.lit(SIZE_CLASS)).cast("int"))
        .select("doc_id", "own", F.transform(F.slice("found", F.lit(1), F.size("found") - F.col("need") + 1), lambda x: x["value"]).alias("listed"))
    )
    chosen = written(rare, "values")
    rare = chosen.select("doc_id", F.explode("listed").alias("value"), "own").select(
        "doc_id", "value", F.explode(F.array(F.col("own") - 1, F.col("own"))).alias("size_class")
    )
    key = ["value", "size_class"]
    lists = rare.groupBy(*key).agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n >= 2")
    in_lists = written(rare.join(lists, key), "lists")

    pairs = in_lists.where("doc_id <> hub").select(F.col("hub").alias("u"), F.col("doc_id").alias("v")).distinct()
    pairs = written(_estimated(pairs, reps, k), "pairs")
    sets = _sets_of(docs, _ids(pairs), words)
    linked = written(_verified(pairs, sets, percent), "links")
    final = written(components(linked), "components")

    # what a list still holds apart: compared in blocks, across components only
    label = in_lists.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        *key, "doc_id", F.coalesce("component", "doc_id").alias("label")
    )
    apart = label.groupBy(*key).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi").select(*key, "n")
    near = written(_across(label.join(apart, key), reps.join(chosen, "doc_id"), k), "near")
    if not near.isEmpty():
        more = _sets_of(docs, near.select("doc_id").distinct().join(_ids(pairs), "doc_id", "left_anti"), words)
        late = _linked_across(near.join(sets.unionByName(more), "doc_id"), percent)
        stars = final.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        final = written(components(stars.unionByName(late)), "components")
    final = final.select(F.col("node").alias("rep"), "component")

    out = member.select("doc_id", "rep").join(final, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    return (
        made.select("doc_id", "n_shingles")
        .join(out, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def _across(label: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """Members of a list that pass the union-sketch estimate with a member of another label. A
    list of more than BLOCK members is cut into blocks and every pair of blocks is a group.
    Only the first list that both are on looks at a pair. Not the pairs are returned but the
    members, once for each group, so that rows never grow with the square of a list. A list's sets are of
    like sizes, so that its size class bounds the bytes of a block."""
    largest = F.exp((F.col("size_class") + 2) * F.lit(SIZE_CLASS))
    members = F.least(F.lit(BLOCK), F.greatest(F.floor(F.lit(SET_VALUES) / largest), F.lit(1)))
    blocks = F.greatest(F.ceil(F.col("n") / members), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = (
        label.withColumn("blocks", blocks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("value", "size_class", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "doc_id", "label")
        .join(chosen.select("doc_id", "sketch", "listed", "own"), "doc_id")
    )

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, labels, mine, own = (np.asarray(group[c]) for c in ("doc_id", "label", "mine", "own"))
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        this, size_class = np.int64(group["value"][0].as_py()), group["size_class"][0].as_py()
        sketches = _rows(group["sketch"].chunk(0))
        least = np.array([_least(len(s), k) for s in sketches])
        values, column = np.unique(np.concatenate(sketches), return_inverse=True)
        columns = _padded(column, [len(s) for s in sketches], len(values))
        lists = _rows(group["listed"].chunk(0))
        listed = _padded(np.concatenate(lists).view(np.int64), [len(x) for x in lists], np.iinfo(np.int64).max)
        # the commonest label's members need no comparison among themselves
        names, count = np.unique(labels, return_counts=True)
        from_ = np.flatnonzero(labels != names[count.argmax()])
        inner = np.zeros(len(ids), bool)
        inner[from_] = True
        mark = np.zeros(len(values) + 1, np.uint8)
        found = np.zeros(len(ids), bool)

        def settle(u: np.ndarray, v: np.ndarray) -> None:
            first = (own[u] != own[v]) | (own[u] == size_class)
            u, v = u[first], v[first]
            for at in range(0, len(u), 8192):
                a, b = listed[u[at : at + 8192]], listed[v[at : at + 8192]]
                earlier = ((a[:, :, None] == b[:, None, :]) & (a < this)[:, :, None]).any(axis=(1, 2))
                for i, j in zip(u[at : at + 8192][~earlier].tolist(), v[at : at + 8192][~earlier].tolist(), strict=True):
                    if not (found[i] and found[j]) and union_estimate(sketches[i], sketches[j], k) >= max(least[i], least[j]):
                        found[i] = found[j] = True

        us, vs, waiting = [], [], 0
        for r in from_:
            mark[columns[r]] = 1
            mark[-1] = 0
            overlap = mark[columns].sum(axis=1)  # bounds the union sketch's from above
            mark[columns[r]] = 0
            near = np.flatnonzero((overlap >= np.maximum(least, least[r])) & (labels != labels[r]))
            if lo != hi:
                near = near[mine[near] != mine[r]]
            near = near[(~inner[near] | (near > r)) & ~(found[r] & found[near])]  # each pair once
            us.append(np.full(len(near), r))
            vs.append(near)
            waiting += len(near)
            if waiting >= PAIRS:
                settle(np.concatenate(us), np.concatenate(vs))
                us, vs, waiting = [], [], 0
        if waiting:
            settle(np.concatenate(us), np.concatenate(vs))
        out = group.select(["value", "size_class", "lo", "hi", "mine", "doc_id", "label"]).filter(pa.array(found))
        if len(ids) > BLOCK // 4:
            del us, vs, columns, listed, group
            give_back()
        return out

    return rows.groupBy("value", "size_class", "lo", "hi").applyInArrow(
        run, "value bigint, size_class int, lo int, hi int, mine int, doc_id bigint, label bigint"
    )


def _linked_across(near: DataFrame, percent: int) -> DataFrame:
    """Links between members of different labels of one group, exact by their full sets: not
    all of them, but a forest that joins what they join."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, labels, mine = (np.asarray(group[c]) for c in ("doc_id", "label", "mine"))
        apart = group["lo"][0].as_py() != group["hi"][0].as_py()
        sets = _rows(group["set"].chunk(0))
        size = np.array([len(x) for x in sets])
        first = np.cumsum(size) - size
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(values), np.int32)
        names, count = np.unique(labels, return_counts=True)
        home = dict(zip(names.tolist(), names.tolist(), strict=True))

        def top(x):
            while home[x] != x:
                home[x] = home[home[x]]
                x = home[x]
            return x

        u, v = [], []
        for r in np.flatnonzero(labels != names[count.argmax()]):
            mine_ = column[first[r] : first[r] + size[r]]
            mark[mine_] = 1
            common = np.add.reduceat(mark[column], first)
            mark[mine_] = 0
            link = (100 * common >= percent * (size + size[r] - common)) & (labels != labels[r])
            if apart:
                link &= mine != mine[r]
            for j in np.flatnonzero(link).tolist():
                x, y = top(labels[r].item()), top(labels[j].item())
                if x != y:
                    home[max(x, y)] = min(x, y)
                    u.append(ids[r])
                    v.append(ids[j])
        if len(ids) > BLOCK // 4:
            del sets, values, column, mark, group
            give_back()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return near.groupBy("value", "size_class", "lo", "hi").applyInArrow(run, "u bigint, v bigint")


def _padded(flat: np.ndarray, sizes: list[int], fill: int) -> np.ndarray:
    out = np.full((len(sizes), max(sizes)), fill, np.int64)
    out[np.arange(out.shape[1])[None, :] < np.array(sizes)[:, None]] = flat
    return out

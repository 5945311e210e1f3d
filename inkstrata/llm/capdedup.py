"""Near-duplicate embeddings by spherical-cap filters.

Filter directions form a product code: the space, randomly rotated, is cut into parts, each
with its own random unit codewords, and a direction is one codeword of every part. A vector
belongs to the filters whose inner product with it exceeds a threshold; they are listed by
going through the parts' codewords in order of inner product and leaving off as soon as the
rest cannot reach it. Vectors are joined on filters and verified exactly.
"""

from __future__ import annotations

from math import erfc, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, written
from .vectors import matrix, usable

BLOCK = 1024
AT_LEAST = 24
LUMP = 4096
OTHERS = 0.1
HEIGHTS = (3.0, 4.75)


class ProductCode:
    """``size`` codewords in each of two parts; directions are pairs of codewords."""

    def __init__(self, dim: int, size: int, height: float):
        rng = np.random.default_rng(17)
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.half, self.size = dim - dim // 2, size
        self.books = []
        for d in (self.half, dim - self.half):
            c = rng.normal(size=(size, max(d, 1)))
            self.books.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        # inner products with a direction have standard deviation 1 / sqrt(dim)
        self.threshold = height / np.sqrt(dim)

    def filters(self, x: np.ndarray) -> list[np.ndarray]:
        """Sorted ids of all filters that each unit vector exceeds; a vector that exceeds fewer
        than AT_LEAST (its halves are of very unequal length) gets its best AT_LEAST."""
        y = x @ self.rotation
        left = y[:, : self.half] @ self.books[0].T / np.sqrt(2)
        rest = y[:, self.half :]
        right = rest @ self.books[1].T / np.sqrt(2) if rest.shape[1] else np.zeros((len(x), self.size))
        out = []
        for a, b in zip(left, right, strict=True):
            by_b = np.argsort(-b)
            down = b[by_b]
            # a codeword of the first part is worth its longest run in the second's order
            run = np.searchsorted(-down, a - self.threshold, side="right")
            used = np.flatnonzero(run)
            if run.sum() >= AT_LEAST:
                ids = np.concatenate([i * self.size + by_b[: run[i]] for i in used])
            else:
                # the best are sums of the best of both parts
                by_a, by_b = np.argsort(-a)[:AT_LEAST], by_b[:AT_LEAST]
                both = (a[by_a, None] + b[None, by_b]).ravel()
                best = np.argpartition(-both, min(AT_LEAST, len(both)) - 1)[:AT_LEAST]
                ids = by_a[best // len(by_b)] * self.size + by_b[best % len(by_b)]
            out.append(np.sort(ids))
        return out


def height_for(n: int) -> float:
    """The filters' threshold, in standard deviations of a random inner product, at which a filter
    that one of n vectors exceeds holds OTHERS unrelated ones on average; within bounds that keep
    the number of codewords small."""
    share = min(max(OTHERS / max(n, 1), _tail(HEIGHTS[1])), _tail(HEIGHTS[0]))
    return NormalDist().inv_cdf(1 - share)


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.93, height: float | None = None, expected: int = 40) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each distinct vec_id.

    Vectors of one label (not null) are linked where their cosine in double precision is at
    least ``least``. ``height`` is the filters' threshold in standard deviations of a random
    inner product (default: by the size of the largest label, so that few unrelated vectors
    meet) and ``expected`` how many filters a vector exceeds on average; together they give the
    number of directions, expected / P(normal > height). Of two vectors with cosine 0.93 the
    second exceeds a filter of the first with probability 0.55 at a height of 3 and 0.36 at
    4.75, so that a pair meets in more than 10 filters on average.

    Filters are joined as numbers; vectors are sent only to filters that another vector of their
    label exceeds too. Null, zero and non-finite vectors, those of another length than most, and
    those without label link with nothing. Equal vectors of one label are one class from the
    start and are counted, not expanded. Repeated rows of one vec_id count once (smallest label
    and vector); an empty table gives an empty result; other columns are not read.
    """
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").where("vec_id is not null")
    ids = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x")).select("vec_id", "x.label", "x.embedding")
    ids = written(ids, "vectors")
    good = usable(ids.where("label is not null"))
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    some = classes.select(F.size("embedding").alias("n")).first()
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    height = height_for(largest) if height is None else height
    code = ProductCode(some["n"] if some else 1, int(np.ceil(np.sqrt(expected / _tail(height)))), height)
    shared = vectors.sparkSession.sparkContext.broadcast(code)

    def spread(batches):
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                x = matrix(part.column(1))
                found = shared.value.filters(x / np.linalg.norm(x, axis=1, keepdims=True))
                offs = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, part.column(2)], names=["rep", "filters", "label"])

    label = classes.schema["label"].dataType.simpleString()
    exceeded = written(classes.select("rep", "embedding", "label").mapInArrow(spread, f"rep bigint, filters array<int>, label {label}"), "filters")
    # which filters a vector shares with another: numbers only
    each = exceeded.select("rep", "label", F.explode("filters").alias("filter"))
    sizes = each.groupBy("label", "filter").agg(F.count("*").alias("n")).where("n >= 2")
    met = each.join(sizes, ["label", "filter"]).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("filter", "n"))).alias("met"))
    met = written(met.withColumn("filters", F.col("met")["filter"]), "met")
    total = met.agg(F.sum(F.size("met"))).first()[0] or 0
    # A filter with many vectors is cut into blocks and each pair of blocks is a group; filters
    # with few are put together into groups of about LUMP rows.
    both = F.xxhash64("label", "filter")
    grouped = (
        met.join(classes, "rep").withColumn("x", F.explode("met")).select("label", "rep", "copies", "embedding", "filters", "x.*")
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
        .withColumn("lump", F.when(F.col("blocks") > 1, both).otherwise(F.pmod(both, F.lit(max(1, total // LUMP)))))
        .drop("n", "blocks", "other")
    )
    found = grouped.groupBy("lump", "lo", "hi").applyInArrow(_verify(least), "u bigint, v bigint, n bigint")
    found = written(found, "found")
    near = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("near"))
    joined = components(found.where("v is not null").select("u", "v")).select(F.col("node").alias("rep"), "component")
    member = good.join(classes, ["label", "embedding"]).select("vec_id", "rep", "copies")
    out = (
        member.join(near, "rep", "left").join(joined, "rep", "left")
        .select("vec_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    return (
        ids.select("vec_id").join(out, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def _tail(z: float) -> float:
    return erfc(z / sqrt(2)) / 2


def _verify(least: float):
    """Of the filters of one group: (u, null, n): u's linked vectors that meet it here first,
    counted with copies; and (u, v, 0): links that join what this group links, no more than its
    rows."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        mine, rep, copies, filters = (np.asarray(group[c]) for c in ("mine", "rep", "copies", "filter"))
        labels = np.unique(np.asarray(group["label"]), return_inverse=True)[1]
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        x = matrix(group["embedding"])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        lists = group["filters"].chunk(0)
        offs, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        order = np.lexsort((filters, labels))
        cut = np.flatnonzero((np.diff(filters[order]) != 0) | (np.diff(labels[order]) != 0)) + 1
        us, vs, ns = [], [], []
        for rows in np.split(order, cut):
            if len(rows) < 2:
                continue
            a, b = (rows, rows) if lo == hi else (rows[mine[rows] == lo], rows[mine[rows] == hi])
            close = x[a] @ x[b].T >= least
            if lo == hi:
                close = np.triu(close, 1)
            if not close.any():
                continue
            i, j = np.nonzero(close)
            i, j = a[i], b[j]
            # count a pair in the first filter that holds both
            this = filters[rows[0]]
            size = offs[rows + 1] - offs[rows]
            before = np.full((len(rows), int(size.max())), -1, np.int32)
            at = np.zeros(len(rep), np.int64)
            at[rows] = np.arange(len(rows))
            for r in rows:
                f = flat[offs[r] : offs[r + 1]]
                f = f[f < this]
                before[at[r], : len(f)] = f
            first = np.ones(len(i), bool)
            for k in range(0, len(i), 4096):
                s = slice(k, k + 4096)
                left, right = before[at[i[s]]], before[at[j[s]]]
                first[s] = ~((left[:, :, None] == right[:, None, :]) & (left >= 0)[:, :, None]).any(axis=(1, 2))
            n = np.bincount(i[first], copies[j[first]], len(rep)) + np.bincount(j[first], copies[i[first]], len(rep))
            some = np.flatnonzero(n)
            us.append(rep[some])
            vs.append(np.full(len(some), -1))
            ns.append(n[some].astype(np.int64))
            # smallest member of each component by repeated minima over its links
            low = np.arange(len(rep))
            while True:
                new = low.copy()
                np.minimum.at(new, i, low[j])
                np.minimum.at(new, j, low[i])
                new = new[new]
                if (new == low).all():
                    break
                low = new
            joined = np.flatnonzero(low != np.arange(len(rep)))
            us.append(rep[joined])
            vs.append(low[joined])
            ns.append(np.zeros(len(joined), np.int64))
        u, v, n = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs, ns))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(rep[np.maximum(v, 0)] if len(v) else v, pa.int64(), mask=v < 0), "n": pa.array(n, pa.int64())})

    return run

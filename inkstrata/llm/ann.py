"""Approximate nearest neighbours: an inverted file of coarse centroids with
product-quantised residuals, asymmetric distance tables and exact reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .vectors import matrix, usable

PARTS = 16
CODES = 256
BLOCK = 4096
SLICE = 16_384  # rows of vectors handled at once


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


def _lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    different = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    c = different[rng.choice(len(different), min(k, len(different)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Index:
    """Coarse centroids and residual codebooks, fitted on a sample; encodes any vector."""

    def __init__(self, sample: np.ndarray, cells: int, parts: int = PARTS, rounds: int = 8):
        rng = np.random.default_rng(5)
        self.cells = _lloyd(sample, cells, rounds, rng)
        rest = sample - self.cells[_nearest(sample, self.cells)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))
        self.books = [_lloyd(rest[:, cut], CODES, rounds, rng) for cut in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.cells)
        rest = x - self.cells[cell]
        return cell, np.stack([_nearest(rest[:, cut], book) for cut, book in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)

    def order(self, x: np.ndarray, held: np.ndarray) -> np.ndarray:
        """For each row the cells that hold vectors (``held``: how many each), nearest first."""
        full = np.flatnonzero(held)
        d = (self.cells[full] ** 2).sum(axis=1)[None, :] - 2 * x @ self.cells[full].T
        return full[np.argsort(d, axis=1, kind="stable")]

    def probes(self, x: np.ndarray, held: np.ndarray, cells: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the nearest ``cells`` that hold vectors, and on to where they hold ``least``."""
        order = self.order(x, held)
        before = np.cumsum(held[order], axis=1) - held[order]
        row, at = np.nonzero((np.arange(order.shape[1]) < cells) | (before < least))
        return row, order[row, at]

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that the codes of one cell stand for."""
        return self.cells[cell] + np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded vectors of one cell, from the queries' tables."""
        rest = queries - self.cells[cell]
        total = np.zeros((len(queries), len(codes)))
        for m, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            own = rest[:, cut]
            table = (own * own).sum(axis=1)[:, None] - 2 * own @ book.T + (book * book).sum(axis=1)
            total += table[:, codes[:, m]]
        return np.maximum(total, 0, out=total)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows, summed in order, as equal vectors must tie."""
    out = [np.sqrt(np.cumsum((x[i : i + SLICE] - y[i : i + SLICE]) ** 2, axis=1)[:, -1]) for i in range(0, len(x), SLICE)]
    return np.concatenate(out) if out else np.zeros(0)


def _first_k(row: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k smallest (distance, id) of each row, row by row."""
    order = np.lexsort((ids, d, row))
    new = np.concatenate([[True], row[order][1:] != row[order][:-1]]) if len(order) else np.zeros(0, bool)
    at = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[at < k]


def scanned(index: Index, cell: int, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, asked: np.ndarray, queries: np.ndarray, k: int):
    """(query, id, distance) of the k nearest of one cell's vectors to each query. A table
    distance is off by the candidate's quantisation error at most: all candidates that can be
    among the k nearest are ranked exactly."""
    off = np.sqrt(((vectors - index.decode(cell, codes)) ** 2).sum(axis=1))
    off += 1e-6 * (1 + off)
    out = []
    step = max(1, SLICE * 16 // len(ids))
    for low in range(0, len(asked), step):
        q, x = asked[low : low + step], queries[low : low + step]
        d = np.sqrt(index.distances(x, cell, codes))
        other = ids[None, :] != q[:, None]
        near = other
        if len(ids) > k + 1:
            most = np.partition(np.where(other, d + off, np.inf), k - 1, axis=1)[:, k - 1]  # k are no farther
            near = other & (d - off <= most[:, None])
        row, at = np.nonzero(near)
        exact = np.concatenate([np.zeros(0), *(_exact(vectors[at[i : i + SLICE]], x[row[i : i + SLICE]]) for i in range(0, len(row), SLICE))])
        best = _first_k(row, exact, ids[at], k)
        out.append((q[row[best]], ids[at[best]], exact[best]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _nearest_of_all(codes: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> list:
    """(query, cell) of the k nearest of all vectors to a few queries: one pass over the table."""
    shared = codes.sparkSession.sparkContext.broadcast((queries, ids))

    def run(batches):
        x, own = shared.value
        held: list[tuple] = []
        for batch in batches:
            y, other, cell = matrix(batch.column(2)), np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for low in range(0, len(y), SLICE):
                part, name = y[low : low + SLICE], other[low : low + SLICE]
                d = (x * x).sum(axis=1)[:, None] - 2 * x @ part.T + (part * part).sum(axis=1)
                d[own[:, None] == name[None, :]] = np.inf
                at = np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, :k]
                row = np.repeat(np.arange(len(x)), at.shape[1])
                held.append((row, d[row, at.ravel()], name[at.ravel()], cell[low : low + SLICE][at.ravel()]))
                row, dist, name, where = (np.concatenate(z) for z in zip(*held, strict=True))
                best = _first_k(row, dist, name, k)
                held = [(row[best], dist[best], name[best], where[best])]
        if held:
            row, dist, name, where = held[0]
            yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(dist), pa.array(name), pa.array(where)], names=["query_id", "d", "vec_id", "cell"])

    found = codes.select("vec_id", "cell", "embedding").mapInArrow(run, "query_id bigint, d double, vec_id bigint, cell int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return found.where("d < double('infinity')").withColumn("r", rank).where(F.col("r") <= k).select("query_id", "cell").collect()


def cells_to_search(index: Index, codes: DataFrame, held: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: int, recall: float) -> int:
    """How many cells a query has to search so that the share ``recall`` of the true k nearest is
    in them, measured on the given queries against all vectors."""
    order = index.order(queries, held)
    place = np.zeros((len(ids), len(held)), np.int64)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    row = {q: i for i, q in enumerate(ids.tolist())}
    found = sorted(int(place[row[r["query_id"]], r["cell"]]) for r in _nearest_of_all(codes, queries, ids, k))
    return found[min(len(found) - 1, int(np.ceil(recall * len(found))))] + 1 if found else 1


def search(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, *, every: int = 100, max_sample: int = 16_384,
    max_cells: int = 4096, recall: float = 0.96, measured: int = 256, probed: float | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by Euclidean
    distance in double precision on the original vectors, ties to the smaller vec_id.

    ``queries`` (default: the rows whose vec_id is divisible by ``every``) are searched for
    in all ``vectors`` but themselves. Every vector is indexed; centroids (square root of the
    number of vectors, at most ``max_cells``) and codebooks are fitted on at most
    ``max_sample`` vectors chosen by a hash. Each query searches its nearest ``probed`` share of
    the cells that hold vectors, and on until they hold k candidates. By default it is measured:
    the fewest cells that hold the share ``recall`` of the true nearest of ``measured`` queries,
    which are compared with all vectors in one pass; clustered vectors need few cells, unclustered
    ones of 64 dimensions most. Within the searched cells nothing is lost: all candidates that
    can be among the k nearest by table distance and quantisation error are ranked exactly.
    A cell with many vectors or queries is cut into blocks of both.

    Vectors that are null, zero, not finite or of another length than most take no part,
    neither as queries nor as candidates. Repeated rows of one vec_id count once. An empty table
    gives an empty result; fewer than k candidates give fewer rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    good = usable(vectors.select("vec_id", "embedding")).dropDuplicates(["vec_id"])
    good = written(good.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), "vectors")
    asked = good.where(F.col("vec_id") % every == 0) if queries is None else usable(queries.select("vec_id", "embedding"))
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    n = good.count()
    few = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(measured).toArrow()
    if not n or not len(few):
        return spark.createDataFrame([], schema)
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).select("embedding").toArrow()
    index = Index(matrix(sample["embedding"]), int(max(1, min(max_cells, n**0.5))))
    shared = spark.sparkContext.broadcast(index)

    def encode(batches):
        for batch in batches:
            for low in range(0, len(batch), SLICE):
                part = batch.slice(low, SLICE)
                cell, codes = shared.value.encode(matrix(part.column(1)))
                width = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
                data = pa.BinaryArray.from_buffers(pa.binary(), len(codes), [None, width.buffers()[1], pa.py_buffer(np.ascontiguousarray(codes).tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cell.astype(np.int32)), data, part.column(1)], names=["vec_id", "cell", "code", "embedding"])

    codes = written(good.mapInArrow(encode, "vec_id bigint, cell int, code binary, embedding array<double>"), "codes")
    counts = codes.groupBy("cell").count().collect()  # a row for each cell: at most max_cells
    held = np.zeros(len(index.cells), np.int64)
    held[[r["cell"] for r in counts]] = [r["count"] for r in counts]
    if probed is None:
        searched = cells_to_search(index, codes, held, matrix(few["embedding"]), np.asarray(few["vec_id"]), k, recall)
    else:
        searched = int(np.ceil(probed * np.count_nonzero(held)))

    def probe(batches):
        for batch in batches:
            for low in range(0, len(batch), SLICE // 8):
                part = batch.slice(low, SLICE // 8)
                row, cells = shared.value.probes(matrix(part.column(1)), held, searched, k + 1)  # the query may be one of them
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(cells.astype(np.int32))], names=["query_id", "cell"])

    wanted = written(asked.mapInArrow(probe, "query_id bigint, cell int"), "probes")
    # both sides of a cell are cut into blocks, and every block meets every block of the other side
    load = dict(wanted.groupBy("cell").count().collect())  # a row for each cell
    sizes = [(c, -(-int(held[c]) // BLOCK), -(-load.get(c, 0) // BLOCK)) for c in np.flatnonzero(held).tolist()]
    blocks = F.broadcast(spark.createDataFrame(sizes, "cell int, blocks int, others int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = codes.join(blocks, "cell").where("others > 0").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).withColumn("other", upto("others")).drop("blocks", "others")
    right = (
        wanted.join(blocks, "cell").withColumn("other", F.pmod(F.xxhash64("query_id"), "others").cast("int")).withColumn("block", upto("blocks")).drop("blocks", "others")
        .join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "query_id")
    )

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        z = np.zeros(0, np.int64)
        found = (z, z, np.zeros(0))
        if len(left) and len(right):
            ids = np.asarray(left["vec_id"].combine_chunks())
            code = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            found = scanned(shared.value, left["cell"][0].as_py(), ids, code, matrix(left["embedding"]), np.asarray(right["query_id"].combine_chunks()), matrix(right["query"]), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    key = ["cell", "block", "other"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(scan, "query_id bigint, vec_id bigint, score double")
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

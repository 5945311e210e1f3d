"""Quality scores: random Fourier features over document statistics, ridge regression from
partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, SpanHasher, bounded_batches, fold, long_list, mix, text_chunks, word_spans, written

NAMES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "bang", "bar", "stop", "comma", "other_punct", "non_ascii",
    "space", "newline", "distinct_words", "top_word", "distinct_pairs", "repeated_lines", "line_bytes", "capital_words", "long_words",
]
D = 256
SEED = 11


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_CLASSES = [
    _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b"!"), _class(b"|"), _class(b".?"), _class(b",;:"),
    _class(b"\"#$%&'()*+-/<=>@[\\]^_`{}~"), _class(bytes(range(128, 256))), _class(b" \t\v\f\r"), _class(b"\n"),
]


def _runs(doc: np.ndarray, h: np.ndarray, n: int):
    """Number of different values, and the most frequent one's count, for each document."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])) if len(d) else order
    count = np.diff(np.concatenate([new, [len(d)]]))
    top = np.zeros(n)
    np.maximum.at(top, d[new], count)
    return np.bincount(d[new], minlength=n), top


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The statistics of NAMES for each document of a chunk; 0 where there is nothing."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    per = np.maximum(size, 1)
    share = []
    for c in _CLASSES:
        run = np.concatenate([[0], np.cumsum(c[buf], dtype=np.int64)])
        share.append((run[offs[1:]] - run[offs[:-1]]) / per)
    hasher = SpanHasher(buf)
    s, e, doc = word_spans(buf, offs)
    words = np.bincount(doc, minlength=n).astype(float)
    at_least = np.maximum(words, 1)
    h = hasher.of(s, e)
    distinct, top = _runs(doc, h, n)
    same = doc[1:] == doc[:-1]
    pairs = mix(h[:-1] * U64(0xD6E8FEB86659FD93) + h[1:])[same] if len(h) else h
    distinct_pairs, _ = _runs(doc[1:][same], pairs, n)
    ls, le, ldoc = word_spans(buf, offs, buf != 10)
    lh = hasher.of(ls, le)
    order = np.lexsort((lh, ldoc))
    again = order[1:][(lh[order][1:] == lh[order][:-1]) & (ldoc[order][1:] == ldoc[order][:-1])] if len(order) else order
    repeated = np.bincount(ldoc[again], (le - ls)[again], n) / per
    capital = np.bincount(doc, (buf[s] >= 65) & (buf[s] <= 90), n) / at_least if len(s) else np.zeros(n)
    long = np.bincount(doc, e - s > 15, n) / at_least if len(s) else np.zeros(n)
    letters = np.bincount(doc, e - s, n) / at_least if len(s) else np.zeros(n)
    log_words = np.log1p(words)
    return np.stack(
        [
            np.log1p(size), log_words, letters, share[0], share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8], share[9],
            np.log1p(distinct) / np.maximum(log_words, 1e-9), top / at_least, np.log1p(distinct_pairs) / np.maximum(log_words, 1e-9),
            repeated, np.log1p(size / np.maximum(np.bincount(ldoc, minlength=n), 1)), capital, long,
        ],
        axis=1,
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<double>): one map over the texts."""

    def run(batches):
        for batch in batches:
            for at, buf, offs in text_chunks(batch.column(1)):
                x = statistics(buf, offs)
                flat = long_list(np.ascontiguousarray(x).ravel().view(np.uint64), np.full(len(x), x.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(x)), pa.ListArray.from_arrays(flat.offsets, pa.array(x.ravel()))], names=["doc_id", "stats"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, stats array<double>")


class Model:
    """Standardised statistics -> random Fourier features -> ridge -> isotonic curve."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1)
        self.w = rng.normal(size=(len(mean), D - 1)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, D - 1)
        self.coef = np.zeros(D)
        self.curve = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), np.sqrt(2 / D) * np.cos(z @ self.w + self.b)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.coef

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.curve)


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted x with weights n and sums y; a curve to interpolate."""
    blocks: list[list[float]] = []  # first x, last x, weight, sum
    for a, w, s in zip(x, n, y, strict=True):
        blocks.append([a, a, w, s])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, hi, w2, s2 = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + w2, blocks[-1][3] + s2]
    xs = [v for b in blocks for v in (b[0], b[1])]
    ys = [v for b in blocks for v in (b[3] / b[2],) * 2]
    return np.array(xs), np.array(ys)


def _array(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def fit(train: DataFrame, ridge: float = 1e-3) -> Model:
    """From rows (stats, y): nothing but sums of a fixed size reaches the driver."""
    width = len(NAMES)
    x = [F.col("stats")[i] for i in range(width)]
    moments = train.agg(F.count("*").alias("n"), *[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    n = moments[0]
    clean = lambda v: np.array([u or 0.0 for u in v])
    model = Model(clean(moments[1 : 1 + width]), clean(moments[1 + width :]))
    if not n:
        model.curve = (np.array([0.0]), np.array([0.5]))
        return model
    shared = train.sparkSession.sparkContext.broadcast(model)

    def sums(batches):
        total = np.zeros((D, D + 1))
        for batch in batches:
            z = shared.value.features(_array(batch.column(0), width))
            total += z.T @ np.concatenate([z, np.asarray(batch.column(1), dtype=float)[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(D), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(D + 1, dtype=np.int32) * (D + 1)), pa.array(total.ravel()))], names=["i", "row"]
        )

    def added(group: pa.Table) -> pa.Table:
        rows = group["row"].combine_chunks()
        total = _array(rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows, D + 1).sum(axis=0)
        return pa.table({"i": group["i"].slice(0, 1), "row": pa.array([total], pa.list_(pa.float64()))})

    # a row of the equations from each partition, added up row by row
    rows = train.select("stats", "y").mapInArrow(sums, "i int, row array<double>").groupBy("i").applyInArrow(added, "i int, row array<double>").collect()
    both = np.stack([r["row"] for r in sorted(rows, key=lambda r: r["i"])])
    model.coef = np.linalg.solve(both[:, :D] + ridge * n * np.diag([0.0] + [1.0 / D] * (D - 1)) + 1e-9 * np.eye(D), both[:, D])

    fitted = train.sparkSession.sparkContext.broadcast(model)

    def raw(batches):
        for batch in batches:
            step = np.round(np.clip(fitted.value.raw(_array(batch.column(0), width)), -1, 2) * 1024).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column(1).cast(pa.int64())], names=["step", "y"])

    # at most 3,073 steps
    steps = train.select("stats", "y").mapInArrow(raw, "step bigint, y bigint").groupBy("step").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("step").collect()
    model.curve = isotonic(np.array([r["step"] / 1024 for r in steps]), np.array([float(r["n"]) for r in steps]), np.array([float(r["y"]) for r in steps]))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns ``labels.quality`` from rows whose crc32(doc_id) mod 5 is not 0; null labels and
    labels without a document are left out, of several labels of one doc_id the largest
    counts. Null and empty texts have all statistics 0 and are scored like any other. With
    nothing to learn from every score is 0.5. Repeated rows repeat; an empty table gives an
    empty one; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    # statistics (160 bytes a document) are written once, for learning and for scoring
    stats = written(document_statistics(docs), "stats")
    wanted = labels.where(F.col("quality").isNotNull() & (fold("doc_id", 5) != 0))
    y = wanted.groupBy(F.col("doc_id").alias("doc_id")).agg(F.max("quality").alias("y"))
    train = written(stats.join(y, "doc_id").select("stats", F.col("y").cast("double").alias("y")), "training")
    model = docs.sparkSession.sparkContext.broadcast(fit(train))

    def run(batches):
        for batch in batches:
            score = np.clip(model.value.score(_array(batch.column(2), len(NAMES))), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    rows = stats.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "stats")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")

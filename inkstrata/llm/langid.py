"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces (forward algorithm), a text's
the product over its words. The probabilities are learned by expectation maximisation
(forward-backward) on a bounded, hash-chosen sample of labelled texts of each language.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import parse_ranks
from .common import BROADCAST_ITEMS, LOWER, U64, SpanHasher, bounded_batches, fold, text_chunks, word_spans, worker_cache, written

UNKNOWN = "und"
SHORT = 24  # bytes; of longer words logarithms are summed
CELLS = 250_000  # positions times words handled at once
SMOOTH = 0.05
REMEMBERED = 2_000_000  # numbers: word scores times languages


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z, and the capital letters of Latin-1 in UTF-8, in lower case."""
    low = LOWER[buf]
    if len(low) > 1:
        second = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[second] += 0x20
    return low


class Pieces:
    """The vocabulary as an open-addressing table of hashes."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {bytes([i]) for i in range(256)}
        for t in ranks:
            t = lowered(np.frombuffer(t.lstrip(b" "), np.uint8)).tobytes()
            if t and not any(x in t for x in b" \t\n\v\f\r"):
                found.add(t)
        pieces = sorted(found)
        self.n = len(pieces)
        size = np.array([len(p) for p in pieces])
        self.lengths = np.unique(size)  # in bytes, from 1 on
        ends = np.cumsum(size)
        h = SpanHasher(np.frombuffer(b"".join(pieces), np.uint8)).of(ends - size, ends)
        self.bits = 18
        self.mask = U64(2**self.bits - 1)
        self.keys, self.at = np.zeros(2**self.bits, np.uint64), np.full(2**self.bits, -1, np.int32)
        self.probes = 1
        for i, x in enumerate(h.tolist()):
            slot, tries = x & (2**self.bits - 1), 1
            while self.at[slot] >= 0:
                slot, tries = (slot + 1) & (2**self.bits - 1), tries + 1
            self.keys[slot], self.at[slot] = x, i
            self.probes = max(self.probes, tries)

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = h & self.mask
        out = np.where(self.keys[slot] == h, self.at[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.at[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + U64(1)) & self.mask
            s = slot[open_]
            hit = self.keys[s] == h[open_]
            out[open_[hit]] = self.at[s[hit]]
            open_ = open_[~hit & (self.at[s] >= 0)]
        return out

    def lattice(self, hasher: SpanHasher, start: np.ndarray, n: int):
        """(i, j, rows, pieces): the words (all of n bytes) that have a piece from i to j."""
        for i in range(n):
            for j in (i + self.lengths[self.lengths <= n - i]).tolist():
                piece = self.find(hasher.of(start + i, start + j))
                rows = np.flatnonzero(piece >= 0)
                if len(rows):
                    yield i, j, rows, piece[rows]


def chain(pieces: Pieces, prob: np.ndarray, hasher: SpanHasher, start: np.ndarray, size: np.ndarray, backward: bool = False, keep: bool = False) -> np.ndarray:
    """log of the sum over all segmentations of words of any length, from the longest to the
    shortest, for each word and language; with ``keep`` for each number of first (``backward``:
    last) bytes. Sums of logarithms, as products over long words underflow."""
    rows, langs, n = len(start), prob.shape[1], int(size[0])
    with np.errstate(divide="ignore"):
        log_prob = np.log(np.vstack([prob, np.zeros((1, langs))]))  # the last row: no such piece
    lengths = pieces.lengths
    around = int(lengths[-1]) + 1  # as many sums are looked back at
    near = np.full((around, rows, langs), -np.inf)
    near[0] = 0
    log = np.zeros((rows, langs))
    kept = np.zeros((n + 1, rows, langs)) if keep else log
    back = lengths[:, None]
    step = max(1, CELLS // (len(lengths) * rows))
    for low in range(0, n, step):
        j = np.arange(low + 1, min(n, low + step) + 1)[:, None, None]
        held = (back <= j) & (j <= size)
        first = start + size - j if backward else start + j - back
        first = np.broadcast_to(first, held.shape)[held]
        piece = np.full(held.shape, -1)
        piece[held] = pieces.find(hasher.of(first, first + np.broadcast_to(back, held.shape)[held]))
        for at in range(len(j)):
            now = low + 1 + at
            m = int(np.searchsorted(-size, -now, side="right"))
            terms = near[(now - lengths) % around, :m] + log_prob[piece[at, :, :m]]
            top = terms.max(axis=0)
            log[:m] = near[now % around, :m] = top + np.log(np.exp(terms - top).sum(axis=0))
            if keep:
                kept[now, :m] = log[:m]
    return kept


def batches_by_size(size: np.ndarray):
    """Rows of words over SHORT bytes, from the longest to the shortest, in bounded batches."""
    rows = np.flatnonzero(size > SHORT)
    rows = rows[np.argsort(-size[rows], kind="stable")]
    while len(rows):
        n = max(1, CELLS // int(size[rows[0]]))
        yield rows[:n]
        rows = rows[n:]


def log_sums(pieces: Pieces, prob: np.ndarray, hasher: SpanHasher, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations, for each word and language; prob: piece, language."""
    out = np.zeros((len(start), prob.shape[1]))
    size = end - start
    for rows in batches_by_size(size):
        out[rows] = chain(pieces, prob, hasher, start[rows], size[rows])
    for n in np.unique(size[size <= SHORT]):
        group = np.flatnonzero(size == n)
        for rows in np.array_split(group, max(1, len(group) * int(n) * prob.shape[1] // 2_000_000)):
            alpha = np.zeros((n + 1, len(rows), prob.shape[1]))
            alpha[0] = 1
            for i, j, r, p in pieces.lattice(hasher, start[rows], int(n)):
                alpha[j, r] += alpha[i, r] * prob[p]
            out[rows] = np.log(alpha[n])
    return out


def long_counts(pieces: Pieces, prob: np.ndarray, hasher: SpanHasher, start: np.ndarray, size: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts of pieces in long words, from the longest to the shortest."""
    expected = np.zeros(pieces.n)
    before = chain(pieces, prob[:, None], hasher, start, size, keep=True)[:, :, 0]
    after = chain(pieces, prob[:, None], hasher, start, size, backward=True, keep=True)[:, :, 0]
    for r, n in enumerate(size.tolist()):
        for k in pieces.lengths[pieces.lengths <= n].tolist():
            i = np.arange(n - k + 1)
            piece = pieces.find(hasher.of(start[r] + i, start[r] + i + k))
            i, piece = i[piece >= 0], piece[piece >= 0]
            part = np.exp(before[i, r] + after[n - i - k, r] - before[n, r]) * prob[piece]
            np.add.at(expected, piece, part * weight[r])
    return expected


def learn(pieces: Pieces, texts: pa.Array, rounds: int = 3) -> np.ndarray:
    """Piece probabilities of one language by forward-backward over its different words."""
    words: dict[bytes, int] = {}
    for _, buf, offs in text_chunks(texts):
        low = lowered(buf)
        start, end, _ = word_spans(low, offs)
        if len(start):
            _, at, count = np.unique(SpanHasher(low).of(start, end), return_index=True, return_counts=True)
            data = low.tobytes()
            for s, e, c in zip(start[at].tolist(), end[at].tolist(), count.tolist(), strict=True):
                words[data[s:e]] = words.get(data[s:e], 0) + c
    size = np.array([len(w) for w in words], np.int64)
    weight = np.array(list(words.values()), float)
    ends = np.cumsum(size)
    start = ends - size
    hasher = SpanHasher(np.frombuffer(b"".join(words), np.uint8))
    prob = np.full(pieces.n, 1 / pieces.n)
    for _ in range(rounds):
        expected = np.zeros(pieces.n)
        for rows in batches_by_size(size):
            expected += long_counts(pieces, prob, hasher, start[rows], size[rows], weight[rows])
        for n in np.unique(size[size <= SHORT]):
            rows = np.flatnonzero(size == n)
            edges = list(pieces.lattice(hasher, start[rows], int(n)))
            alpha, beta = np.zeros((n + 1, len(rows))), np.zeros((n + 1, len(rows)))
            alpha[0], beta[n] = 1, 1
            for i, j, r, p in edges:
                alpha[j, r] += alpha[i, r] * prob[p]
            for i, j, r, p in reversed(edges):
                beta[i, r] += beta[j, r] * prob[p]
            for i, j, r, p in edges:
                part = alpha[i, r] * prob[p] * beta[j, r] / alpha[n, r] * weight[rows[r]]
                expected += np.bincount(p, part, pieces.n)
        prob = (expected + SMOOTH) / (expected.sum() + SMOOTH * pieces.n)
    return prob


def _pieces(data: bytes) -> Pieces:
    return worker_cache(("pieces", hash(data)), lambda: Pieces(parse_ranks(data)))


def sample_texts(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text): of every language its ``per_language`` different texts with the smallest
    hashes, all if there are fewer; copies count once."""
    docs = docs.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    keys = written(docs.select("lang", "h").distinct(), "texts")
    # a row for each language; only hashes in the lowest part, which holds twice as many as are wanted, are ranked
    part = keys.groupBy("lang").agg((2 * per_language / F.count("*")).alias("part"))
    low = keys.join(F.broadcast(part), "lang").where((F.pmod("h", F.lit(1 << 40)) < F.col("part") * (1 << 40)) | (F.col("part") >= 1))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h"))
    chosen = written(low.withColumn("r", rank).where(F.col("r") <= per_language).select("lang", "h"), "chosen")
    small = chosen.withColumnRenamed("lang", "_lang").withColumnRenamed("h", "_h")
    if small.count() <= BROADCAST_ITEMS:
        small = F.broadcast(small)
    found = docs.join(small, (F.col("lang") == F.col("_lang")) & (F.col("h") == F.col("_h")), "left_semi")
    return found.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, vocabulary: bytes, per_language: int = 1500):
    """(languages, probabilities) from rows with text, lang: every language that has a text
    is learned, from at most ``per_language`` different texts."""
    spark = docs.sparkSession
    sample = sample_texts(docs, per_language)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(group: pa.Table) -> pa.Table:
        prob = learn(_pieces(shared.value), group["text"].combine_chunks())
        return pa.table({"lang": group["lang"].slice(0, 1), "prob": pa.array([prob.astype(np.float32).tobytes()], pa.binary())})

    rows = sorted(sample.select("lang", "text").groupBy("lang").applyInArrow(run, "lang string, prob binary").collect())
    return [r["lang"] for r in rows], np.stack([np.frombuffer(r["prob"], np.float32) for r in rows], axis=1) if rows else np.zeros((0, 0), np.float32)


class _Scorer:
    """Scores the words of batches; word scores are remembered by hash, in sorted arrays."""

    def __init__(self, vocabulary: bytes, prob: np.ndarray):
        self.pieces, self.prob = Pieces(parse_ranks(vocabulary)), prob.astype(float)
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, prob.shape[1]))

    def words(self, hasher: SpanHasher, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = hasher.of(start, end)
        h, at, back = np.unique(h, return_index=True, return_inverse=True)
        slot = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        known = self.keys[slot] == h if len(self.keys) else np.zeros(len(h), bool)
        value = np.empty((len(h), self.prob.shape[1]))
        value[known] = self.values[slot[known]]
        new = np.flatnonzero(~known)
        if len(new):
            value[new] = log_sums(self.pieces, self.prob, hasher, start[at[new]], end[at[new]])
            if (len(self.keys) + len(new)) * (1 + self.prob.shape[1]) > REMEMBERED:
                self.keys, self.values = h, value
            else:
                keys = np.concatenate([self.keys, h[new]])
                order = np.argsort(keys, kind="stable")
                self.keys, self.values = keys[order], np.concatenate([self.values, value[new]])[order]
        return value[back]

    def score(self, column: pa.Array):
        """(row, log-probabilities by language, has a letter) of runs of rows."""
        for at, buf, offs in text_chunks(column):
            low = lowered(buf)
            start, end, doc = word_spans(low, offs)
            total = np.zeros((len(offs) - 1, self.prob.shape[1]))
            if len(start):
                # a sum for each document: what one holds does not touch the others
                value = self.words(SpanHasher(low), start, end)
                for c in range(total.shape[1]):
                    total[:, c] = np.bincount(doc, value[:, c], len(total))
            ascii_ = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
            letter = ascii_[offs[1:]] > ascii_[offs[:-1]]
            for d in np.flatnonzero(~letter & (np.diff(offs) > 0)):
                letter[d] = any(map(str.isalpha, buf[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "ignore")))
            yield at, total, letter


def identify(docs: DataFrame, vocabulary_path: str, *, training: DataFrame | None = None, per_language: int = 1500, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    Learns from the rows of ``docs`` with a language whose crc32(doc_id) mod 3 is not 1 (or
    from ``training``: text, lang). ``score`` is the posterior of the predicted language
    among the learned ones, each equally likely beforehand; ties go to the first in code
    point order. ``carry`` names further columns to pass through. A null text, one without a letter, or any text when no language was learned
    is ``und`` with score 0. Rows are scored one by one: repeated rows repeat, an empty table
    gives an empty one, very long texts are scored whole, other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()
    if training is None:
        training = docs.where(fold("doc_id", 3) != 1)
    languages, prob = train(training, vocabulary, per_language)
    model = docs.sparkSession.sparkContext.broadcast((vocabulary, languages, prob))
    run_id = uuid.uuid4().hex

    def run(batches):
        vocabulary, languages, prob = model.value
        scorer = worker_cache(("languages", run_id), lambda: _Scorer(vocabulary, prob)) if languages else None
        for batch in batches:
            if not languages:
                n = len(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), *batch.columns[3:]], names=names)
                continue
            for at, total, letter in scorer.score(batch.column(2)):
                best = total.argmax(axis=1)
                post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                found = [languages[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)]
                part = batch.slice(at, len(best))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(np.where(letter, post, 0.0)), *part.columns[3:]], names=names
                )

    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text", *[F.col(c).alias(f"_{c}") for c in carry])
    names = ["doc_id", "held_out", "lang_pred", "score", *[f"_{c}" for c in carry]]
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double" + "".join(f", `_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, schema)

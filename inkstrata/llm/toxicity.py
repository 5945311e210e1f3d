"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence's probability is logistic in the words (and
word beginnings) it holds, and the document's is the noisy-or of its sentences. Only
documents have labels; the fit of the noisy-or to them finds which sentences offend.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, SpanHasher, bounded_batches, fold, text_chunks, word_spans, written
from .langid import lowered

BITS = 18
PREFIXES = (4, 5, 6, 7)  # bytes; compounds and inflections share their beginnings
FEATURES = 512

#: Letters are A-z, the apostrophe inside words is not, all UTF-8 above ASCII is.
LETTER = np.zeros(256, bool)
LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
#: What ends a sentence.
STOP = np.zeros(256, bool)
STOP[list(b".!?\n\r")] = True


def sentence_words(buf: np.ndarray, offs: np.ndarray):
    """Sentences (start, end, document) and word features (sentence, bucket) of a chunk."""
    low = lowered(buf)
    s_start, s_end, s_doc = word_spans(low, offs, ~STOP[low])
    start, end, _ = word_spans(low, offs, LETTER[low])
    if not len(start):
        z = np.zeros(0, np.int64)
        return (s_start, s_end, s_doc), (z, z)
    sentence = np.searchsorted(s_start, start, side="right") - 1
    hasher = SpanHasher(low, 3)
    buckets, where = [(hasher.of(start, end) >> U64(64 - BITS)).astype(np.int64)], [sentence]
    for n in PREFIXES:
        long = np.flatnonzero(end - start > n)
        # another hash than the whole word of the same bytes
        buckets.append(((hasher.of(start[long], start[long] + n) * U64(0xD6E8FEB86659FD93)) >> U64(64 - BITS)).astype(np.int64))
        where.append(sentence[long])
    return (s_start, s_end, s_doc), (np.concatenate(where), np.concatenate(buckets))


def fit_noisy_or(sentence_doc: np.ndarray, row: np.ndarray, feature: np.ndarray, y: np.ndarray, n_features: int, rounds: int = 400, l2: float = 1e-5):
    """Weights and bias by Adam on the documents' log-likelihood. sentence_doc: document of each
    sentence; (row, feature): which sentence holds which feature."""
    w, b = np.full(n_features, 2.0), -6.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    n_docs = len(y)
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[feature], len(sentence_doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(sentence_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n_docs)  # log P(no sentence)
        clean = np.clip(np.exp(none), 1e-9, 1 - 1e-9)
        # d loss / d none: 1 - P(no sentence) is the document's probability; d none / d z = -p
        slope = np.where(y > 0, clean / (1 - clean), -1.0)
        g = -slope[sentence_doc] * p / n_docs
        grad = np.concatenate([np.bincount(feature, g[row], n_features), [g.sum()]])
        grad[:-1] += l2 * w
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000):
    """(weight by bucket, bias) from at most ``max_rows`` labelled documents, chosen by a hash among
    those that are there; one row of each doc_id, the smallest text."""
    labels = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    labels = labels.join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi")
    sample = labels.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(max_rows)
    # a bounded table: max_rows rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = written(rows.select("text", "y"), "labelled")

    def count(batches):
        total = np.zeros((2, 2**BITS), np.int64)
        for batch in batches:
            y = np.asarray(batch.column(1))
            for at, buf, offs in text_chunks(batch.column(0)):
                (_, _, s_doc), (row, bucket) = sentence_words(buf, offs)
                both = np.unique(s_doc[row] << BITS | bucket)
                for k in (0, 1):
                    mine = both[y[at + (both >> BITS)] == k] & (2**BITS - 1)
                    total[k] += np.bincount(mine, minlength=2**BITS)
        used = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], names=["bucket", "clean", "toxic"])

    counts = rows.select("text", "y").mapInArrow(count, "bucket bigint, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    weights = np.zeros(2**BITS, np.float32)
    if not n.get(1) or not n.get(0):
        return weights, -20.0 if not n.get(1) else 20.0
    # a smoothed log-odds in standard deviations; the features that speak for toxicity most
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    score = (F.log(a / (n[1] + 1 - a + 0.5)) - F.log(b / (n[0] + 1 - b + 0.5))) / F.sqrt(1 / a + 1 / b)
    best = counts.where("toxic >= 2").withColumn("z", score).where("z > 2.5").orderBy(F.desc("z"), "bucket").limit(FEATURES).collect()
    if not best:
        return weights, float(np.log(n[1] / n[0]))
    index = np.full(2**BITS, -1, np.int64)
    index[[r["bucket"] for r in best]] = np.arange(len(best))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def bags(batches):
        for batch in batches:
            for at, buf, offs in text_chunks(batch.column(0)):
                (_, _, s_doc), (row, bucket) = sentence_words(buf, offs)
                f = shared.value[bucket]
                both = np.unique(row[f >= 0] << 16 | f[f >= 0])
                row, f = both >> 16, both & 0xFFFF
                n = len(offs) - 1
                sentences = np.bincount(s_doc, minlength=n)
                first = np.cumsum(sentences) - sentences
                cut = np.searchsorted(s_doc[row], np.arange(n + 1))
                spans = pa.array(cut.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(at, n), pa.array(sentences), pa.ListArray.from_arrays(spans, pa.array(row - first[s_doc[row]])), pa.ListArray.from_arrays(spans, pa.array(f))],
                    names=["y", "n", "row", "feature"],
                )

    found = rows.mapInArrow(bags, "y int, n bigint, row array<bigint>, feature array<bigint>").collect()
    y = np.array([r["y"] for r in found], float)
    n_s = np.array([r["n"] for r in found])
    base = np.cumsum(n_s) - n_s
    row = np.concatenate([np.array(r["row"], np.int64) + s for r, s in zip(found, base, strict=True)])
    feature = np.concatenate([np.array(r["feature"], np.int64) for r in found])
    w, bias = fit_noisy_or(np.repeat(np.arange(len(y)), n_s), row, feature, y, len(best))
    weights[[r["bucket"] for r in best]] = w
    return weights, bias


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 12_000, *, with_sentences: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted, worst_start, worst_end, worst_score) for every row.

    Learns ``labels.toxic`` from rows whose crc32(doc_id) mod 5 is not 0, at most
    ``max_rows`` of them, chosen by a hash of doc_id; null labels are left out, of several
    labels of one doc_id the largest counts. ``worst_*`` locate the likeliest sentence in
    bytes; with ``with_sentences`` also ``offending``: (start, end, score) of all sentences
    scored ``threshold`` or more. Null and empty texts have no sentence: score 0. Repeated
    rows repeat; an empty table gives an empty one; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    weights, bias = train(docs, labels.where(fold("doc_id", 5) != 0), max_rows)
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches):
        weights, bias = model.value
        for batch in batches:
            for at, buf, offs in text_chunks(batch.column(2)):
                n = len(offs) - 1
                (start, end, doc), (row, bucket) = sentence_words(buf, offs)
                heavy = np.flatnonzero(weights[bucket])
                both = np.unique(row[heavy] << BITS | bucket[heavy])  # presence, not counts
                z = bias + np.bincount(both >> BITS, weights[both & (2**BITS - 1)], len(start))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                score = 1 - np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n))
                order = np.lexsort((-np.arange(len(p)), p, doc))
                last = np.searchsorted(doc[order], np.arange(n), side="right") - 1
                has = np.bincount(doc, minlength=n) > 0
                worst = order[last] if len(order) else np.zeros(n, np.int64)
                masked = lambda x: pa.array(x if len(p) else np.zeros(n, x.dtype), mask=~has)
                at_doc = offs[:-1]
                columns = [
                    batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(np.clip(score, 0, 1)), pa.array((score >= threshold).astype(np.int32)),
                    masked(start[worst] - at_doc if len(p) else start), masked(end[worst] - at_doc if len(p) else end), masked(p[worst] if len(p) else p),
                ]
                names = ["doc_id", "held_out", "score", "predicted", "worst_start", "worst_end", "worst_score"]
                if with_sentences:
                    bad = np.flatnonzero(p >= threshold)
                    cut = pa.array(np.searchsorted(doc[bad], np.arange(n + 1)).astype(np.int32))
                    parts = [pa.array(x) for x in (start[bad] - at_doc[doc[bad]], end[bad] - at_doc[doc[bad]], p[bad])]
                    columns.append(pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays(parts, names=["start", "end", "score"])))
                    names.append("offending")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    schema = "doc_id bigint, held_out boolean, score double, predicted int, worst_start bigint, worst_end bigint, worst_score double"
    return rows.mapInArrow(run, schema + ", offending array<struct<start:bigint,end:bigint,score:double>>" * with_sentences)

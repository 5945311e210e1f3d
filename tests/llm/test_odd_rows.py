"""Odd rows for every operator on documents: repeated rows and ids, rows without id, very long
texts, and columns whose names the operators use inside. And replicas of what is learned."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOC, MULTI, RANKS, brute_repeats, docs, toxic_corpus, vectors

import corpus_pipeline
from inkstrata.llm import ann, bpe, capdedup, common, langid, licenses, minhash, mixing, quality, suffixdedup, toxicity

CLASHING = ["key", "context", "spans", "text2", "score", "predicted", "held_out", "stats", "y", "h", "h1", "rep", "sketch", "size", "copies", "digest", "ids", "cell", "code", "filter", "x", "n", "value", "label2"]
LABELS = "doc_id bigint, quality int, toxic int"


def odd(spark):
    """An id with two rows that are equal, one with two that differ, two rows without id, a very long text."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 8))))
    base = [" ".join(word() for _ in range(120)) for _ in range(12)]
    long = " ".join(base * 200)  # over a million bytes
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 2}", len(t)) for i, t in enumerate(base)]
    rows += [rows[1], (2, base[3] + " more", "en", "s0", 1), (None, base[4], None, None, 1), (None, base[4], None, None, 1), (50, long, "en", "s1", 1), (51, None, "en", None, 0), (52, "", None, "s0", 0)]
    return spark.createDataFrame(rows, DOC)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(12)], LABELS)


OPERATORS = {
    "quality": lambda d, lab: quality.score_quality(d, lab), "toxicity": lambda d, lab: toxicity.score_toxicity(d, lab), "bpe": lambda d, lab: bpe.encode_documents(d, RANKS),
    "language": lambda d, lab: langid.identify(d, MULTI), "licences": lambda d, lab: licenses.scan_licenses(d), "repeats": lambda d, lab: suffixdedup.remove_repeats(d),
    "mix": lambda d, lab: mixing.mix_sources(d), "near": lambda d, lab: minhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_and_odd_rows(spark, name):
    table = odd(spark)
    more = table.withColumns({c: F.lit(c) for c in CLASHING})
    plain = sorted(map(str, OPERATORS[name](table, labels(spark)).collect()))
    assert plain == sorted(map(str, OPERATORS[name](more, labels(spark).withColumn("text", F.lit("x"))).collect()))
    ids = table.where("doc_id is not null").select("doc_id").distinct().count()
    assert len(plain) == (ids if name == "near" else table.count())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_odd_rows(spark, name):
    table = odd(spark)
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, table.withColumns({c: F.lit(c) for c in CLASHING}), "")
    rows = out.collect()
    if name != "tokens":
        assert out.columns == table.columns
    if name == "mix":
        # both rows of id 2, and the rows without id, are taken by themselves
        targets = {r["source"]: r["target"] for r in mixing.mix_sources(table).select("source", "target").distinct().collect()}
        taken = {}
        for r in rows:
            taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
        assert taken.get(None, 0) > 0 and all(abs(taken.get(s, 0) - t) <= max(0.9 * t, 25_000) for s, t in targets.items())
        again = sorted(map(str, stage(spark, table.repartition(5), "").collect()))
        assert again == sorted(map(str, rows))
    if name in ("near_duplicates", "repeats", "tokens"):
        assert sum(r["doc_id"] is None for r in rows) == 2


def test_vectors_with_clashing_columns(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 8))
    table = vectors(spark, [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(3, x[3].tolist(), 1)])
    more = table.withColumns({c: F.lit(c) for c in CLASHING})
    for run in (lambda t: ann.search(t, every=10), capdedup.near_duplicate_vectors):
        assert sorted(map(str, run(table).collect())) == sorted(map(str, run(more).collect()))


def test_long_texts_in_parts(spark, monkeypatch):
    """Parts of a long text give what the whole gives."""
    monkeypatch.setattr(common, "CHUNK_BYTES", 1_000_000)
    rng = np.random.default_rng(9)
    passage = "".join(rng.choice(list("abcdefgh "), 3000))
    text = "".join(rng.choice(list("abcdefgh "), 1_200_000)) + passage + "".join(rng.choice(list("ijklmnop "), 1_900_000)) + passage
    out = suffixdedup.remove_repeats(docs(spark, [text, passage[:500], "é" * 900])).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in out] == [6000, 500, 1800] and [r["n_spans"] for r in out] == [2, 1, 1]
    few = bpe.encode_documents(docs(spark, [text]), RANKS, with_ids=True).first()
    with open(RANKS, "rb") as f:
        whole = bpe.TextEncoder(bpe.Vocabulary(bpe.parse_ranks(f.read()))).encode(text)
    assert list(few["token_ids"]) == whole and few["n_tokens"] == len(whole)


def test_hot_key_is_counted_by_windows(spark):
    """A group of more different contexts than are sorted together."""
    core = "the same hundred and twenty bytes stand in the middle of every one of these texts, whatever else may stand around it, always so"
    rng = np.random.default_rng(10)
    side = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 90))
    texts = [side() + core + side() for _ in range(60)]
    texts += [texts[0][5:] + "!", "?" + texts[1]]
    out = suffixdedup.remove_repeats(docs(spark, texts), 160, large_group=20).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in out] == brute_repeats(texts, 160)


def test_components_of_a_long_chain(spark):
    n = 700
    order = np.random.default_rng(11).permutation(n)
    edges = [(int(order[i]), int(order[i + 1])) for i in range(n - 1)]
    got = common.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {r["node"] for r in got} == set(range(n)) and {r["component"] for r in got} == {0}


def test_quality_fit_is_the_ridge_solution(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, len(quality.NAMES)))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "stats array<double>, y double").repartition(5)
    model = quality.fit(rows)
    z = model.features(x)
    penalty = 1e-3 * len(x) * np.diag([0.0] + [1.0 / quality.D] * (quality.D - 1)) + 1e-9 * np.eye(quality.D)
    assert np.allclose(model.raw(x), z @ np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)
    # isotonic least squares by the minimax formula over the steps
    step = np.round(np.clip(model.raw(x), -1, 2) * 1024).astype(int)
    at = np.unique(step)
    n, s = np.array([(step == a).sum() for a in at]), np.array([y[step == a].sum() for a in at])
    cn, cs = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(s)])
    want = [max(min((cs[j + 1] - cs[i]) / (cn[j + 1] - cn[i]) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    assert np.allclose(np.interp(at / 1024, *model.curve), want)


def test_noisy_or_fit_lowers_the_loss_of_the_documents():
    rng = np.random.default_rng(13)
    n_docs, per = 200, 4
    doc = np.repeat(np.arange(n_docs), per)
    feature = rng.integers(0, 6, n_docs * per)
    y = np.array([float((feature[doc == d] == 2).any()) for d in range(n_docs)])
    w, b = toxicity.fit_noisy_or(doc, np.arange(n_docs * per), feature, y, 6)

    def loss(w, b):
        p = 1 / (1 + np.exp(-(b + w[feature])))
        clean = np.array([np.prod(1 - p[doc == d]) for d in range(n_docs)])
        return -np.mean(y * np.log(np.maximum(1 - clean, 1e-12)) + (1 - y) * np.log(np.maximum(clean, 1e-12)))

    assert loss(w, b) < 0.1 * loss(np.full(6, 2.0), -6.0) and np.argmax(w) == 2
    for k in range(6):  # no single weight can be moved to a clearly smaller loss
        assert all(loss(w + step * np.eye(6)[k], b) > loss(w, b) - 5e-3 for step in (-0.5, 0.5))


def test_toxicity_of_repeated_rows_is_that_of_single_ones(spark):
    rows, labelled, _ = toxic_corpus()
    table, marks = spark.createDataFrame(rows, DOC), spark.createDataFrame(labelled, LABELS)
    scores = lambda d, lab: {r["doc_id"]: round(r["score"], 6) for r in toxicity.score_toxicity(d, lab).collect()}
    want = scores(table, marks)
    assert scores(table.union(table).union(table), marks.union(marks)) == want
    # labels without a document take no place among those that are learned from
    strangers = spark.range(10_000, 30_000).selectExpr("id doc_id", "1 quality", "1 toxic")
    assert scores(table, marks.union(strangers)) == want


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_of_both_element_types(spark, kind):
    rng = np.random.default_rng(9)
    base = np.repeat(rng.normal(size=(40, 24)), 3, axis=0)
    x = base + 0.05 * rng.normal(size=base.shape)
    df = spark.createDataFrame([(i, 0, row.tolist()) for i, row in enumerate(x)], f"vec_id bigint, label int, embedding array<{kind}>")
    y = x.astype(np.float32).astype(float) if kind == "float" else x
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert [r["n_links"] for r in capdedup.near_duplicate_vectors(df).orderBy("vec_id").collect()] == links.tolist()

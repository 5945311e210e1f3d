"""Training-data operators on inputs that earlier versions cut."""

import math
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from test_llm import MULTI, docs

from inkstrata.llm import ann, bpe, langid, licenses


def test_every_known_sentence_and_rule_is_found(spark):
    texts = list(licenses.SENTENCES.values()) + ["\n".join(licenses.SENTENCES[i] for i in ids) for _, ids in licenses.RULES]
    out = licenses.scan_licenses(docs(spark, texts)).orderBy("doc_id").collect()
    n = len(licenses.SENTENCES)
    assert [r["sentence_ids"] for r in out[:n]] == [f" {i} " for i in licenses.SENTENCES]
    for row, (name, ids) in zip(out[n:], licenses.RULES, strict=True):
        assert row["n_known"] == len(ids) and name in row["licenses"].split(";"), (name, ids)


def test_licence_headers_as_they_are_written(spark):
    texts = [
        "// SPDX-License-Identifier: MIT\nint main;", "code\n# SPDX-License-Identifier:  GPL-3.0-or-later\n\nmore", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: MITX",
        "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one. */",
        re.sub(r"(.{60}\S*) ", r"\1\n# ", "\n".join(licenses.SENTENCES[i] for i in ("gpl2-free", "gpl-warranty", "gpl-received"))),
        "This program is free software: you can run it.",
    ]
    got = [r["licenses"] for r in licenses.scan_licenses(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["MIT", "GPL-3.0-or-later", "GPL-3.0", "", "MPL-2.0", "GPL-2.0-or-later", ""]


def test_languages_of_few_texts_in_many_copies_are_learned(spark):
    few = [(t, f"l{n}") for n in range(12) for t in [f"w{n}a w{n}b"] * 60]
    many = [(f"some text number {i}", "en") for i in range(300)] + [("a hot text", "en")] * 500 + [(None, "xx"), ("no language", None)]
    df = spark.createDataFrame(few + many, "text string, lang string")
    got = langid.sample_texts(df, 20).collect()
    assert len(got) == len(set(got)) == 12 + 20
    assert {r["lang"] for r in got} == {f"l{n}" for n in range(12)} | {"en"}
    with open(MULTI, "rb") as f:
        names, prob = langid.train(df, f.read(), per_language=20)
    assert len(names) == 13 and prob.shape[1] == 13


def test_every_language_is_learned(spark):
    df = spark.createDataFrame([(f"text {i}", f"l{i:03}") for i in range(300)], "text string, lang string")
    assert len({r["lang"] for r in langid.sample_texts(df, 20).collect()}) == 300


@pytest.fixture(scope="module")
def pieces():
    with open(MULTI, "rb") as f:
        return langid.Pieces(bpe.parse_ranks(f.read()))


def test_long_words_are_summed_whole(pieces):
    words = [b"the" * 30, "ሀሁሐረ".encode() * 60, b"a", b"thesandwiches" * 3, b"x" * 25]
    buf = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    prob = np.random.default_rng(1).random((pieces.n, 2)) * 1e-7
    got = langid.log_sums(pieces, prob, langid.SpanHasher(buf), start, end)
    hasher = langid.SpanHasher(buf)
    for s, e, value in zip(start.tolist(), end.tolist(), got, strict=True):
        for c in range(2):
            sums = [Fraction(1)]
            for j in range(s + 1, e + 1):
                i = np.arange(max(s, j - int(pieces.lengths[-1])), j)
                found = pieces.find(hasher.of(i, np.full(len(i), j)))
                sums.append(sum(sums[k - s] * Fraction(prob[p, c]) for k, p in zip(i.tolist(), found.tolist(), strict=True) if p >= 0))
            want = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
            assert np.isclose(value[c], want, rtol=1e-9)


def test_long_counts_equal_those_of_short_words(pieces, monkeypatch):
    texts = pa.array(["thesandwiches are hereandthere again", "some other words in thesandwiches " + "ab" * 12])
    want = langid.learn(pieces, texts)
    monkeypatch.setattr(langid, "SHORT", 3)
    monkeypatch.setattr(langid, "CELLS", 40)
    assert np.allclose(langid.learn(pieces, texts), want, rtol=1e-9)


def test_a_long_word_of_an_unseen_script_touches_no_other_text(spark, pieces):
    rows = [(f"the cat and the dog {i}", "en") for i in range(40)] + [(f"der Hund und die Katze {i}", "de") for i in range(40)]
    training = spark.createDataFrame(rows, "text string, lang string")
    texts = ["ፐፑፒፓ" * 100, "the dog and the cat", "der Hund und die Katze", "the cat"]
    out = langid.identify(docs(spark, texts).coalesce(1), MULTI, training=training).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in out[1:]] == ["en", "de", "en"]
    assert all(0 < r["score"] <= 1 for r in out)


def nearest(rows, every, k=10):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q, v in zip(ids.tolist(), x, strict=True):
        if q % every == 0:
            d = np.sqrt(np.cumsum((x - v) ** 2, axis=1)[:, -1])
            d[ids == q] = np.inf
            out[q] = ids[np.lexsort((ids, d))[: min(k, len(ids) - 1)]].tolist()
    return out


def found(spark, rows, **how):
    out = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), **how).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_neighbours_inside_a_dense_group_are_exact(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=16)
    dense = [(i, (middle + rng.normal(size=16) * 1e-4).tolist()) for i in range(1500)]
    far = [(1500 + i, (rng.normal(size=16) * 10).tolist()) for i in range(200)]
    rows = dense + far
    assert found(spark, rows, every=150, probed=1.0, max_sample=300, max_cells=4) == nearest(rows, 150)


@pytest.mark.parametrize("n", [9, 11, 25])
def test_small_tables_give_all_neighbours_there_are(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(n)]
    got = found(spark, rows, every=1)
    assert len(got) == n and all(len(x) == min(10, n - 1) for x in got.values())
    if n <= 11:
        assert got == nearest(rows, 1)


def test_equal_vectors_leave_no_query_short(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [1.0] * 8) for i in range(60)] + [(60 + i, rng.normal(size=8).tolist()) for i in range(12)]
    got = found(spark, rows, every=1)
    assert len(got) == 72 and all(len(x) == 10 for x in got.values())

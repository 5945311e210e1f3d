"""Every stage of the pipeline against a brute-force version, and the whole of it."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from test_llm import DOC, brute_near, brute_repeats

from inkstrata.llm import bpe


def table(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    english = "the of and to in is that it for was on are as with his they at be this from".split()
    german = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()
    passage = " ".join(rng.choice(english) for _ in range(120))
    for i in range(80):
        words = english if i % 2 else german
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 90)))
        if i % 9 == 0:
            text += " " + passage
        rows.append((i, text, "en" if i % 2 else "de", f"s{i % 3}" if i % 7 else None, len(text)))
    rows += [(100 + i, rows[i][1], rows[i][2], "s1", 1) for i in range(5)]
    rows += [(200, None, "en", "s1", 0), (201, "", None, "s2", 0), (202, "12 34", "de", None, 5)]
    df = spark.createDataFrame(rows, DOC)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return df


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    docs = table(spark, tmp_path)
    stage = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    kept = stage["language"](spark, docs, sf)
    assert kept.columns == columns
    before = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in kept.collect()} == before - {200, 201, 202}

    rows = kept.orderBy("doc_id").collect()
    want = {r["doc_id"] for i, (r, (_, c)) in enumerate(zip(rows, brute_near([r["text"] for r in rows], 5), strict=True)) if c == i}
    near = stage["near_duplicates"](spark, kept, sf)
    assert near.columns == columns and {r["doc_id"] for r in near.collect()} == want

    rows = near.orderBy("doc_id").collect()
    cut = stage["repeats"](spark, near, sf)
    got = {r["doc_id"]: r for r in cut.collect()}
    for r, (n, gone, _, digest) in zip(rows, brute_repeats([r["text"] for r in rows], 400), strict=True):
        if gone and gone == n:
            assert r["doc_id"] not in got
        else:
            assert hashlib.sha256(got[r["doc_id"]]["text"].encode()).hexdigest() == digest
    assert cut.columns == columns

    mixed = stage["mix"](spark, cut, sf)
    assert mixed.columns == columns and 0 < mixed.count() <= 3 * cut.count()

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for r in stage["tokens"](spark, mixed, sf).collect():
        assert list(r["token_ids"]) == reference.encode_ordinary(texts[r["doc_id"]])


def test_run_and_empty(spark, tmp_path):
    table(spark, tmp_path / "a")
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() > 0
    spark.createDataFrame([], DOC).write.parquet(str(tmp_path / "b/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_passages_of_over_50_words_go_from_all_documents_that_hold_them(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    text = lambda n: "".join(word() + rng.choice([" ", "\n", "  "]) for _ in range(n)).strip()
    passage = {n: " ".join(word() for _ in range(n)) for n in (49, 50, 51, 59)}
    assert max(map(len, passage.values())) < 400
    own = " ".join(word() for _ in range(55))
    rows, want = [], []
    for i in range(24):
        a, b, n = text(60), text(70), (49, 50, 51, 59)[i % 4]
        rows.append(f"{a} {passage[n]}\n{b}" if i < 20 else f"{a} {own}{i} {own}{-i} {b}" if i == 20 else f"{passage[n]}" if i == 23 else f"é {a}")
        want.append(f"{a} \n{b}" if i < 20 and n > 50 else None if i == 23 else rows[-1])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], DOC)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeats(spark, docs.repartition(3), "").collect()}
    assert got == {i: t for i, t in enumerate(want) if t is not None}


def test_passages_equal_a_brute_force(spark, monkeypatch):
    from inkstrata.llm import suffixdedup

    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "a"]
    texts[7] = texts[3] + "\t" + texts[5]
    words = [(t or "").split() for t in texts]
    holds = {}
    for i, w in enumerate(words):
        for s in range(len(w) - 7):
            holds.setdefault(tuple(w[s : s + 8]), set()).add(i)
    # every word and every blank is one byte
    want = {(i, 2 * s, 2 * s + 15) for i, w in enumerate(words) for s in range(len(w) - 7) if len(holds[tuple(w[s : s + 8])]) > 1}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in suffixdedup.shared_passages(docs, 8).collect()} == want
    # the same where words are hashed a few at a time
    buf, offs = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8), np.cumsum([0] + [len(t or "") for t in texts])
    whole = [sorted(zip(*x)) for x in suffixdedup.word_windows(buf, offs, 8)]
    monkeypatch.setattr(suffixdedup, "WORDS", 13)
    assert sorted(r for x in suffixdedup.word_windows(buf, offs, 8) for r in zip(*x)) == sorted(r for x in whole for r in x)

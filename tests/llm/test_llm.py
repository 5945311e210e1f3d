"""Operators for training data against brute force on small tables, with the odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from inkstrata.llm import ann, bpe, capdedup, langid, licenses, minhash, mixing, quality, suffixdedup, toxicity
from inkstrata.llm import queries as llm_queries
from inkstrata.llm.common import components

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def docs(spark, texts, **extra):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# --- components -----------------------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


# --- 1, 2: classifiers ----------------------------------------------------------------


def test_quality(spark, sample, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.score_quality(sample.withColumnRenamed("n_chars", "score"), labels).toPandas()
    assert len(out) == sample.count() and out.score.between(0, 1).all()
    both = out.merge(labels.toPandas(), on="doc_id")
    assert ((both.predicted == 1) == (both.quality == 1)).mean() > 0.9
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    odd = quality.score_quality(docs(spark, [None, "", "word " * 200_000]), labels.limit(0)).toPandas()
    assert (odd.score == 0.5).all()
    assert quality.score_quality(empty, labels).count() == 0


def test_isotonic_is_monotone():
    x, y = quality.isotonic(np.arange(5.0), np.ones(5), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1 and np.interp(1.5, x, y) == 0.5


def toxic_corpus(n=400):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    rows, labels, where = [], [], {}
    for i in range(n):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randint(2, 12))]
        bad = rng.random() < 0.3
        if bad:
            where[i] = rng.randrange(len(sentences))
            sentences[where[i]] += " " + rng.choice(["zorgish", "zorgly", "blamfug"])
        rows.append((i, ". ".join(sentences) + ".", None, None, None))
        labels.append((i, 1, int(bad)))
    return rows, labels, where


def test_toxicity_finds_the_sentence(spark, empty):
    rows, labels, where = toxic_corpus()
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    table = spark.createDataFrame(rows, DOC)
    out = toxicity.score_toxicity(table, lab, with_sentences=True).toPandas().set_index("doc_id")
    truth = {i: t for i, _, t in labels}
    held = out[out.held_out]
    assert (held.predicted == [truth[i] for i in held.index]).mean() > 0.97
    hit = 0
    for i in where:
        text = rows[i][1].encode()
        part = text[int(out.worst_start[i]) : int(out.worst_end[i])]
        hit += bool(re.search(b"zorg|blam", part))
    assert hit > 0.97 * len(where)
    odd = toxicity.score_toxicity(docs(spark, [None, "", "..."]), lab.limit(0)).toPandas()
    assert (odd.score == 0).all() and odd.worst_score.isna().all()
    assert toxicity.score_toxicity(empty, lab).count() == 0


# --- 3: byte-level BPE ----------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    with open(RANKS, "rb") as f:
        return bpe.Vocabulary(bpe.parse_ranks(f.read()))


def test_bpe_is_exact(vocabulary):
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    encoder, rng = bpe.TextEncoder(vocabulary), random.Random(1)
    texts = ["", " ", "\n", "a", "  a  b ", "don't we'll I'M", "naïve Straße 東京  x y 😀", "a\r\n\r\n b", "x" * 3000, " " * 300, "<|endoftext|>", "\x1c \x85a"]
    texts += ["".join(rng.choice("ab '\n\té1.,!日") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == reference.encode_ordinary(t), t
        assert encoder.decode(ids) == t.encode()


def test_bpe_appends_and_edits(vocabulary):
    rng = random.Random(2)
    for _ in range(300):
        data = bytes(rng.choice(b"aeinst the") for _ in range(rng.randint(0, 300)))
        e = bpe.PrefixEncoder(vocabulary, data)
        more = bytes(rng.choice(b"aeinst the") for _ in range(rng.randint(0, 9)))
        e.append(more)
        data += more
        assert e.ids() == vocabulary.merged(data)
        i = rng.randint(0, len(data))
        j = rng.randint(i, min(len(data), i + 5))
        e.replace(i, j, b"xyz")
        assert e.data == data[:i] + b"xyz" + data[j:] and e.ids() == vocabulary.merged(e.data)


def test_bpe_rows(spark, empty):
    out = bpe.encode_documents(docs(spark, [None, "", "hello world", "hello world"]), RANKS, with_ids=True).orderBy("doc_id").collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out[:2]] == [(0, nothing, nothing)] * 2
    assert out[2][1:] == out[3][1:] and out[2]["decoded_sha256"] == hashlib.sha256(b"hello world").hexdigest()
    assert out[2]["ids_sha256"] == hashlib.sha256(" ".join(map(str, out[2]["token_ids"])).encode()).hexdigest()
    assert bpe.encode_documents(empty, RANKS).count() == 0


# --- 4, 6: embeddings -----------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def clustered(n=1500, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 10, dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * 0.12
    x[5] = x[7] = x[9]
    return x.astype(np.float32)


ODD = [(90_000, None, 1), (90_001, [0.0] * 16, 1), (90_100, [float("nan")] * 16, 1), (90_200, [1.0] * 3, 1), (90_300, [None] * 16, 1)]


def test_nearest_neighbours(spark):
    x = clustered()
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    out = ann.search(vectors(spark, rows + ODD + rows[:2])).toPandas()
    y, hit = x.astype(float), 0
    assert sorted(out.query_id.unique()) == list(range(0, 1500, 100))
    for q, g in out.sort_values("rank").groupby("query_id"):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        hit += len(set(best) & set(g.vec_id))
        assert np.allclose(g.score, d[g.vec_id], rtol=1e-12) and list(g["rank"]) == list(range(1, 11))
    assert hit >= 0.9 * len(out)
    assert ann.search(vectors(spark, ODD)).count() == 0
    assert ann.search(vectors(spark, rows[:3])).count() == 2


def test_near_duplicate_vectors(spark):
    x = clustered(seed=4)
    labels = [None if i % 50 == 0 else i % 2 for i in range(len(x))]
    rows = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, labels, strict=True))]
    out = capdedup.near_duplicate_vectors(vectors(spark, rows + ODD)).toPandas().set_index("vec_id")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    same = np.array([[a is not None and a == b for b in labels] for a in labels])
    close = (y @ y.T >= 0.93) & same
    np.fill_diagonal(close, False)
    got = out.n_links.reindex(range(len(x))).to_numpy()
    assert (got <= close.sum(axis=1)).all() and got.sum() >= 0.99 * close.sum()
    assert (out.kept == (out.index == out.component_id)).all()
    assert (out.n_links[[i for i, *_ in ODD]] == 0).all()
    assert capdedup.near_duplicate_vectors(vectors(spark, [])).count() == 0


# --- 5: languages ---------------------------------------------------------------------


def test_languages(spark, sample, empty):
    out = langid.identify(sample, MULTI).toPandas().merge(sample.select("doc_id", "lang").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    odd = langid.identify(docs(spark, [None, "", "123 !?", "the and of with", "x" * 500]), MULTI, training=sample, per_language=50).orderBy("doc_id").toPandas()
    assert list(odd.lang_pred[:4]) == ["und", "und", "und", "en"] and (odd.score[:3] == 0).all()
    assert set(langid.identify(docs(spark, ["some text"]), MULTI).toPandas().lang_pred) == {"und"}
    assert langid.identify(empty, MULTI).count() == 0


def test_forward_sums_all_segmentations():
    with open(MULTI, "rb") as f:
        pieces = langid.Pieces(bpe.parse_ranks(f.read()))
    word = np.frombuffer(b"thesan", np.uint8)
    hasher = langid.SpanHasher(word)
    prob = np.random.default_rng(0).random((pieces.n, 1))
    index = {(i, j): int(pieces.find(hasher.of(np.array([i]), np.array([j])))[0]) for i in range(6) for j in range(i + 1, 7)}

    def total(i):
        return 1.0 if i == 6 else sum(prob[index[i, j], 0] * total(j) for j in range(i + 1, 7) if index[i, j] >= 0)

    got = langid.log_sums(pieces, prob, hasher, np.array([0]), np.array([6]))
    assert np.isclose(np.exp(got[0, 0]), total(0))


# --- 7: licences ----------------------------------------------------------------------


def test_licenses(spark, sample, empty):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = c.sql(licenses.sql()).df().sort_values("doc_id").reset_index(drop=True)
    got = licenses.scan_licenses(sample).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (want == got).all().all()
    mit = "MIT License\n\n" + "\n".join(licenses.SENTENCES[i] for i in ("mit-grant", "mit-notice", "as-is"))
    wrapped = re.sub(r"(.{60}\S*) ", r"\1\n# ", mit)
    out = licenses.scan_licenses(docs(spark, [None, "", mit, wrapped, "MIT Licensed? no"])).orderBy("doc_id").toPandas()
    assert list(out.licenses) == ["", "", "MIT", "MIT", ""] and list(out.n_known)[:2] == [0, 0]
    reverse = "\n".join(licenses.SENTENCES[i] for i in ("bsd-binary", "bsd-source", "bsd-grant"))
    assert licenses.scan_licenses(docs(spark, [reverse])).first()["licenses"] == ""
    assert licenses.scan_licenses(empty).count() == 0


def test_every_known_sentence_and_rule_is_found(spark):
    known = licenses.known_parts()
    assert all(any(k in part for k in licenses.KEYWORDS) for part in known)
    names = list(licenses.SENTENCES)
    texts = [f"Some words. {licenses.SENTENCES[i]}\nMore words." for i in names] + ["\n".join(licenses.SENTENCES[i] for i in ids) for _, ids in licenses.RULES]
    rows = licenses.scan_licenses(docs(spark, texts)).orderBy("doc_id").collect()
    for i, r in zip(names, rows, strict=False):
        assert (r["n_known"], r["sentence_ids"]) == (1, f" {i} ")
    for (name, _), r in zip(licenses.RULES, rows[len(names) :], strict=True):
        assert r["licenses"] == name
    c = duckdb.connect()
    c.sql("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    assert [tuple(r) for r in rows] == c.sql(licenses.sql() + " ORDER BY 1").fetchall()


def test_licences_of_odd_rows(spark):
    both = "\n".join(licenses.SENTENCES[i] for i in ("spdx-mit", "spdx-apache"))
    long = "word " * 400_000 + "\n" + licenses.SENTENCES["mpl-source"]
    rows = [(0, both), (0, both), (None, both), (1, long), (2, "SPDX-License-Identifier: Other\nMIT\n")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("n_known", F.lit("x"))
    out = sorted(map(tuple, licenses.scan_licenses(table).select("doc_id", "licenses").collect()), key=str)
    assert out == [(0, "Apache-2.0;MIT"), (0, "Apache-2.0;MIT"), (1, "MPL-2.0"), (2, ""), (None, "Apache-2.0;MIT")]


# --- 8: repeated strings --------------------------------------------------------------


def brute_repeats(texts, length):
    seen = Counter()
    for t in texts:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] += 1
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum()) + bool(len(gone) and gone[0])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def random_texts(seed, n=150):
    rng = random.Random(seed)
    passage = "".join(rng.choice("abcdé ") for _ in range(500))
    texts = [passage]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 8)):
            x, start = rng.random(), rng.randint(0, 200)
            parts.append(
                "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 120))) if x < 0.4 else passage[start : start + rng.randint(30, 200)] if x < 0.7
                else "ab" * rng.randint(1, 120) if x < 0.8 else "x" * rng.randint(1, 200) if x < 0.9 else rng.choice(texts) or ""
            )
        texts.append("".join(parts)[:900] if rng.random() > 0.03 else None)
    return texts


@pytest.mark.parametrize(("seed", "large_group"), [(1, 8192), (2, 2)])
def test_repeats(spark, seed, large_group):
    texts = random_texts(seed)
    out = suffixdedup.remove_repeats(docs(spark, texts).repartition(3), 80, large_group=large_group).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in out] == brute_repeats(texts, 80)


def test_deep_shallow_sorts():
    rng = random.Random(5)
    for _ in range(500):
        letters = rng.choice([b"a", b"ab", b"abcdef"])
        base = bytes(rng.choice(letters) for _ in range(60))
        strings = [base[: rng.randint(0, 60)] + bytes(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 30))]
        order, lcp = suffixdedup.deep_shallow(strings, 0, 8)
        assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
        assert lcp == [suffixdedup.common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]


def test_repeats_of_nothing(spark, empty):
    assert suffixdedup.remove_repeats(empty).count() == 0
    out = suffixdedup.remove_repeats(docs(spark, [None, "", "short"])).collect()
    assert [r["n_removed"] for r in out] == [0, 0, 0]


def test_op8_counts_short_passages_and_leaves_them(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = {n: text(n) for n in (50, 51, 59, 120)}
    assert len(passage[59].encode()) < 400 < len(passage[120].encode())
    twice = text(55)
    texts = [f"é {text(60)} {passage[(50, 51, 59, 120)[i % 4]]}\n{text(70)}" for i in range(40)]
    texts += [f"{twice} {text(9)} {twice}", passage[59] + " " + passage[51], passage[59].replace(" ", "\n\t"), texts[3], None, ""]
    docs(spark, texts).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = llm_queries.queries()["op8_suffix_array_dedup"](spark, str(tmp_path)).orderBy("doc_id")
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"]
    out = [tuple(r) for r in out.collect()]
    assert [r[1:5] for r in out] == brute_repeats(texts, 400)
    spans = [[m.span() for m in re.finditer(rb"[^ \t-\r]+", (t or "").encode())] for t in texts]
    words = [(t or "").split() for t in texts]
    holds = {}
    for i, w in enumerate(words):
        for s in range(len(w) - 50):
            holds.setdefault(tuple(w[s : s + 51]), set()).add(i)
    covered = [len({b for s in range(len(w) - 50) if len(holds[tuple(w[s : s + 51])]) > 1 for b in range(at[s][0], at[s + 50][1])}) for w, at in zip(words, spans, strict=True)]
    assert [r[5] for r in out] == covered
    assert all(r[2] == 0 and r[5] == len(passage[51]) for r in out[1:40:4]) and not any(r[5] for r in out[0:40:4])


# --- 9: mixing ------------------------------------------------------------------------


def test_mix(spark, sample, empty):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = c.sql(mixing.SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = mixing.mix_sources(sample).select(*want.columns).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (want == got).all().all()
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 40), None, s, None) for i, s in enumerate(["a"] * 1500 + ["b"] * 100 + [None] * 400 + ["c"] * 5)] + [(9999, None, None, "d", None)]
    out = mixing.mix_sources(spark.createDataFrame(rows, DOC)).toPandas()
    assert (out.taken <= 3 * out["size"]).all()
    for _, g in out.groupby("source", dropna=False):
        target, size = g.target.iloc[0], g.source_size.iloc[0]
        assert target <= 3 * size + 1e-6 and abs(g.taken.sum() - target) <= 0.1 * target + 40
    assert np.isclose(out.groupby("source", dropna=False).target.first().sum(), out["size"].sum())
    assert mixing.mix_sources(empty).count() == 0


# --- 10: near duplicates --------------------------------------------------------------


def brute_near(texts, words):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    home = list(range(len(texts)))

    def top(i):
        while home[i] != i:
            i = home[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                home[y] = x
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def near_texts(seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "one", "One", "one two", "two one", "one  TWO"]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 150]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = [w if rng.random() > 0.06 else rng.choice(vocabulary) for w in base]
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return texts


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    texts = near_texts()
    out = minhash.near_duplicates(docs(spark, texts), words=words).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in out] == brute_near(texts, words)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0
    rows = [(1, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (1, None, None, None, None), (2, "a b c d e f", None, None, None), (None, "x", None, None, None)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOC)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["component_id"]) for r in out] == [(1, 1), (2, 1)]

"""Ordered-sequence operators against plain loops on random inputs."""

import random

from pyspark.sql import functions as F

from inkstrata.operators import sequence as s


def rows(n_docs=40, seed=1):
    rng, out = random.Random(seed), []
    for d in range(n_docs):
        top = 0
        for i in range(rng.randint(1, 30)):
            top += rng.choice([0, 1, 9, 10, 11, 34, 35, 50])
            out.append((d, i, rng.choice([-1.0, -1.0, 90.0]), float(top), float(rng.randint(0, 100)), rng.random() < 0.3))
    return out


COLUMNS = "d int, i int, conf double, top double, left double, flag boolean"


def by_doc(data):
    out = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return out


def got(df, name):
    return {(r["d"], r["i"]): r[name] for r in df.select("d", "i", name).collect()}


def test_paragraphs(spark):
    data = rows()
    want = {}
    for d, rs in by_doc(data).items():
        n = 0
        for k, r in enumerate(rs):
            if k >= 3 and all(rs[k - j][2] == -1 for j in range(3)) and r[3] - rs[k - 3][3] >= 35:
                n += 1
            want[d, r[1]] = n
    df = spark.createDataFrame(data, COLUMNS)
    assert got(s.paragraph_islands(df, ["d"], ["i"], F.col("conf") == -1, "top"), "para_no") == want


def test_lines_and_segments(spark):
    data = rows(seed=2)
    lines, segments = {}, {}
    for d, rs in by_doc(data).items():
        n, before, seg, run = 0, None, 0, 2
        for r in rs:
            if before is not None and r[3] - before > 10:
                n += 1
            before = r[3]
            lines[d, r[1]] = n
            if r[2] == -1:
                run += 1
            else:
                seg += run >= 2
                run = 0
            segments[d, r[1]] = seg
    df = spark.createDataFrame(data, COLUMNS)
    assert got(s.gap_sessions(df, ["d"], ["i"], "top", 10), "line_no") == lines
    assert got(s.run_segments(df, ["d"], ["i"], F.col("conf") == -1), "segment_no") == segments


def test_split_and_merge(spark):
    data = rows(seed=3)
    pieces = {}
    for d, rs in by_doc(data).items():
        n = 0
        for r in rs:
            n += r[5]
            pieces[d, r[1]] = max(n, 1)
    df = spark.createDataFrame(data, COLUMNS)
    assert got(s.split_at_large(df, ["d"], ["i"], F.col("flag")), "piece_no") == pieces
    seg = df.withColumn("seg", F.floor(F.col("i") / 3))
    want = {}
    for d, rs in by_doc(data).items():
        n = 0
        for k in range(0, len(rs), 3):
            group = rs[k : k + 3]
            if k == 0 or any(r[4] > 60 for r in group):
                n += 1
            for r in group:
                want[d, r[1]] = n
    assert got(s.merge_segments(seg, ["d"], "seg", "left", F.lit(60)), "merged_no") == want


def test_carry(spark):
    rng = random.Random(4)
    data = [(d, i, rng.random() < 0.4, f"<{d}.{i}>") for d in range(60) for i in range(rng.randint(1, 8))]
    want, lost = [], []
    for d in range(60):
        held, first = "", None
        for _, i, on, t in [r for r in data if r[0] == d]:
            first = i if first is None else first
            held += t
            if not on:
                want.append((d, first, held))
                held, first = "", None
        if held:
            lost.append((d, first, held))
    df = spark.createDataFrame(data, "d int, i int, flag boolean, t string")
    rows_ = lambda **k: sorted((r["d"], r["first_i"], r["content"]) for r in s.carry_forward(df, ["d"], ["i"], F.col("flag"), "t", **k).collect())
    assert rows_() == sorted(want)
    assert rows_(keep_open=True) == sorted(want + lost)

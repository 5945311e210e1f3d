"""The orders of mixed lines against plain loops over their rules."""

import random

import regex

from pyspark.sql import functions as F

from inkstrata.layout import bidi

WORDS = ["שלום", "עולם", "(אב", "גד)", "abc", "(def", "ghi)", "[jk]).", "12", "(3-4)", ".", "", "Lm‎", "נס‏", "opq)‎", "(!rs"]
HEBREW = regex.compile(r"(?=\p{Bidi_Class=R})\p{L}")
TURN = str.maketrans("()[]", ")(][")


def edges(run):
    if len(run) < 2:
        return run
    first, last = run[0], run[-1]
    head, tail = regex.match(r"\([\p{P}\p{S}]*", first), regex.search("[\\p{P}\\p{S}]*\\)[‎‏]?$", last)
    plain = lambda x: regex.sub("[‎‏]", "", x.translate(TURN)[::-1])
    new = list(run)
    if tail:
        new[-1] = last[: tail.start()]
        new[0] = plain(tail[0]) + first
    if head:
        new[0] = first[head.end() :]
        new[-1] += plain(head[0])
    return new


def by_letters(words):
    if len(words) <= 1:
        return [t for _, t in words]
    words = sorted(words, key=lambda w: -w[0])
    right, had, out, run = bool(HEBREW.search(words[0][1])), False, [], []
    for _, t in words:
        if not t:
            continue
        now = True if HEBREW.search(t) else right if regex.fullmatch(r"\P{L}+", t) else False
        if now != right:
            out += edges(run) if had else run
            run = []
        right = now
        if right:
            had = True
            out.append(t)
        else:
            run = [t, *run]
    return out + (edges(run) if had else run)


def by_marks(words):
    if len(words) <= 1:
        return [t for _, t in words]
    down, up = sorted(words, key=lambda w: -w[0]), sorted(words, key=lambda w: w[0])
    if down[0][0] not in (words[0][0], words[-1][0]) or (down[0][0] == words[0][0] and down[-1][0] == words[-1][0]):
        words = down
    else:
        words = up
    main = words[1][0] < words[0][0]
    right, out, run = main, [], []
    if main and words[0][1].endswith("‏"):
        right = False
    if not main and words[0][1].endswith("‎"):
        right = True
    flush = lambda: out + run[::-1] if main else run[::-1] + out
    for i, (_, t) in enumerate(words):
        if not t:
            continue
        before = right
        (out if right == main else run).append(t)
        if t.endswith("‎") and i:
            right = False
        elif t.endswith("‏") and i:
            right = True
        elif main and i + 1 < len(words) and HEBREW.search(words[i + 1][1]):
            right = True
        if right != before and before != main:
            out, run = flush(), []
    return flush()


def lines(n=500):
    rng = random.Random(11)
    out = [[(30.0, "abc"), (10.0, "שלום")], [(50.0, "נס‏"), (40.0, "(def"), (30.0, "ghi)"), (20.0, "עולם")], [(1.0, "x")], []]
    for _ in range(n):
        words = [(float(rng.randrange(0, 400, 10)), rng.choice(WORDS)) for _ in range(rng.randint(0, 9))]
        out.append(sorted(words, key=lambda w: -w[0]) if rng.random() < 0.5 else words)
    return out


def test_orders_equal_their_rules(spark):
    cases = lines()
    df = spark.createDataFrame(list(enumerate(cases)), "id int, words array<struct<left:double,text:string>>")
    got = df.select("id", bidi.reading_order(F.col("words")).alias("a"), bidi.marked_order(F.col("words")).alias("b")).collect()
    for r in got:
        assert r["a"] == by_letters(cases[r["id"]]), cases[r["id"]]
        assert r["b"] == by_marks(cases[r["id"]]), cases[r["id"]]


def test_hand_made_lines(spark):
    line = [(400.0, "שלום"), (300.0, "(Smith"), (200.0, "1999)"), (100.0, "עולם")]
    row = spark.createDataFrame([(line,)], "words array<struct<left:double,text:string>>").select(bidi.reading_order(F.col("words")).alias("a"), bidi.reading_order(F.col("words"), True).alias("b")).first()
    # within the run 1999) stands first, so its bracket opens the run's other end
    assert row["a"] == row["b"] == by_letters(line)
    assert bidi.typeset(["abc", "def", "שלום"]) == "שלום abc def"


def test_orders_compute_each_value_once_and_need_no_shuffle(spark):
    from inkstrata.plans.structure import reading_orders

    plan = reading_orders(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # what is repeated in an expression is computed again: lines were sorted dozens of times
    assert "Exchange" not in plan and plan.count("array_sort(") <= 4

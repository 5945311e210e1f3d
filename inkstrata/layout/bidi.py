"""Word order of mixed Hebrew and Latin lines."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Brackets and their mirror images.
MIRROR = str.maketrans("()[]{}<>«»", ")(][}{><»«")
RIGHT = regex.compile(r"\p{Bidi_Class=R}")
LEFT = regex.compile(r"\p{Bidi_Class=L}|\d")
MARKS = regex.compile("[‎‏‪-‮⁦-⁩]")


def typeset(words: list[str]) -> str:
    """Words from left to right on the page to reading order. A line with a right-to-left word
    is read from the right; within it, runs of left-to-right words keep their own order, and
    words without letters belong to the run around them if both neighbours do."""
    words = [MARKS.sub("", w) for w in words if w and w.strip()]
    if not any(RIGHT.search(w) for w in words):
        return " ".join(words)
    kinds = ["R" if RIGHT.search(w) else "L" if LEFT.search(w) else "N" for w in words]
    for i, kind in enumerate(kinds):
        if kind == "N":
            before = next((k for k in reversed(kinds[:i]) if k != "N"), "R")
            after = next((k for k in kinds[i + 1 :] if k != "N"), "R")
            kinds[i] = before if before == after else "R"
    out: list[str] = []
    run: list[str] = []
    for word, kind in zip(reversed(words), reversed(kinds), strict=True):
        if kind == "L":
            run.append(word)
            continue
        out += reversed(run)
        run = []
        out.append(word)
    return " ".join(out + run[::-1])


def mirrored(word: str) -> str:
    return word.translate(MIRROR)


def reverse_digit_runs(x: str) -> str:
    return regex.sub(r"\d+", lambda m: m[0][::-1], x)


def reverse_right_runs(x: str) -> str:
    """Runs of right-to-left letters, with the blanks between them, turned around."""
    return regex.sub(r"\p{Bidi_Class=R}+(?:\s+\p{Bidi_Class=R}+)*", lambda m: m[0][::-1], x)


def reverse_inside_blanks(x: str) -> str:
    body = x.strip()
    lead = x[: len(x) - len(x.lstrip())]
    return x if not body else lead + body[::-1] + x[len(lead) + len(body) :]


def _typeset_series(x: pd.Series) -> pd.Series:
    return x.map(lambda w: typeset(list(w)) if w is not None else None)


def typeset_column(words: Column) -> Column:
    return F.pandas_udf(_typeset_series, "string")(words)


# --- the two other orders, on arrays of (left, text) of a line, inside the JVM ---------

#: Hebrew letters, the marks of direction, and brackets that turn around.
HEBREW_LETTER = "[א-תׯ-ײיִײַ-ﬨשׁ-ﭏ]"
LEFT_MARK, RIGHT_MARK = "‎", "‏"
BRACKETS, TURNED = "()[]", ")(]["


def bound(x: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used: what an expression repeats, it computes again,
    and in nested ones that multiplies."""
    return F.transform(F.array(x), body)[0]


def _turned(x: Column) -> Column:
    """Punctuation seen from the other side, without marks."""
    return F.regexp_replace(F.reverse(F.translate(x, BRACKETS, TURNED)), f"[{LEFT_MARK}{RIGHT_MARK}]", "")


def turned_at_edges(run: Column) -> Column:
    """A run of left-to-right words with the brackets at its edges moved to the side on which they
    stand in reading order: what closes the last word opens the first, and the other way round. If both
    happen, what closed the last word is lost."""

    def turned(e: Column) -> Column:
        first, last, opening, closing = e["first"], e["last"], e["opening"], e["closing"]
        start = F.when(opening != "", F.substring(first, F.length(opening) + 1, F.length(first))).otherwise(F.concat(_turned(closing), first))
        end = F.concat(F.substring(last, F.lit(1), F.length(last) - F.length(closing)), _turned(opening))
        return F.concat(F.array(start), F.slice(run, F.lit(2), F.greatest(F.size(run) - 2, F.lit(0))), F.array(end))

    first, last = run[0], F.element_at(run, -1)
    closing = F.when(last.contains(")"), F.regexp_extract(last, rf"([\p{{P}}\p{{S}}]*\)[{LEFT_MARK}{RIGHT_MARK}]?)$", 1)).otherwise("")
    opening = F.when(first.startswith("("), F.regexp_extract(first, r"^(\([\p{P}\p{S}]*)", 1)).otherwise("")
    edges = F.struct(first.alias("first"), last.alias("last"), opening.alias("opening"), closing.alias("closing"))
    some = last.contains(")") | first.startswith("(")
    return F.when((F.size(run) > 1) & some, bound(edges, turned)).otherwise(run)


def _sorted(words: Column, sign: int) -> Column:
    """The words by their left edge, equal ones in their order."""
    keyed = F.transform(words, lambda w, i: F.struct((sign * w["left"]).alias("k"), i.alias("i"), w["left"].alias("left"), w["text"].alias("text")))
    return F.transform(F.sort_array(keyed), lambda w: F.struct(w["left"].alias("left"), w["text"].alias("text")))


def reading_order(words: Column, had_right: Column | bool = False) -> Column:
    """Texts of a line's words, an array of (left, text), in reading order: from the right, runs of
    left-to-right words in their own order, words without letters in the direction before them. After
    a right-to-left word (or with ``had_right``) brackets at the edges of such runs are turned."""
    none, had_right = F.array().cast("array<string>"), F.lit(had_right) if isinstance(had_right, bool) else had_right
    state = lambda out, run, right, had: F.struct(out.alias("out"), run.alias("run"), right.alias("right"), had.alias("had"))
    closed = lambda a: F.concat(a["out"], F.when(a["had"], turned_at_edges(a["run"])).otherwise(a["run"]))

    def step(a: Column, w: Column) -> Column:
        # a word's letters tell its direction: true, false or (null) that of the word before
        text = F.array(w["text"])

        def turn(right: Column) -> Column:
            same = F.when(right, state(F.concat(a["out"], text), a["run"], right, a["had"] | right)).otherwise(state(a["out"], F.concat(text, a["run"]), right, a["had"] | right))
            other = F.when(right, state(F.concat(closed(a), text), none, right, a["had"] | right)).otherwise(state(closed(a), text, right, a["had"] | right))
            return F.when(right != a["right"], other).otherwise(same)

        return bound(F.coalesce(w["right"], a["right"]), turn)

    def read(line: Column) -> Column:
        start = F.coalesce(line[0]["text"].rlike(HEBREW_LETTER), F.lit(False))
        own = lambda t: F.when(t.rlike(HEBREW_LETTER), True).when(~t.rlike(r"\p{L}") & (t != ""), F.lit(None).cast("boolean")).otherwise(False)
        texts = F.filter(line, lambda w: w["text"] != "")
        mixed = F.aggregate(F.transform(texts, lambda w: F.struct(w["text"].alias("text"), own(w["text"]).alias("right"))), state(none, none, start, had_right), step, closed)
        # without a right-to-left word the line is one run
        run = F.reverse(F.transform(texts, lambda w: w["text"]))
        plain = F.when(had_right, bound(run, turned_at_edges)).otherwise(run)
        return F.when(F.exists(line, lambda w: F.coalesce(w["text"].rlike(HEBREW_LETTER), F.lit(False))), mixed).otherwise(plain)

    return bound(words, lambda ws: F.when(F.size(ws) <= 1, F.transform(ws, lambda w: w["text"])).otherwise(bound(_sorted(ws, -1), read)))


def marked_order(words: Column) -> Column:
    """The order by marks: the page's direction is that of the first two words, marks at words' ends
    (and in a right-to-left line the next word's letters) switch it, and what goes the other way is
    turned around, in a left-to-right line to its front. Words from the right, unless the given
    order has its first word at neither or only one end of the line."""
    none = F.array().cast("array<string>")
    ends = lambda text, mark: F.endswith(text, F.lit(mark))
    state = lambda out, run, right, main: F.struct(out.alias("out"), run.alias("run"), right.alias("right"), main.alias("main"))
    closed = lambda out, run, main: F.when(main, F.concat(out, F.reverse(run))).otherwise(F.concat(F.reverse(run), out))

    def step(a: Column, w: Column) -> Column:
        text = F.array(w["text"])

        def turn(right: Column) -> Column:
            own = a["right"] == a["main"]
            kept = F.when(own, state(F.concat(a["out"], text), a["run"], right, a["main"])).otherwise(state(a["out"], F.concat(a["run"], text), right, a["main"]))
            return F.when((right != a["right"]) & ~own, state(closed(a["out"], F.concat(a["run"], text), a["main"]), none, right, a["main"])).otherwise(kept)

        right = (
            F.when((w["i"] > 0) & ends(w["text"], LEFT_MARK), False).when((w["i"] > 0) & ends(w["text"], RIGHT_MARK), True)
            .when(a["main"] & F.coalesce(w["following"].rlike(HEBREW_LETTER), F.lit(False)), True).otherwise(a["right"])
        )
        return bound(right, turn)

    def read(line: Column) -> Column:
        following = lambda i: F.get(line, i + 1)["text"]
        steps = F.transform(line, lambda w, i: F.struct(w["text"].alias("text"), i.alias("i"), following(i).alias("following")))
        begin = lambda main: F.when(main & ends(line[0]["text"], RIGHT_MARK), False).when(~main & ends(line[0]["text"], LEFT_MARK), True).otherwise(main)
        read = lambda main: F.aggregate(F.filter(steps, lambda w: w["text"] != ""), state(none, none, begin(main), main), step, lambda a: closed(a["out"], a["run"], a["main"]))
        return bound(line[1]["left"] < line[0]["left"], read)

    def placed(ws: Column) -> Column:
        lefts = F.transform(ws, lambda w: w["left"])
        ends_at = F.struct(ws[0]["left"].alias("first"), F.element_at(ws, -1)["left"].alias("last"), F.array_max(lefts).alias("far"), F.array_min(lefts).alias("near"))
        by_right = bound(ends_at, lambda e: (e["far"] != e["first"]) & (e["far"] != e["last"]) | (e["far"] == e["first"]) & (e["near"] == e["last"]))
        return bound(F.when(by_right, _sorted(ws, -1)).otherwise(_sorted(ws, 1)), read)

    return bound(words, lambda ws: F.when(F.size(ws) <= 1, F.transform(ws, lambda w: w["text"])).otherwise(placed(ws)))

"""Entries of lists of abbreviations, in one or two columns.

A list is in two columns if few of the lines at its margin hold a separator and the right edges of its
words gather at a second place: the widest bin of the edges, within the journal's tolerance, is the
column of the explanations. Indented lines go on with the entry before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.kept import kept
from . import metadata
from .bidi import bound, reading_order
from .lines import edited_entry

#: By journal, the indent of lines that go on in two columns and in one, and the tolerance of a
#: column's edge.
JOURNALS = {"תרביץ": (245.0, 30.0, 10.0), "לשוננו": (35.0, 10.0, 5.0), "מגילות": (35.0, 35.0, 3.0), "שנתון": (35.0, 10.0, 3.0), "סידרא": (245.0, 30.0, 10.0)}
#: Of another journal.
DEFAULT = (35.0, 10.0, 5.0)
#: Separators as they stand in a line and as words.
DASH = r"\p{Pd}"
HAS_SEPARATOR = rf"=|:|{DASH}{{2,3}}\s"
NAME_AND_DASH = rf"^\p{{L}}+,( \p{{L}}+){{0,3}} {DASH}"
SHARE, MISSING = 0.45, 3
INDENTED_LABEL = (20.0, 40.0)


def journals(spark: SparkSession, rows: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """(journal, two_column_indent, one_column_indent, tolerance)"""
    names = ("two_column_indent", "one_column_indent", "tolerance")
    row = lambda k, v: F.struct(F.lit(k).alias("journal"), *[F.lit(float(x)).alias(c) for c, x in zip(names, v, strict=True)])
    data = [row(k, v) for k, v in (JOURNALS if rows is None else rows).items()]
    none = F.array().cast("array<struct<journal:string,two_column_indent:double,one_column_indent:double,tolerance:double>>")
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*data) if data else none))


def with_indents(lines: DataFrame, table: DataFrame) -> DataFrame:
    """Lines with the indents of their journal; the table has a row for each journal and is broadcast."""
    out = lines.join(F.broadcast(table), "journal", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip(("two_column_indent", "one_column_indent", "tolerance"), DEFAULT, strict=True)})


def weighted_bins(items: Column, tolerance: Column) -> Column:
    """Greedy bins of (value, n) in their order: a value joins the first bin within the tolerance of its
    first value. Array of (start, n), the fullest first, equal ones in their order."""
    none = F.array().cast("array<struct<start:double,n:bigint>>")

    def step(bins: Column, x: Column) -> Column:
        hit = F.array_position(F.transform(bins, lambda b: F.abs(b["start"] - x["value"]) <= tolerance), True)
        new = F.struct(x["value"].cast("double").alias("start"), x["n"].alias("n"))
        grown = lambda h: F.transform(bins, lambda b, i: F.struct(b["start"].alias("start"), F.when(i == h - 1, b["n"] + x["n"]).otherwise(b["n"]).alias("n")))
        return bound(hit, lambda h: F.when(h > 0, grown(h)).otherwise(F.concat(bins, F.array(new))))

    ranked = F.sort_array(F.transform(F.aggregate(items, none, step), lambda b, i: F.struct((-b["n"]).alias("k"), i.alias("i"), b["start"].alias("start"), b["n"].alias("n"))))
    return F.transform(ranked, lambda b: F.struct(b["start"].alias("start"), b["n"].alias("n")))


def _right(w: Column) -> Column:
    return w["left"] + w["width"]


def list_settings(lines: DataFrame) -> DataFrame:
    """(doc_id, from_right, columns, single_dash, col_info): how the list of each document is set."""
    word = lines.select("doc_id", "page", "i", F.posexplode("words").alias("k", "w"))
    # one number for a word's place, which is aggregated without a sort: up to 2**20 lines a page, 2**16 words a line
    at = F.col("page").cast("long") * 2**36 + F.col("i").cast("long") * 2**16 + F.col("k")
    edges = word.groupBy("doc_id", _right(F.col("w")).alias("value")).agg(F.count("*").alias("n"), F.min(at).alias("at"))
    edges = edges.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("edges"))
    # lines with equal edges are counted together, so that their patterns are matched once
    count = lambda pattern: F.sum(F.col("text").rlike(pattern).cast("int"))
    alike = lines.groupBy("doc_id", "left", "right").agg(
        F.max(F.col("text").rlike("[א-ת]")).alias("from_right"), F.first("tolerance").alias("tolerance"),
        F.count("*").alias("n"), count(HAS_SEPARATOR).alias("dashes"), count(NAME_AND_DASH).alias("singles"),
    )
    sides = F.struct("left", "right", "n", "dashes", "singles")
    per = alike.groupBy("doc_id").agg(F.max("from_right").alias("from_right"), F.max("right").alias("_right"), F.min("left").alias("_left"), F.first("tolerance").alias("tolerance"), F.collect_list(sides).alias("_sides"))
    per = per.withColumn("margin", F.when(F.col("from_right"), F.col("_right")).otherwise(F.col("_left"))).drop("_right", "_left")
    first = per.select("doc_id", "from_right", "margin", "tolerance", F.explode("_sides").alias("x"))
    edge = F.when(F.col("from_right"), F.col("x.right")).otherwise(F.col("x.left"))
    first = first.where(F.abs(edge - F.col("margin")) <= F.col("tolerance"))
    counts = first.groupBy("doc_id").agg(*[F.sum(f"x.{c}").alias(c) for c in ("n", "dashes", "singles")])
    per = per.drop("_sides")
    df = per.join(counts, "doc_id").join(edges, "doc_id").withColumn("bins", weighted_bins(F.col("edges"), F.col("tolerance")))
    many = lambda c: (F.col("n") - F.col(c) <= MISSING) | (F.col(c) / F.col("n") > SHARE)
    one, two = F.col("bins")[0], F.try_element_at("bins", F.lit(2))
    away = F.abs(one["start"] - F.col("margin")) > F.col("tolerance")
    like = F.coalesce(F.abs(one["n"] - two["n"]) <= 2, F.lit(False))
    column = F.when(many("dashes") | many("singles"), None).when(away, one["start"]).when(like, two["start"])
    return df.select("doc_id", "from_right", F.when(column.isNull(), 1).otherwise(2).alias("columns"), (~many("dashes") & many("singles")).alias("single_dash"), column.alias("col_info"))


def split_at_column(words: Column, column: Column) -> Column:
    """(right, left): the words whose right edge is beyond the column, and the others."""
    return F.struct(F.filter(words, lambda w: _right(w) > column).alias("right"), F.filter(words, lambda w: _right(w) <= column).alias("left"))


def split_at_word(words: Column, pattern: str, include: bool = False) -> Column:
    """(right, left): the words right and left of the first word that matches as a whole; it goes, or (``include``)
    stays on the right. None match: nothing on either side."""
    none = F.slice(words, 1, 0)
    pair = lambda right, left: F.struct(right.alias("right"), left.alias("left"))

    def split(sep: Column) -> Column:
        halves = split_at_column(words, sep["left"] - (1 if include else 0))
        if include:
            return halves
        other = lambda words: F.filter(words, lambda w: w["text"] != sep["text"])
        without = lambda x: F.when(F.exists(x["right"], lambda w: w["text"] == sep["text"]), pair(other(x["right"]), x["left"])).otherwise(pair(x["right"], other(x["left"])))
        return bound(halves, without)

    found = F.try_element_at(F.filter(words, lambda w: w["text"].rlike(f"^(?:{pattern})$")), F.lit(1))
    return bound(found, lambda sep: F.when(sep.isNull(), pair(none, none)).otherwise(split(sep)))


def entries(lines: DataFrame) -> DataFrame:
    """(doc_id, entry_no, label, info) of the lists in ``lines``: doc_id, page, i, text, left, right, margins,
    words, indents.

    Lines before the first entry, and titles of parts of a list, are left out. An entry whose separator isn't
    found is called 'unknown' and keeps its whole line.
    """
    lines = kept(lines)  # they are read three times, and cut out of their texts once
    df = lines.where(F.size("words") > 0).join(list_settings(lines).hint("shuffle_hash"), "doc_id")
    by_right, by_left = F.array_max(F.transform("words", _right)), F.array_min(F.transform("words", lambda w: w["left"]))
    offset = F.greatest(F.when(F.col("from_right"), F.col("page_right_margin") - by_right).otherwise(by_left - F.col("page_left_margin")), F.lit(0.0))
    text, words = F.col("text"), F.col("words")
    two = F.col("columns") == 2
    lined = [
        ("equals", text.rlike(" = ")), ("dash", F.col("single_dash")), ("colon", text.rlike(r"\p{L}: ")), ("dashes", text.rlike(rf"\s({DASH}{{2,3}}|—)\s")),
        ("title", metadata.is_subtype(text)),
    ]
    how = F.when(two, F.lit("column"))
    for name, cond in lined:
        how = how.when(cond, F.lit(name))
    df = df.withColumn("_offset", offset).withColumn("_how", how.otherwise("unknown"))
    goes_on = F.col("_offset") >= F.when(two, F.col("two_column_indent")).otherwise(F.col("one_column_indent"))
    part = two & ~goes_on & (F.col("_offset") > INDENTED_LABEL[0]) & (F.col("_offset") < INDENTED_LABEL[1])
    df = df.withColumn("_role", F.when(goes_on, "more").when(part, "part").when(F.col("_how") == "title", "title").otherwise("new")).where("_role <> 'title'")
    splits = {
        "column": split_at_column(words, F.col("col_info") + F.col("tolerance")), "equals": split_at_word(words, "="), "dash": split_at_word(words, f"{DASH}{{1,3}}"),
        "colon": split_at_word(words, r".*\p{L}:", include=True), "dashes": split_at_word(words, f"{DASH}{{2,3}}|—"),
    }
    none = F.slice(words, 1, 0)
    sides = F.when(F.col("_role") == "more", F.struct(none.alias("right"), words.alias("left")))
    for name, pair in splits.items():
        sides = sides.when(F.col("_how") == name, pair)
    df = df.withColumn("_sides", sides.otherwise(F.struct(none.alias("right"), none.alias("left"))))
    # in a list from the left, what stands right of the separator explains it
    swap = ~F.col("from_right") & ~two & (F.col("_role") == "new")
    a, b = F.col("_sides.right"), F.col("_sides.left")
    df = df.withColumn("_label", F.when(swap, b).otherwise(a)).withColumn("_info", F.when(swap, a).otherwise(b))
    unread = (F.col("_role") == "new") & ((F.col("_how") == "unknown") | (F.col("_how") == "dash") & (F.size("_info") == 0))
    hebrew = F.when(unread, text.rlike("[א-ת]")).otherwise(F.exists("_info", lambda x: x["text"].rlike("[א-ת]")))
    own = lambda c: F.transform(c, lambda x: F.struct(x["left"].cast("double").alias("left"), x["text"].alias("text")))
    df = df.select("doc_id", "page", "i", "_role", unread.alias("_unread"), hebrew.alias("_hebrew"), F.when(unread, text).alias("_text"), own("_label").alias("_label"), own("_info").alias("_info"))
    # one sort: whether an entry had a Hebrew word before tell the places of its start and of the last such line
    w = Window.partitionBy("doc_id").orderBy("page", "i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    new = F.col("_role") == "new"
    df = df.withColumn("_n", F.row_number().over(w)).withColumns({
        "entry_no": F.sum(new.cast("long")).over(upto), "_start": F.max(F.when(new, F.col("_n"))).over(upto),
        "_last": F.max(F.when(F.col("_hebrew"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, -1)),
    })
    df = df.where("entry_no > 0").withColumn("_had", F.coalesce(F.col("_last") >= F.col("_start"), F.lit(False)))
    read = lambda c: F.array_join(reading_order(F.col(c), F.col("_had")), " ")
    df = df.withColumn("_l", F.when(F.col("_unread"), F.lit("unknown")).otherwise(read("_label"))).withColumn("_i", F.when(F.col("_unread"), F.col("_text")).otherwise(read("_info")))
    pieces = F.sort_array(F.collect_list(F.struct("_n", "_role", "_l", "_i")))
    one = df.groupBy("doc_id", "entry_no").agg(pieces.alias("p"))
    labels = F.array_join(F.transform(F.filter("p", lambda x: x["_role"] != "more"), lambda x: x["_l"]), " ")
    label, info = edited_entry(labels, F.array_join("p._i", " "))
    return one.select("doc_id", "entry_no", label.alias("label"), info.alias("info"))

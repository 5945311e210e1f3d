"""Structure of scanned pages, line by line: boxes of spans and lines, margins, the main type, the
separator of footnotes, and the kind of each line.

Everything is windows over a page and one small table of pages: the kinds are a state machine
whose transitions over a page compose to one of three maps (the list of abbreviations is open after it, it
is not, or it is as before), so that pages are read apart and only these maps are scanned in
page order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import metadata
from .abbreviations import is_centred

PAGE = ["doc_id", "page"]
#: Letters that use the full height of a line.
FULL_HEIGHT = "[אבגדהוזחטכםמנסעפצרשת0-9a-zA-Z]"
HIGH_LINE = 30.0
#: Tolerance of a column's edge by journal.
COLUMN_TOLERANCE = {"תרביץ": 10.0, "לשוננו": 5.0, "מגילות": 3.0, "שנתון": 3.0, "סידרא": 10.0}
#: Titles of lists of abbreviations and sources, and patterns of such titles.
LIST_TITLES = ["קיצורים", "רשימת קיצורים", "רשימת הקיצורים", "מקורות מודפסים ומחקרים", "מחקרים"]
LIST_BEGINS = r"^רשימת ה?קיצורים"
SHORT_LIST = r"^(ה?מקורות|ביבליוגרא?פיה)"
LIST_OF = r"^רשימת.{0,10}(ה?מקורות|ביבליוגרא?פי|ה?קיצור|מאמרים|ספרים|מחקרים)"


def _over(order: list[str] | None = None):
    w = Window.partitionBy(*PAGE)
    return w.orderBy(*order) if order else w


def _upto(order: list[str]):
    return _over(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


# --- repairs of words -----------------------------------------------------------------

#: What recognition makes of frequent words, with the mark of direction behind it.
LTR, RTL = "‎", "‏"
MISREAD = {
    ".קק" + LTR: "pp.", "קק" + LTR: "pp.", "/ס" + LTR: "of", "מס" + LTR: "on", "מסץ" + LTR: "von", "by" + RTL: "על", "‘ay" + RTL: "עמ'",
}
#: Fixed value: the same with one of several first letters; after a quotation mark the direction may be missing.
MISREAD_PAGE = rf"^(?:[nmBhdD]y{RTL}|[‘⸂⸄‛⸌][nmBhdD]y{RTL}?)$"
#: Letters recognised as numbers in entries, in the order in which they are put right.
IN_INFO = [(" 150 על ספר", " ספרי על ספר"), (" 150 ", " ספר "), (" 50 דבי רב", " ספרי דבי רב")]
IN_LABEL = [(" 150 ", " ספר "), ("50 במדבר", "ספרי במדבר")]


def repaired_word(x: Column, width: Column, pages_left: Column) -> Column:
    """A word as it was printed: an empty one of 20 to 30 pixels on one of the last pages (at most 4 left)
    is an equals sign, and the known misreadings are put right."""
    word = F.coalesce(x, F.lit(""))
    fixed = F.when((word == "") & width.between(20, 30) & (pages_left <= 4), F.lit("="))
    for wrong, right in MISREAD.items():
        fixed = fixed.when(word == wrong, F.lit(right))
    return fixed.when(word.rlike(MISREAD_PAGE), F.lit("עמ'")).otherwise(word)


def points_after_letters(x: Column) -> Column:
    """Vowel points that stand before their letters, put behind them."""
    x = F.regexp_replace(x, r"(\p{Mn})(\p{L})\p{Zs}(\p{Mn})", "$2$1$3 ")
    return F.regexp_replace(x, r"(\p{Mn})(\p{L})", "$2$1")


def edited_entry(label: Column, info: Column) -> tuple[Column, Column]:
    """Label and explanation of an entry with numbers that were letters, without marks of direction,
    with plain quotation marks."""
    steps = IN_INFO
    info = F.replace(info, F.lit(steps[0][0]), F.lit(steps[0][1]))
    info = F.trim(F.replace(F.concat(F.lit(" "), info), F.lit(steps[1][0]), F.lit(steps[1][1])))
    info = F.replace(info, F.lit(steps[2][0]), F.lit(steps[2][1]))
    label = F.trim(F.replace(F.concat(F.lit(" "), label), F.lit(IN_LABEL[0][0]), F.lit(IN_LABEL[0][1])))
    label = F.replace(label, F.lit(IN_LABEL[1][0]), F.lit(IN_LABEL[1][1]))
    clean = lambda c: tx.plain_quotes(F.regexp_replace(c, f"[{LTR}{RTL}]", ""))
    return clean(label), clean(info)


# --- spans and lines ------------------------------------------------------------------


def spans(words: DataFrame) -> DataFrame:
    """Words that were recognised (conf >= 0) with ``span_no``: a span ends where block, paragraph or
    line changes."""
    order = _over(["row_no"])
    seen = words.where("conf >= 0")
    changed = F.greatest(*[(F.col(c) != F.lag(c).over(order)).cast("int") for c in ("block_num", "par_num", "line_num")])
    seen = seen.withColumn("_c", F.coalesce(changed, F.lit(0)))
    return seen.withColumn("span_no", F.sum("_c").over(_upto(["row_no"]))).drop("_c")


def span_boxes(words: DataFrame) -> DataFrame:
    """One row for each span: its type size and its box, from the words that have letters (Hebrew ones
    if there are any), top and bottom from those without ascenders and descenders."""
    w = words.withColumn("bottom", F.col("top") + F.col("height")).withColumn("right", F.col("left") + F.col("width"))
    written, hebrew = F.col("text").rlike(r"[\p{L}\p{Nd}]"), tx.has_hebrew(F.col("text"))
    full = F.col("text").rlike(FULL_HEIGHT)
    top_of, bottom_of = full & ~F.col("text").contains(tx.LAMED), full & ~F.col("text").rlike("[ךןףץק]")
    w = w.withColumn("font", tx.label_font_size(F.col("height"), F.col("text")).cast("double"))
    only = lambda cond, c: F.when(cond, F.col(c))
    best = lambda f, c: F.coalesce(f(only(hebrew, c)), f(only(written, c)))
    out = w.groupBy(*PAGE, "span_no").agg(
        F.min("row_no").alias("first_row"), F.min("block_num").alias("block_num"), F.min("left").alias("left"), F.max("right").alias("right"), F.max("height").alias("_height"),
        F.coalesce(best(F.max, "top"), F.max("top")).alias("_top"), F.coalesce(best(F.min, "bottom"), F.min("bottom")).alias("_bottom"), best(F.min, "font").alias("_font"),
        F.min(only(top_of, "top")).alias("_high"), F.min(only(bottom_of, "bottom")).alias("_low"), F.max(written.cast("int")).alias("_written"), F.count("*").alias("n_words"),
        F.array_sort(F.collect_list(F.struct("row_no", "left", "width", "text"))).alias("words"),
    )
    some = F.col("_written") == 1
    out = out.withColumns({"top": F.when(some, F.coalesce("_high", "_top")).otherwise(F.col("_top")), "bottom": F.when(some, F.coalesce("_low", "_bottom")).otherwise(F.col("_bottom"))})
    size = F.when(some, F.least(F.col("bottom") - F.col("top"), F.col("_font"))).otherwise(F.col("_height"))
    return out.withColumn("size", size).drop("_height", "_top", "_bottom", "_font", "_high", "_low", "_written")


def line_boxes(boxes: DataFrame, line: str = "span_no") -> DataFrame:
    """Lines of spans that share ``line``: the union of the boxes, the largest size, spans and their words
    from the right; ``text_size`` is that of the rightmost span."""
    text = lambda s: F.array_join(F.transform(s["words"], lambda w: w["text"]), " ")
    one = F.struct((-F.col("right")).alias("k"), "first_row", "size", "block_num", "words")
    out = boxes.groupBy(*PAGE, F.col(line).alias("line_no")).agg(
        F.array_sort(F.collect_list(one)).alias("spans"), F.min("left").alias("left"), F.max("right").alias("right"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
        F.max("size").alias("size"),
    )
    joined = F.trim(F.regexp_replace(F.array_join(F.transform("spans", text), " "), r"\s+", " "))
    return out.select(
        *PAGE, "line_no", "left", "right", "top", "bottom", "size", F.col("spans")[0]["size"].alias("text_size"), F.col("spans")[0]["block_num"].alias("block_num"),
        points_after_letters(joined).alias("text"), F.flatten("spans.words").alias("words"),
    )


def kept_lines(lines: DataFrame, page_number: Column, page_width: Column) -> DataFrame:
    """The lines of a page from the top, without high and empty ones, a page number at its end and, on the
    first page, those at its end that do not reach the right margin; pages with fewer than two lines
    go. With ``i`` (from 0), margins (the first line has none) and ``main_size``, the type of the widest
    line after the first as they came, the first of equals. Needs line_no, text, left, right, top,
    bottom, size, text_size."""
    df = lines.withColumn("_n", page_number).withColumn("page_width", page_width).where(F.col("size") <= HIGH_LINE)
    later = F.row_number().over(_over(["line_no"])) > 1
    df = df.withColumn("_later", later)
    widest = F.max_by(F.when(F.col("_later"), F.col("text_size")), F.when(F.col("_later"), F.struct(F.col("right") - F.col("left"), -F.col("line_no"))))
    df = df.withColumn("main_size", widest.over(_over())).where("text <> ''")
    order = ["top", "line_no"]

    def numbered(df: DataFrame) -> DataFrame:
        df = df.withColumn("i", F.row_number().over(_over(order)) - 1).withColumn("_lines", F.count("*").over(_over()))
        return df.where("_lines >= 2")

    df = numbered(df)
    below = F.col("i") > 0
    df = df.withColumn("page_right_margin", F.max(F.when(below, F.col("right"))).over(_over()))
    df = df.withColumn("page_left_margin", F.min(F.when(below & (F.col("left") > 0), F.col("left"))).over(_over()))
    centred = is_centred(F.col("left"), F.col("page_width") - F.col("right"), F.col("page_width"))
    df = df.withColumn("is_centred", centred)
    number = (F.col("i") == F.col("_lines") - 1) & F.col("text").rlike(r"^\p{P}*\d+\p{P}*$") & F.col("is_centred")
    df = numbered(df.where(~number))
    full = F.max(F.when((F.col("i") >= 2) & (F.col("page_right_margin") - F.col("right") < 130), F.col("i"))).over(_over())
    df = df.withColumn("_last", F.greatest(F.coalesce(full, F.lit(1)), F.lit(1)))
    return df.where((F.col("_n") != 1) | F.col("_n").isNull() | (F.col("i") <= F.col("_last"))).drop("_n", "_later", "_lines", "_last")


# --- the separator of footnotes -------------------------------------------------------


def gaps(lines: DataFrame) -> DataFrame:
    """Lines with ``gap``, the space to the line before, and whether they begin a block."""
    w = _over(["i"])
    same = F.col("block_num") == F.lag("block_num").over(w)
    return lines.withColumn("gap", F.col("top") - F.lag("bottom").over(w)).withColumn("new_block", ~F.coalesce(same, F.lit(False)))


def gap_counts(lines: DataFrame) -> DataFrame:
    """How often each space between lines occurs on a page."""
    return gaps(lines).where("gap is not null").groupBy(*PAGE, "gap").agg(F.count("*").alias("n"))


def without_tail(x: Column) -> Column:
    return F.regexp_replace(x, r"\P{L}+$", "")


def footnote_separators(lines: DataFrame, labels: DataFrame | None = None, least_height: Column | None = None) -> DataFrame:
    """(doc_id, page, i) of the first line of a page's footnotes.

    From the bottom, down to the fourth line, the first line whose gap exceeds the gap below it (0 at the
    end) and the page's mean by more than ten times sqrt(variance) / n. There is none where that line,
    one of the two after it or the one before it is a title of a list (``labels``: doc_id, label) or of a part of
    one, where it is centred, or (``least_height``) where the lines of a page cover less than that.
    """
    w = _over(["i"])
    df = gaps(lines).withColumn("_key", without_tail(F.col("text")))
    if labels is not None:
        known = labels.select("doc_id", F.col("label").alias("_key"), F.lit(True).alias("_known")).distinct()
        df = df.join(known, ["doc_id", "_key"], "left")
    title = metadata.is_subtype(F.col("_key")) | (F.coalesce("_known", F.lit(False)) if labels is not None else F.lit(False))
    df = df.withColumn("_title", title)
    near = F.col("_title") | F.coalesce(F.lag("_title").over(w), F.lit(False)) | F.coalesce(F.lead("_title", 1).over(w), F.lit(False)) | F.coalesce(F.lead("_title", 2).over(w), F.lit(False))
    mean, count = F.avg("gap").over(_over()), F.count("gap").over(_over())
    spread = F.sqrt(F.greatest(F.avg(F.col("gap") * F.col("gap")).over(_over()) - mean * mean, F.lit(0.0))) / count
    beyond = F.col("gap") - F.coalesce(F.lead("gap").over(w), F.lit(0.0)) - mean > 10 * spread
    df = df.withColumn("_hit", beyond & (F.col("i") >= 3)).withColumn("_stop", near | F.col("is_centred"))
    if least_height is not None:
        df = df.withColumn("_hit", F.col("_hit") & (F.max("bottom").over(_over()) - F.min("top").over(_over()) > least_height))
    found = df.where("_hit").groupBy(*PAGE).agg(F.max("i").alias("i"), F.max_by("_stop", "i").alias("_stop"))
    return found.where("not _stop").select(*PAGE, "i")


# --- kinds of lines -------------------------------------------------------------------


def is_list_title(text: Column) -> Column:
    """Titles at which a list of abbreviations or sources begins, with or without blanks."""
    own, tight = without_tail(text), F.regexp_replace(without_tail(text), r"\s+", "")
    either = lambda f: f(own) | f(tight)
    return text.rlike(LIST_BEGINS) | either(lambda x: x.isin(LIST_TITLES) | ((F.length(x) < 25) & x.rlike(SHORT_LIST)) | x.rlike(LIST_OF))


def line_kinds(lines: DataFrame, separators: DataFrame) -> DataFrame:
    """``lines`` (doc_id, page, i, n_words, size, main_size, is_centred, is_title, right, page_right_margin,
    tolerance, new_block) with ``kind``: HEADER, TEXT, ABBREV or FOOTNOTE.

    A page begins with its header, or with the list of abbreviations that was open before it. The first line of
    the main size after the first is text; a list's title begins the list (one that reaches the right margin only at
    the start of a block), a centred line of at most four words that is no such title ends it, with the
    list closed for later pages; from the separator on all is footnotes, after which a list that was open
    goes on on the next page.
    """
    df = lines.join(separators.select(*PAGE, F.col("i").alias("_sep")), PAGE, "left")
    upto = _upto(["i"])
    before = F.coalesce(F.col("i") < F.col("_sep"), F.lit(True))
    at_margin = F.col("page_right_margin") - F.col("right") <= 2 * F.col("tolerance")
    title = before & F.col("is_title") & ~(at_margin & ~F.col("new_block"))
    leaves = before & ~title & F.col("is_centred") & (F.col("n_words") <= 4)
    main = before & (F.col("size") == F.col("main_size")) & (F.col("i") > 0)
    df = df.withColumns({"_title": F.when(title, F.col("i")), "_leave": F.when(leaves, F.col("i")), "_main": F.coalesce(main, F.lit(False))})
    # what a page does to an open or closed list: opens it, closes it, or (null) leaves it as it is
    pages = df.groupBy(*PAGE).agg(F.max("_title").alias("t"), F.max("_leave").alias("l"))
    pages = pages.withColumn("sets", F.when(F.col("t").isNotNull(), F.col("t") > F.coalesce("l", F.lit(-1))).when(F.col("l").isNotNull(), F.lit(False)))
    earlier = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("_open", F.coalesce(F.last("sets", ignorenulls=True).over(earlier), F.lit(False)))
    df = df.join(pages.select(*PAGE, "_open"), PAGE)
    df = df.withColumns({"_t": F.max("_title").over(upto), "_l": F.max("_leave").over(upto), "_m": F.max("_main").over(upto)})
    listed = F.when(F.col("_t").isNotNull(), F.col("_t") > F.coalesce("_l", F.lit(-1))).otherwise(F.col("_open") & F.col("_l").isNull())
    kind = (
        F.when(F.col("i") >= F.col("_sep"), F.lit("FOOTNOTE")).when(listed, F.lit("ABBREV"))
        .when(F.col("_open") | F.col("_t").isNotNull() | F.col("_m"), F.lit("TEXT")).otherwise(F.lit("HEADER"))
    )
    return df.withColumn("kind", kind).drop("_sep", "_title", "_leave", "_main", "_open", "_t", "_l", "_m")


def list_lines(kinds: DataFrame) -> DataFrame:
    """The lines of lists that hold entries: no titles in the middle of a page, not a page's first line."""
    centred = F.col("is_centred") & (F.col("n_words") <= 4)
    return kinds.where((F.col("kind") == "ABBREV") & ~centred & (F.col("i") > 0))

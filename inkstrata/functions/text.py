"""Text expressions of the layout and corpus parts; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Hebrew letters as in right-to-left text, and marks of direction.
HEBREW = r"[֐-׿יִ-ﭏ‏]"
BIDI_MARKS = r"[‎‏‪-‮⁦-⁩]"
#: What stands for a double quotation mark.
QUOTES = "[«»“”„‟❝❞❠〞〟＂🙶🙷🙸״]"
#: Letters with ascenders and descenders in the effective font size.
ASCENDERS = "[לA-Zbdfhklt]"
DESCENDERS = "[ךןףץקgjpqy]"
LABEL_DESCENDERS = "[ךןףץקygqQ]"
LAMED = "ל"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def first_digits(x: Column, otherwise: Column | None = None) -> Column:
    """The first run of digits; without one ``otherwise`` (default: x itself)."""
    found = F.regexp_extract(x, r"(\d+)", 1)
    return F.when(found != "", found).otherwise(x if otherwise is None else otherwise)


def last_digits(x: Column, otherwise: Column | None = None) -> Column:
    found = F.regexp_extract(x, r"(\d+)\D*$", 1)
    return F.when(found != "", found).otherwise(x if otherwise is None else otherwise)


def page_number(x: Column) -> Column:
    """All digits joined; null without a digit."""
    return F.regexp_replace(x, r"\D", "").try_cast("bigint")


def page_is_even(x: Column) -> Column:
    """A page name without digits counts as odd."""
    return F.coalesce(page_number(x) % 2 == 0, F.lit(False))


def unsigned(x: Column) -> Column:
    """The leading digits as a number, else 0: a lenient cast."""
    return F.coalesce(F.regexp_extract(x, r"^\s*(\d+)", 1).try_cast("bigint"), F.lit(0))


def strip_suffixes(x: Column, suffixes: list[str]) -> Column:
    for s in suffixes:
        x = F.replace(x, F.lit(s), F.lit(""))
    return x


def strip_control(x: Column) -> Column:
    return F.regexp_replace(x, r"[\x00-\x1F\x7F-\u009F]", "")


def strip_bidi(x: Column) -> Column:
    return F.regexp_replace(x, BIDI_MARKS, "")


def plain_quotes(x: Column) -> Column:
    return F.regexp_replace(x, QUOTES, '"')


def letters(x: Column, length: int | None = None) -> Column:
    out = F.regexp_replace(x, r"\P{L}", "")
    return out if length is None else F.substring(out, 1, length)


def has_hebrew(x: Column) -> Column:
    return x.rlike("[א-ת]")


def close_labels(a: Column, b: Column, most: int = 2) -> Column:
    """Edit distance of the first ten letters of at most ``most``."""
    return F.levenshtein(letters(a, 10), letters(b, 10), most) >= 0


def _font_size(height: Column, text: Column, up: Column, down: Column) -> Column:
    plain = F.when(text.contains(","), height - 3).otherwise(height)
    return F.when(up & down, (height / 2).cast("int")).when(up | down, (height * 2 / 3).cast("int")).otherwise(plain)


def effective_font_size(height: Column, text: Column, ascenders: str = ASCENDERS, descenders: str = DESCENDERS) -> Column:
    """The height without ascenders and descenders, truncated: with one of both two thirds,
    with both half; plain words lose 3 for a comma."""
    return _font_size(height, text, text.rlike(ascenders), text.rlike(descenders))


def only_full_line(text: Column) -> Column:
    """No ascender, no descender, and something besides yod: the height is the font size."""
    return ~text.rlike(ASCENDERS) & ~text.rlike(DESCENDERS) & text.rlike("[^י]")


def paragraph_font_size(height: Column, text: Column) -> Column:
    """The effective size, or the height of ``only_full_line``; each pattern is tried once, also inside a lambda."""
    kinds = F.array(F.struct(text.rlike(ASCENDERS).alias("up"), text.rlike(DESCENDERS).alias("down")))
    size = lambda k: F.when(~k["up"] & ~k["down"] & text.rlike("[^י]"), height).otherwise(_font_size(height, text, k["up"], k["down"]).cast("double"))
    return F.transform(kinds, size)[0]


def label_font_size(height: Column, text: Column) -> Column:
    """The abbreviations' variant: the lamed is the only ascender."""
    return effective_font_size(height, text, LAMED, LABEL_DESCENDERS)


def is_close(a: Column, b: Column, absolute: float) -> Column:
    return F.abs(a - b) <= F.lit(absolute) + F.lit(1e-5) * F.abs(b)


def truncated(x: Column, digits: int = 2) -> Column:
    return (x * 10**digits).cast("bigint") / F.lit(float(10**digits))


def reference_start(x: Column) -> Column:
    return x.rlike(r"^\d+[.)]?\s+")


#: How an author's note of thanks or origin begins.
ACKNOWLEDGEMENTS = [
    "ה?(הרצאה|מחקר|מאמר|חיבור) ", "הער[הת] ה?[המ]ערכת", "מתוך (הרצאה|מחקר|מאמר|חיבור) ", "(ראשיתו|עיקרו) של (מחקר|מאמר|חיבור)", "מוקדש",
    "להלן רשימת", "(תודה|תודתי)", "אנו מודים ",
    "(הריני|הרינו|הנני|הננו|אני|אנו|אנחנו|המחבר|המחברים|המחברות) מבקש(ת|ים|ות) להודות ",
    "(הריני|הרינו|הנני|הננו|אני|אנו|אנחנו|המחבר|המחברים|המחברות) (מודה|מודים|מודות) ",
    "ברצוני ", "דברים ש", "ה?דברים ", "חלק(ים)? (מה?|מן ה)(דברים|מאמר|עבודה)", "מוקדש ל", "מתוך ", "עיבוד של ", "עיקרי ה?דברים ", "פרק(ים)? מתוך",
]


def is_acknowledgement(note: Column) -> Column:
    """From its first letter on, a note holds one of the beginnings."""
    return F.regexp_replace(note, r"^\P{L}*", "").rlike("|".join(ACKNOWLEDGEMENTS))

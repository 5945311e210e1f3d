"""What is read out of a paper's metadata: titles in two languages, which titles are no
articles, page ranges, authors, and the kinds of its reference lists. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles of lists of abbreviations, and of bibliographies.
ABBREVIATION_LIST = "^([א-ת]+ )?ה?(קיצורים|ציונים|קיצורים וציונים)( ה?ביבי?ליו?גרא?פי+ים)?$"
ABBREVIATION_TITLES = ["קיצורים", "רשימת קיצורים", "רשימת הקיצורים", "קיצורים ביבליוגרפים"]
ABBREVIATIONS = "קיצורים ביבליוגרפים"
BIBLIOGRAPHY_TITLES = ["ספרות", "מראי מקום", "ביבליוגרפיה", "ביבליוגראפיה", "רשימת מקורות", "המקורות", "מקורות", "רשימת המקורות", "רשימה ביבליוגרפית", "רשימה ביבליוגראפית"]
BIBLIOGRAPHY = "ביבליוגרפיה"
FOOTNOTES = "הערות שוליים"
#: Headings inside a list of abbreviations.
SUBTYPES = r"^([א-ת]\p{Punct}?)?\s*(מקורות|מחקרים|טקסטים|עדי נוסח|כתבי יד|מאמרים|ספרות|ספרי |ספרים|עי?תונות|לשון הדיבור|מדרשים?|משנה|תלמוד|מילונים|מקרא.{0,15}עדי נוסח|מקרא.{0,15}כתבי יד)\s*.{0,10}$"
#: How a label is found in an abbreviation's text, the first that gives two characters.
LABELS = [r"^([^=:—\-]+)[=:—\-]", r"^(\S+)", r"^([^,]+)"]
#: English and Hebrew titles, and titles in any language, that are no articles.
NO_ARTICLE_IN_ENGLISH = ["Abstracts", "Summary", "Errata", "Preface", "Front Matter", "Back Matter", "Books Received", "^Review", "^(English )?Summaries"]
NO_ARTICLE_IN_HEBREW = ["שער קדמי", "שער אחורי", "חומר קדמי", "חומר אחורי", "הקדמה", "פתח דבר", "אחרית דבר"]
NO_ARTICLE = [r"^\[", "ספרים ש.תקבלו ב?מערכת", "הערת העורך|הערת המערכת|מאת המערכת"]
SUMMARIES = "^תקצירים"

_HEBREW = "[א-ת]"
_LATIN = r"\p{IsLatin}"
_NAMED = rf"['{_LATIN}]{{3}}"


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def label_of(x: Column) -> Column:
    """The label an abbreviation's text begins with, without punctuation; empty if none of the
    patterns gives two characters or more."""
    x = _stripped(x)
    found = [F.regexp_replace(_stripped(F.regexp_extract(x, p, 1)), "(?U)[^\\w\\s֐-׿]", "") for p in LABELS]
    return F.coalesce(*[F.when(F.length(f) > 1, f) for f in found], F.lit(""))


def is_abbreviation_list(title: Column) -> Column:
    clean = F.regexp_replace(title, r"\P{L}+$", "")
    return title.rlike(ABBREVIATION_LIST) | (title.contains("קיצור") & title.contains("מקורות")) | clean.isin(ABBREVIATION_TITLES)


def reference_kind(title: Column) -> Column:
    """One name for the variants of a reference list's title; null for footnotes."""
    title = F.when(title == "", F.lit(FOOTNOTES)).otherwise(title)
    kind = F.when(title.rlike(ABBREVIATION_LIST), F.lit(ABBREVIATIONS)).otherwise(title)
    kind = (
        F.when(kind.contains("קיצור") & kind.contains("מקורות"), F.lit(ABBREVIATIONS)).when(kind.isin(BIBLIOGRAPHY_TITLES), F.lit(BIBLIOGRAPHY))
        .when(F.lower(kind).contains("footnotes"), F.lit(FOOTNOTES)).otherwise(kind)
    )
    kind = F.regexp_replace(kind, r"^\[|\]$", "")
    return F.when(kind != FOOTNOTES, kind)


def is_subtype(line: Column) -> Column:
    return line.rlike(SUBTYPES)


def clean_title(title: Column) -> Column:
    title = F.replace(_stripped(title), F.lit("[illegible text]"), F.lit("`"))
    return F.regexp_replace(title, r"(?U)\s+", " ")


def _halves(title: Column, sep: str) -> tuple[Column, Column]:
    """(English, Hebrew) of a title in parts: of more than two, the second and later ones are
    English as long as they hold a Latin word; if all do, the last is the Hebrew one too."""
    parts = F.split(title, sep)
    n = F.size(parts)
    first = F.array_position(F.transform(F.slice(parts, 2, n), lambda p: ~p.rlike(_NAMED)), True).cast("int")
    at = F.when(n == 2, 1).otherwise(first)
    english = F.when(at > 0, F.array_join(F.slice(parts, 1, at), sep)).otherwise(title)
    hebrew = F.when(at > 0, F.array_join(F.slice(parts, at + 1, n), sep)).otherwise(F.get(parts, n - 1))
    return english, hebrew


def split_title(title: Column) -> tuple[Column, Column]:
    """(Hebrew, English) titles of a cleaned title in one or both languages."""
    border = rf"^(.*?{_LATIN}{{2}})/ ({_HEBREW}{{2}}.*)$"
    tail = rf"{_LATIN}{{2}}/ {_HEBREW}{{2}}.*$"
    (slash_e, slash_h), (dash_e, dash_h) = _halves(title, " / "), _halves(title, " - ")
    one = F.when(~title.rlike(_LATIN), F.lit("h")).when(~title.rlike(_HEBREW), F.lit("e")).when(title.contains(" / "), F.lit("/")).when(title.contains(" - "), F.lit("-")).when(title.rlike(border), F.lit("b")).otherwise(F.lit("h"))
    english = F.when(one == "h", F.lit("")).when(one == "e", title).when(one == "/", slash_e).when(one == "-", dash_e).otherwise(F.regexp_extract(title, border, 1))
    hebrew = F.when(one == "h", title).when(one == "e", F.lit("")).when(one == "/", slash_h).when(one == "-", dash_h).otherwise(F.regexp_replace(F.regexp_extract(title, border, 2), tail, ""))
    share = lambda x: F.try_divide(F.regexp_count(x, F.lit(_HEBREW)), F.regexp_count(x, F.lit(r"\p{L}")))
    both = (F.length(english) > 0) & (F.length(hebrew) > 0)
    swap = F.coalesce(both & (share(english) > share(hebrew)), F.lit(False))
    english, hebrew = F.when(swap, hebrew).otherwise(english), F.when(swap, english).otherwise(hebrew)
    # Hebrew that stands after a colon in the English part goes to the Hebrew one
    for pattern in (rf"^(.*?{_LATIN}{{2}}): ([א-ת\s]{{5}}.*)$", r"^(.*?\)): ([א-ת\s]{9}.*)$"):
        more = F.regexp_extract(english, pattern, 2)
        move = both & (more != "") & ~hebrew.endswith(more)
        hebrew, english = F.when(move, F.concat(hebrew, F.lit(": "), more)).otherwise(hebrew), F.when(move, F.regexp_extract(english, pattern, 1)).otherwise(english)
    return hebrew, english


def not_an_article(title: Column, hebrew: Column, english: Column) -> Column:
    return english.rlike("(?i)" + "|".join(NO_ARTICLE_IN_ENGLISH)) | hebrew.isin(NO_ARTICLE_IN_HEBREW) | hebrew.rlike(SUMMARIES) | title.rlike("|".join(NO_ARTICLE))


def page_range(x: Column) -> tuple[Column, Column]:
    """(first, last) page of ``p. 7`` or ``pp. 7-9``; anything else is both."""
    x = _stripped(x)
    single, pair = r"(?i)^p\. (.+)$", r"(?i)^pp. (\P{Pd}+)\p{Pd}(\P{Pd}+)"
    one, first, last = F.regexp_extract(x, single, 1), F.regexp_extract(x, pair, 1), F.regexp_extract(x, pair, 2)
    return F.when(one != "", one).when(first != "", first).otherwise(x), F.when(one != "", one).when(first != "", last).otherwise(x)


def _number_after(x: Column, marks: str) -> Column:
    x = F.coalesce(x, F.lit(""))
    found = F.regexp_extract(x, rf"(?iu)({marks})\s+(\S+)", 2)
    return F.when(found != "", found).otherwise(x)


def volume(x: Column) -> Column:
    return _number_after(x, r"vol\.|כרך")


def issue(x: Column) -> Column:
    return _number_after(x, r"num\.|no\.|חוברת")


def abstract(abstracts: Column) -> Column:
    first = _stripped(F.coalesce(F.get(abstracts, F.lit(0)), F.lit("")))
    return F.regexp_replace(F.replace(first, F.lit("[illegible text]"), F.lit("`")), " +", " ")


def authors_in(authors: Column) -> tuple[Column, Column]:
    """(Hebrew, English): the first half of the list, rounded down, and the rest."""
    half = F.floor(F.size(authors) / 2).cast("int")
    return F.array_join(F.slice(authors, F.lit(1), half), ", "), F.array_join(F.slice(authors, half + 1, F.size(authors)), ", ")


def paper_metadata(meta: Column) -> Column:
    """The struct of a paper's metadata from its ``content``; ``skip`` holds the title of what is
    no article, or 'no pages'."""
    title = clean_title(meta["displayTitle"])
    hebrew, english = split_title(title)
    first, last = page_range(meta["pageRange"])
    skip = F.when(not_an_article(title, hebrew, english), title).when(meta["pageRange"].isNull(), F.lit("no pages"))
    he, en = authors_in(meta["authors"])
    return F.struct(
        skip.alias("skip"), hebrew.alias("title_heb"), english.alias("title_eng"), abstract(meta["abstract"]).alias("abstract"), he.alias("authors_heb"), en.alias("authors_eng"),
        first.alias("page_from"), last.alias("page_to"), volume(meta["volume"]).alias("volume"), issue(meta["issue"]).alias("num"),
    )

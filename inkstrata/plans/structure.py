"""Page structure, the orders of mixed lines and lists of abbreviations as queries.

The lines of documents stand for the lines of pages, twenty a page; their lengths give sizes, edges
and spaces, so that every rule of the structure is met by some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..layout import bidi, entries, lines
from .queries import Tables, query

_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
g AS (SELECT doc_id, n // 20 + 1 AS page, n AS line_no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, length(text) AS len,
 (100 + length(text) * 7 % 13 * 20)::DOUBLE AS lft, (1000 - length(text) % 5 * 60)::DOUBLE AS rgt, (n % 20 * 60 + length(text) % 30)::DOUBLE AS top, (n % 20 * 60 + length(text) % 30 + 20)::DOUBLE AS bottom,
 (20 + length(text) % 12)::DOUBLE AS size, n // 3 AS block_num FROM l),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) > 1 AS later FROM g WHERE size <= 30),
m AS (SELECT *, arg_max(CASE WHEN later THEN size END, CASE WHEN later THEN (rgt - lft, -line_no) END) OVER (PARTITION BY doc_id, page) AS main_size FROM a),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY top, line_no) - 1 AS i, count(*) OVER (PARTITION BY doc_id, page) AS c FROM m WHERE text <> ''),
d AS (SELECT *, max(CASE WHEN i > 0 THEN rgt END) OVER p AS page_right_margin, min(CASE WHEN i > 0 AND lft > 0 THEN lft END) OVER p AS page_left_margin,
 coalesce(least(lft, 1100 - rgt) / nullif(greatest(lft, 1100 - rgt), 0) >= 0.9 AND least(lft, 1100 - rgt) > 275, false) AS is_centred FROM b WHERE c >= 2 WINDOW p AS (PARTITION BY doc_id, page)),
e AS (SELECT * EXCLUDE (i, c), row_number() OVER (PARTITION BY doc_id, page ORDER BY top, line_no) - 1 AS i, count(*) OVER (PARTITION BY doc_id, page) AS c FROM d
 WHERE NOT (i = c - 1 AND regexp_matches(text, '^\\pP*\\d+\\pP*$') AND is_centred)),
f AS (SELECT *, max(CASE WHEN i >= 2 AND page_right_margin - rgt < 130 THEN i END) OVER (PARTITION BY doc_id, page) AS full_to FROM e WHERE c >= 2),
kept AS (SELECT * FROM f WHERE page <> 1 OR i <= greatest(coalesce(full_to, 1), 1)),
"""
_SEPARATORS = _LINES + """k AS (SELECT *, regexp_replace(text, '\\PL+$', '') AS key, top - lag(bottom) OVER (PARTITION BY doc_id, page ORDER BY i) AS gap FROM kept),
labels AS (SELECT DISTINCT doc_id, regexp_replace(text, '\\PL+$', '') AS key, true AS known FROM kept WHERE len % 29 = 0),
t AS (SELECT k.*, coalesce(known, false) AS title FROM k LEFT JOIN labels USING (doc_id, key)),
h AS (SELECT *, avg(gap) OVER p AS mean, sqrt(greatest(avg(gap * gap) OVER p - (avg(gap) OVER p) ^ 2, 0)) / count(gap) OVER p AS spread, coalesce(lead(gap) OVER o, 0) AS below,
 title OR coalesce(lag(title) OVER o, false) OR coalesce(lead(title) OVER o, false) OR coalesce(lead(title, 2) OVER o, false) OR is_centred AS stop
 FROM t WINDOW p AS (PARTITION BY doc_id, page), o AS (PARTITION BY doc_id, page ORDER BY i)),
sep AS (SELECT doc_id, page, max(i) AS i FROM h WHERE i >= 3 AND gap - below - mean > 10 * spread GROUP BY ALL HAVING NOT arg_max(stop, i))
"""


def _lines(spark, sf_dir) -> DataFrame:
    l = Tables(spark, sf_dir).documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw"))  # noqa: E741
    size, n = F.length("raw"), F.col("n")
    top = n % 20 * 60 + size % 30
    df = l.select(
        "doc_id", (F.floor(n / 20) + 1).alias("page"), n.alias("line_no"), F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("text"), size.alias("len"), (100 + size * 7 % 13 * 20).cast("double").alias("left"),
        (1000 - size % 5 * 60).cast("double").alias("right"), top.cast("double").alias("top"), (top + 20).cast("double").alias("bottom"), (20 + size % 12).cast("double").alias("size"), F.floor(n / 3).alias("block_num"),
    )
    return lines.kept_lines(df.withColumn("text_size", F.col("size")), F.col("page"), F.lit(1100.0))


@query("WITH " + _LINES + "x AS (SELECT 1) SELECT doc_id, page, i, line_no, main_size, page_right_margin, page_left_margin, is_centred FROM kept")
def page_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "page", "i", "line_no", "main_size", "page_right_margin", "page_left_margin", "is_centred")


@query("WITH " + _LINES + "k AS (SELECT doc_id, page, top - lag(bottom) OVER (PARTITION BY doc_id, page ORDER BY i) AS gap FROM kept) SELECT doc_id, page, gap, count(*) AS n FROM k WHERE gap IS NOT NULL GROUP BY ALL")
def gap_counts(spark, sf_dir):
    return lines.gap_counts(_lines(spark, sf_dir))


def _separators(df: DataFrame) -> DataFrame:
    return lines.footnote_separators(df, df.where("len % 29 = 0").select("doc_id", lines.without_tail(F.col("text")).alias("label")))


@query("WITH " + _SEPARATORS + "SELECT doc_id, page, i FROM sep")
def footnote_separators(spark, sf_dir):
    return _separators(_lines(spark, sf_dir))


@query(
    "WITH " + _SEPARATORS + """, u AS (SELECT kept.*, len(string_split(kept.text, ' ')) AS n_words, coalesce(block_num <> lag(block_num) OVER (PARTITION BY kept.doc_id, kept.page ORDER BY kept.i), true) AS new_block,
 sep.i AS sep FROM kept LEFT JOIN sep ON kept.doc_id = sep.doc_id AND kept.page = sep.page),
v AS (SELECT doc_id, page, i, (CASE WHEN i = 0 THEN 'P' ELSE '' END) || CASE WHEN i = sep THEN 'F' WHEN len % 17 = 0 AND NOT (page_right_margin - rgt <= 10 AND NOT new_block) THEN CASE WHEN size = main_size AND i > 0 THEN 'T' ELSE 't' END
 WHEN is_centred AND n_words <= 4 THEN CASE WHEN size = main_size AND i > 0 THEN 'C' ELSE 'c' END WHEN size = main_size AND i > 0 THEN 'M' ELSE 'o' END AS events FROM u),
w AS (SELECT doc_id, list_reduce(list_prepend('h', string_split(string_agg(events, '' ORDER BY page, i), '')), lambda s, e: s || CASE
 WHEN e = 'P' THEN CASE WHEN right(s, 1) IN ('a', 'n') THEN 'a' ELSE 'h' END
 WHEN right(s, 1) = 'f' OR right(s, 1) = 'n' THEN right(s, 1)
 WHEN e = 'F' THEN CASE WHEN right(s, 1) = 'a' THEN 'n' ELSE 'f' END
 WHEN e IN ('T', 't') THEN 'a'
 WHEN right(s, 1) = 'a' THEN CASE WHEN e IN ('C', 'c') THEN 't' ELSE 'a' END
 WHEN right(s, 1) = 'h' AND e IN ('C', 'M') THEN 't' ELSE right(s, 1) END) AS states, string_agg(events, '' ORDER BY page, i) AS events, list({'page': page, 'i': i} ORDER BY page, i) AS places FROM v GROUP BY doc_id),
x AS (SELECT doc_id, places, list_filter(list_transform(string_split(events, ''), lambda e, k: CASE WHEN e <> 'P' THEN states[k + 1] END), lambda y: y IS NOT NULL) AS kinds FROM w),
y AS (SELECT doc_id, unnest(places) AS place, unnest(kinds) AS kind FROM x)
SELECT doc_id, place.page AS page, place.i AS i, CASE kind WHEN 'h' THEN 'HEADER' WHEN 't' THEN 'TEXT' WHEN 'a' THEN 'ABBREV' ELSE 'FOOTNOTE' END AS kind FROM y"""
)
def line_kinds(spark, sf_dir):
    """The SQL goes through each document's lines one by one."""
    df = _lines(spark, sf_dir)
    marked = lines.gaps(df).withColumns({"n_words": F.size(F.split("text", " ")), "is_title": F.col("len") % 17 == 0, "tolerance": F.lit(5.0)})
    return lines.line_kinds(marked, _separators(df)).select("doc_id", "page", "i", "kind")


_MIXED = """w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS p FROM documents),
s AS (SELECT doc_id, p // 8 AS line, p % 8 AS k, (CASE WHEN p // 8 % 3 = 0 THEN p * 5 % 8 ELSE p % 8 END * 90 * CASE WHEN p // 8 % 3 = 1 THEN -1 ELSE 1 END)::DOUBLE AS lft,
 CASE WHEN length(word) % 7 = 3 THEN '(' ELSE '' END || CASE WHEN length(word) % 5 < 2 THEN translate(word, 'abcdefghijklmnopqrstuvwxyz', 'אבגדהוזחטיכלמנסעפצקרשתםןףך') WHEN length(word) % 5 = 2 THEN '12' ELSE word END
 || CASE WHEN length(word) % 7 = 4 THEN ')' ELSE '' END || CASE WHEN length(word) % 11 = 5 THEN chr(8206) WHEN length(word) % 11 = 7 THEN chr(8207) ELSE '' END AS text FROM w WHERE word <> ''),
"""
_BY_LETTERS = """r AS (SELECT *, row_number() OVER o AS q, count(*) OVER (PARTITION BY doc_id, line) AS c, regexp_matches(text, '[א-ת]') AS heb, regexp_matches(text, '^\\PL+$') AS plain FROM s WINDOW o AS (PARTITION BY doc_id, line ORDER BY lft DESC, k)),
d AS (SELECT *, coalesce(last_value(CASE WHEN heb THEN true WHEN plain THEN NULL ELSE false END IGNORE NULLS) OVER (o ROWS UNBOUNDED PRECEDING), first_value(heb) OVER o) AS right_ FROM r WINDOW o AS (PARTITION BY doc_id, line ORDER BY q)),
e AS (SELECT *, bool_or(right_) OVER (o ROWS UNBOUNDED PRECEDING) AS had, right_ IS DISTINCT FROM lag(right_) OVER o AS new FROM d WINDOW o AS (PARTITION BY doc_id, line ORDER BY q)),
f AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, line ORDER BY q ROWS UNBOUNDED PRECEDING) AS run FROM e),
g AS (SELECT *, count(*) OVER z AS m, row_number() OVER (z ORDER BY q DESC) AS place, arg_max(text, q) OVER z AS head, arg_min(text, q) OVER z AS tail FROM f WINDOW z AS (PARTITION BY doc_id, line, run)),
h AS (SELECT *, regexp_extract(tail, '([\\pP\\pS]*\\)[' || chr(8206) || chr(8207) || ']?)$', 1) AS closing, regexp_extract(head, '^(\\([\\pP\\pS]*)', 1) AS opening, NOT right_ AND had AND m > 1 AND c > 1 AS turn FROM g),
i AS (SELECT *, regexp_replace(reverse(translate(closing, '()[]', ')(][')), '[' || chr(8206) || chr(8207) || ']', '', 'g') AS to_front, regexp_replace(reverse(translate(opening, '()[]', ')(][')), '[' || chr(8206) || chr(8207) || ']', '', 'g') AS to_end FROM h),
j AS (SELECT doc_id, line, string_agg(CASE WHEN turn AND place = 1 THEN CASE WHEN opening <> '' THEN substr(text, length(opening) + 1) ELSE to_front || text END
 WHEN turn AND place = m THEN left(text, length(text) - length(closing)) || to_end ELSE text END, ' ' ORDER BY run, CASE WHEN right_ THEN q ELSE -q END) AS by_letters FROM i GROUP BY 1, 2),
"""
_BY_MARKS = """a1 AS (SELECT *, count(*) OVER z AS c, max(lft) OVER z AS far, min(lft) OVER z AS near, arg_min(lft, k) OVER z AS first_, arg_max(lft, k) OVER z AS last_ FROM s WINDOW z AS (PARTITION BY doc_id, line)),
a2 AS (SELECT *, (far <> first_ AND far <> last_) OR (far = first_ AND near = last_) AS main FROM a1),
a3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY CASE WHEN main THEN -lft ELSE lft END, k) AS q, text LIKE '%' || chr(8206) AS l, text LIKE '%' || chr(8207) AS r, regexp_matches(text, '[א-ת]') AS heb FROM a2),
a4 AS (SELECT *, CASE WHEN q > 1 AND l THEN false WHEN q > 1 AND r THEN true WHEN main AND lead(heb) OVER o THEN true END AS sets,
 CASE WHEN main AND first_value(r) OVER o THEN false WHEN NOT main AND first_value(l) OVER o THEN true ELSE main END AS begin_ FROM a3 WINDOW o AS (PARTITION BY doc_id, line ORDER BY q)),
a5 AS (SELECT *, coalesce(last_value(sets IGNORE NULLS) OVER (PARTITION BY doc_id, line ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), begin_) = main AS own FROM a4),
a6 AS (SELECT *, own IS DISTINCT FROM lag(own) OVER (PARTITION BY doc_id, line ORDER BY q) AS new FROM a5),
a7 AS (SELECT *, max(CASE WHEN new THEN q END) OVER (PARTITION BY doc_id, line ORDER BY q ROWS UNBOUNDED PRECEDING) AS run FROM a6),
a8 AS (SELECT doc_id, line, string_agg(text, ' ' ORDER BY CASE WHEN c = 1 OR (NOT main AND NOT own) THEN 0 WHEN main THEN run ELSE 1 END, CASE WHEN own THEN q ELSE -q END) AS by_marks FROM a7 GROUP BY 1, 2)
"""


@query("WITH " + _MIXED + _BY_LETTERS + _BY_MARKS + "SELECT doc_id, line, by_letters, by_marks FROM j JOIN a8 USING (doc_id, line)")
def reading_orders(spark, sf_dir):
    """Eight words of a document as a line of mixed script, in two orders."""

    def word(x):
        p, line, n = x["p"], x["line"], x["n"]
        left = (F.when(line % 3 == 0, p * 5 % 8).otherwise(p % 8) * 90 * F.when(line % 3 == 1, -1).otherwise(1)).cast("double")
        body = F.when(n % 5 < 2, F.translate(x["word"], "abcdefghijklmnopqrstuvwxyz", "אבגדהוזחטיכלמנסעפצקרשתםןףך")).when(n % 5 == 2, F.lit("12")).otherwise(x["word"])
        mark = F.when(n % 11 == 5, F.lit(bidi.LEFT_MARK)).when(n % 11 == 7, F.lit(bidi.RIGHT_MARK)).otherwise("")
        return F.struct(left.alias("left"), F.concat(F.when(n % 7 == 3, "(").otherwise(""), body, F.when(n % 7 == 4, ")").otherwise(""), mark).alias("text"))

    def lines_of(ws):
        places = lambda line: F.sequence(line * 8, F.least(line * 8 + 7, F.size(ws).cast("long") - 1))
        words = lambda line: F.filter(F.transform(places(line), lambda p: F.struct(p.alias("p"), line.alias("line"), ws[p.cast("int")].alias("word"), F.length(ws[p.cast("int")]).alias("n"))), lambda x: x["word"] != "")
        return F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.size(ws) - 1) / 8)), lambda line: F.struct(line.alias("line"), words(line).alias("words")))

    # a line's words stand together in their text, so that lines are cut where the text is
    own = Tables(spark, sf_dir).documents.where("text is not null").select("doc_id", F.explode(bidi.bound(F.split("text", " "), lines_of)).alias("l")).where(F.size("l.words") > 0)
    own = own.select("doc_id", "l.line", F.transform("l.words", word).alias("words"))
    joined = lambda order: F.array_join(order(F.col("words")), " ")
    return own.select("doc_id", "line", joined(bidi.reading_order).alias("by_letters"), joined(bidi.marked_order).alias("by_marks"))


@query()
def abbreviation_entries(spark, sf_dir):
    """The lines of a document as a list of entries, whose margins and separators come from their lengths.
    The bins of edges are greedy, so the tests hold the result against a loop."""
    l = Tables(spark, sf_dir).documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw")).where("raw <> ''")  # noqa: E741
    right = lambda w: w["left"] + w["width"]

    def line(x):
        size = x["size"]
        sep = F.when(size % 2 == 0, F.lit("=")).otherwise(F.lit("--"))
        texts = lambda ts: F.when(size % 4 > 0, F.concat(F.slice(ts, 1, 1), F.array(sep), F.slice(ts, 2, 5))).otherwise(ts)
        words = lambda ts: F.transform(ts, lambda t, k: F.struct(k.alias("row_no"), (100 + F.when(size % 3 == 0, 40).otherwise(0) + k * 120).cast("double").alias("left"), (F.least(F.length(t), F.lit(10)) * 10).cast("double").alias("width"), t.alias("text")))
        edges = lambda ts, ws: F.struct(F.array_join(ts, " ").alias("text"), ws.alias("words"), F.array_min(F.transform(ws, lambda w: w["left"])).alias("left"), F.array_max(F.transform(ws, right)).alias("right"))
        return bidi.bound(texts(x["texts"]), lambda ts: bidi.bound(words(ts), lambda ws: edges(ts, ws)))

    first = F.struct(F.length("raw").alias("size"), F.split(F.substring_index("raw", " ", 6), " ").alias("texts"))
    n = F.col("n")
    df = l.select("doc_id", (F.floor(n / 20) + 1).alias("page"), (n % 20).alias("i"), F.inline(F.transform(F.array(first), line)))
    df = df.withColumns({"page_right_margin": F.lit(1000.0), "page_left_margin": F.lit(100.0), "journal": F.lit("לשוננו")})
    return entries.entries(entries.with_indents(df, entries.journals(spark)))

"""Abbreviation lists, reference lists and page structure of scanned papers."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import sequence
from . import metadata

#: What separates a label from its explanation.
SEPARATOR = r"\s*(?:=|[-–—]\s|:)\s*"


def has_abbreviations(meta: DataFrame) -> DataFrame:
    """doc_id of the papers with a list of abbreviations or a bibliography."""
    kinds = F.transform("content.references.reference_blocks", lambda b: metadata.reference_kind(b["title"]))
    return meta.where(F.exists(kinds, lambda k: k.isin(metadata.ABBREVIATIONS, metadata.BIBLIOGRAPHY))).select("doc_id")


def assembled(df: DataFrame, by: list[str], order: list[str], indent: Column, threshold: float, text: str) -> DataFrame:
    """Entries of an abbreviation list: a line indented by ``threshold`` or more continues the
    entry before, others start one; (by, entry_no, label, info), label 'unknown' where a line
    has no separator."""
    df = sequence.running_id(df.withColumn("_start", indent < threshold), by, order, F.col("_start"), "entry_no")
    one = sequence.ordered_text(df, [*by, "entry_no"], order, text, " ", "entry")
    parts = F.split("entry", SEPARATOR, 2)
    whole = F.size(parts) < 2
    label = F.when(whole, F.lit("unknown")).otherwise(F.trim(parts[0]))
    return one.select(*by, "entry_no", tx.plain_quotes(label).alias("label"), F.when(whole, F.col("entry")).otherwise(F.trim(parts[1])).alias("info"))


def partitioned(notes: DataFrame, labels: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(abbreviations, regular footnotes): a note is an abbreviation if its own label, without
    marks and case, is one of the known labels."""
    key = lambda c: F.lower(tx.plain_quotes(F.trim(c)))
    rows = notes.withColumn("_k", key(metadata.label_of(F.col(text))))
    known = labels.select(key(F.col("label")).alias("_k")).distinct()
    return rows.join(known, "_k", "left_semi").drop("_k"), rows.join(known, "_k", "left_anti").drop("_k")


def superscripts(df: DataFrame, by: list[str]) -> DataFrame:
    """Digit-only spans smaller than 0.7 of the line's size on its top line become <fn-N>."""
    w = Window.partitionBy(*by)
    mark = F.col("text").rlike(r"^\d+$") & (F.col("font_size") < 0.7 * F.max("font_size").over(w)) & (F.abs(F.col("top") - F.min("top").over(w)) < 1)
    return df.withColumn("text", F.when(mark, F.concat(F.lit("<fn-"), F.col("text"), F.lit(">"))).otherwise(F.col("text")))


def is_centred(left: Column, right: Column, width: Column) -> Column:
    big = F.greatest(left, right)
    return F.coalesce((F.try_divide(F.least(left, right), big) >= 0.9) & (F.least(left, right) > width / 4), F.lit(False))


def tolerance_bins(values: Column, tolerance: float) -> Column:
    """Greedy bins over an array in its order: a value joins the first bin within the
    tolerance of its first value. Array of (start, n)."""
    empty = F.array().cast("array<struct<start:double,n:int>>")

    def step(bins: Column, x: Column) -> Column:
        hit = F.array_position(F.transform(bins, lambda b: F.abs(b["start"] - x) <= tolerance), True)
        grown = F.transform(bins, lambda b, i: F.struct(b["start"].alias("start"), F.when(i == hit - 1, b["n"] + 1).otherwise(b["n"]).alias("n")))
        new = F.concat(bins, F.array(F.struct(x.cast("double").alias("start"), F.lit(1).alias("n"))))
        return F.when(hit > 0, grown).otherwise(new)

    return F.aggregate(values, empty, step)


# --- true state machines: one document or page in one group ---------------------------


def banded_lines(words: DataFrame, band: float = 3.0) -> DataFrame:
    """Greedy lines of a page: a word joins the first line whose top or bottom is within the
    band, else the line of its block and paragraph, else starts one. A page is a group."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("row_no")
        lines: list[list[float]] = []
        home: dict[tuple, int] = {}
        out = []
        for top, height, block, par in zip(f["top"], f["height"], f["block_num"], f["par_num"], strict=True):
            low = top + height
            at = next((i for i, (a, b) in enumerate(lines) if abs(a - top) <= band or abs(b - low) <= band), None)
            if at is None:
                at = home.get((block, par))
            if at is None:
                at = len(lines)
                lines.append([top, low])
            lines[at] = [min(lines[at][0], top), max(lines[at][1], low)]
            home[block, par] = at
            out.append(at)
        return pd.DataFrame({"doc_id": f["doc_id"], "page": f["page"], "row_no": f["row_no"], "line_no": np.array(out, dtype=np.int64)})

    kinds = dict(words.dtypes)
    return words.groupBy("doc_id", "page").applyInPandas(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, row_no {kinds['row_no']}, line_no bigint")


def collected_references(rows: DataFrame, end_marker: str) -> DataFrame:
    """References across the sheets of a document: ``1. ...`` in small type starts one, an end
    marker, a time or a line in the main text's size ends it, other lines go on. A document
    is a group, as the state runs over all its pages."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["page", "row_no"])
        main = f["font_size"].dropna().iloc[0] if f["font_size"].notna().any() else np.inf
        out, now, first = [], [], None

        def close():
            if now:
                out.append((f["doc_id"].iloc[0], first, len(out) + 1, " ".join(now)))
                now.clear()

        for page, line, size in zip(f["page"], f["text"].fillna(""), f["font_size"], strict=True):
            small = size is None or np.isnan(size) or size < main
            if end_marker and end_marker in line:
                close()
            elif small and re.match(r"\d+[.)]?\s+", line):
                close()
                first = page
                now.append(line)
            elif now and small and not re.match(r"\d{1,2}:\d{2}", line):
                now.append(line)
            else:
                close()
        close()
        return pd.DataFrame(out, columns=["doc_id", "page", "number", "content"])

    kinds = dict(rows.dtypes)
    return rows.groupBy("doc_id").applyInPandas(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, number bigint, content string")

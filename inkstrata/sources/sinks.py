"""Writers of extracts, reports and the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recode, text
from ..operators.relational import new_rows


def extract_rows(main: DataFrame, notes: DataFrame) -> DataFrame:
    """Type, Page, Number, Content with the main text first."""
    a = main.select("doc_id", F.lit("MainText").alias("Type"), F.col("page").alias("Page"), F.lit(None).cast("int").alias("Number"), F.col("content").alias("Content"))
    b = notes.select("doc_id", F.lit("footnote").alias("Type"), F.col("page").alias("Page"), F.col("number").cast("int").alias("Number"), F.col("text").alias("Content"))
    return a.unionByName(b)


#: Spreadsheets take a file for UTF-8 by this mark at its start.
BYTE_ORDER_MARK = "\ufeff"


def _write_csv(rows: DataFrame, order: list[str], columns: list[str], path: str) -> None:
    """A folder for each document with its rows in order; the mark goes before the header."""
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", *order).select("doc_id", *columns)
    rows = rows.withColumnRenamed(columns[0], BYTE_ORDER_MARK + columns[0])
    rows.write.partitionBy("doc_id").csv(path, header=True, escape='"', mode="overwrite")


def write_extract_csv(main: DataFrame, notes: DataFrame, path: str) -> None:
    rows = extract_rows(main, notes).withColumn("_o", F.when(F.col("Type") == "MainText", 0).otherwise(1))
    _write_csv(rows, ["_o", "Number", "Page"], ["Type", "Page", "Number", "Content"], path)


def numbered_by_page(notes: DataFrame) -> DataFrame:
    """Footnotes numbered anew in the order of their pages' names."""
    w = Window.partitionBy("doc_id").orderBy("page", "number")
    return notes.withColumn("number", F.row_number().over(w))


def xml_pages(main: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id and one element a page: main text, then footnotes with numbers; direction marks
    removed."""
    own = numbered_by_page(notes).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct(F.col("number").alias("_number"), F.col("page").alias("_page"), text.strip_bidi(F.col("text")).alias("_VALUE")))).alias("footnote"))
    page = main.join(own, ["doc_id", "page"], "full")
    return page.select("doc_id", F.struct(F.col("page").alias("_name"), text.strip_bidi(F.col("content")).alias("MainText"), "footnote").alias("Page"))


def _documents(elements: Column, root: str) -> Column:
    """An XML document of a struct of elements."""
    return F.concat(F.lit("<?xml version='1.0' encoding='utf-8'?>\n"), F.to_xml(elements, {"rowTag": root}))


def extract_xml(main: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, value): the XML document of each extract, pages in the order of their names."""
    pages = xml_pages(main, notes).groupBy("doc_id").agg(F.sort_array(F.collect_list("Page")).alias("Page"))
    return pages.select("doc_id", _documents(F.struct("Page"), "footnotes").alias("value"))


def write_documents(documents: DataFrame, path: str) -> None:
    """Each document in a folder of its own."""
    documents.repartition("doc_id").select("doc_id", "value").write.partitionBy("doc_id").mode("overwrite").text(path)


def write_extract_xml(main: DataFrame, notes: DataFrame, path: str) -> None:
    write_documents(extract_xml(main, notes), path)


def integrated_rows(main: DataFrame, notes: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Type, Page, Number, Label, Content, Source of main texts, footnotes and abbreviations
    (doc_id, page, label, info, source; the page of one from metadata is null)."""
    none = F.lit("")
    a = main.select("doc_id", F.lit(0).alias("_o"), F.lit("MainText").alias("Type"), F.col("page").alias("Page"), F.lit(None).cast("int").alias("Number"), none.alias("Label"), F.col("content").alias("Content"), F.lit("ocr").alias("Source"))
    b = notes.select("doc_id", F.lit(1).alias("_o"), F.lit("Footnote").alias("Type"), F.col("page").alias("Page"), F.col("number").cast("int").alias("Number"), none.alias("Label"), F.col("text").alias("Content"), F.lit("ocr").alias("Source"))
    c = abbreviations.select("doc_id", F.lit(2).alias("_o"), F.lit("Abbreviation").alias("Type"), F.coalesce("page", none).alias("Page"), F.lit(None).cast("int").alias("Number"), F.coalesce("label", none).alias("Label"), F.coalesce("info", none).alias("Content"), F.coalesce("source", none).alias("Source"))
    return a.unionByName(b).unionByName(c)


def integrated_xml(main: DataFrame, notes: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """(doc_id, value): main_text/page, footnotes/footnote and abbreviations/abbreviation."""
    rows = integrated_rows(main, notes, abbreviations)
    order = ["Number", "Page", "Source", "Label"]
    pick = lambda kind, *fields: F.transform(
        F.sort_array(F.collect_list(F.when(F.col("Type") == kind, F.struct(*order, "Content")))), lambda x: F.struct(*[x[c].alias(n) for c, n in fields], x["Content"].alias("_VALUE"))
    )
    own = rows.groupBy("doc_id").agg(
        F.struct(pick("MainText", ("Page", "_name")).alias("page")).alias("main_text"),
        F.struct(pick("Footnote", ("Number", "_number"), ("Page", "_page")).alias("footnote")).alias("footnotes"),
        F.struct(pick("Abbreviation", ("Label", "_label"), ("Source", "_source"), ("Page", "_page")).alias("abbreviation")).alias("abbreviations"),
    )
    return own.select("doc_id", _documents(F.struct("main_text", "footnotes", "abbreviations"), "document").alias("value"))


def write_integrated(main: DataFrame, notes: DataFrame, abbreviations: DataFrame, path: str) -> None:
    """Both forms, in the folders xml and csv."""
    write_documents(integrated_xml(main, notes, abbreviations), f"{path}/xml")
    _write_csv(integrated_rows(main, notes, abbreviations), ["_o", "Number", "Page"], ["Type", "Page", "Number", "Label", "Content", "Source"], f"{path}/csv")


def abbreviation_xml(abbreviations: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, value): paper/abbreviations/abbrev of each paper that has any. ``files``: doc_id,
    file, url, journal. Direction marks go, quotes are plain."""
    plain = lambda c: text.plain_quotes(F.regexp_replace(F.col(c), "[\u200e\u200f]", ""))
    rows = abbreviations.join(files, "doc_id")
    item = F.struct(F.col("entry_no"), F.struct(plain("label").alias("_label"), F.col("file").alias("_file"), F.col("journal").alias("_journal"), plain("info").alias("_VALUE")).alias("x"))
    own = rows.groupBy("doc_id", "file", "url").agg(F.transform(F.sort_array(F.collect_list(item)), lambda i: i["x"]).alias("abbrev"))
    return own.select("doc_id", _documents(F.struct(F.col("file").alias("_file"), F.col("url").alias("_url"), F.struct("abbrev").alias("abbreviations")), "paper").alias("value"))


def reference_xml(refs: DataFrame, path: str) -> None:
    refs.select(F.col("number").alias("_number"), F.col("page").alias("_page"), F.col("content").alias("_VALUE")).write.format("xml").options(rowTag="Reference", rootTag="References").mode("overwrite").save(path)


def processing_report(files: DataFrame, counts: DataFrame, collected: DataFrame) -> DataFrame:
    """One row a file: expected and collected numbers, status, accuracy, difference flag.
    Skipped files keep a row."""
    df = files.join(counts.withColumn("Has_Meta_File", F.lit(True)), "doc_id", "left").join(collected, "doc_id", "left")
    n, refs, big = F.coalesce("n_footnotes", F.lit(0)), F.coalesce("number_of_references", F.lit(0)), F.coalesce("biggest_label_number", F.lit(0))
    return df.select(
        text.last_digits(F.col("doc_id"), F.lit("Unknown")).alias("Issue_Number"), F.col("doc_id").alias("Filename"), refs.alias("Meta_References_Count"), big.alias("Meta_biggest_label_number"),
        n.cast("int").alias("Collected_Footnotes_Count"), F.coalesce("Has_Meta_File", F.lit(False)).alias("Has_Meta_File"),
        F.when(F.coalesce("skipped", F.lit(False)), "Skipped").otherwise("Completed").alias("Processing_Status"),
        recode.accuracy_percent(n, big).alias("Accuracy_Percentage"), recode.report_difference(n, big, refs).alias("Is_Different"),
    )


#: Columns of the report's variants.
REPORT = ["Issue_Number", "Filename", "Meta_References_Count", "Meta_biggest_label_number", "Collected_Footnotes_Count", "Has_Meta_File", "Processing_Status"]
REPORTS = {"plain": REPORT, "accuracy": [*REPORT, "Accuracy_Percentage"], "differences": [*REPORT, "Is_Different"]}


def report_name(journal: str, kind: str, at: Column | None = None) -> Column:
    """File name of a report; the one with accuracies carries its time."""
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd_HHmmss")
    return F.concat(F.lit(f"{journal}_processing_report_"), stamp, F.lit(".csv")) if kind == "accuracy" else F.lit(f"{journal}_processing_report.csv")


def write_report(report: DataFrame, path: str, kind: str = "plain", skipped: bool = True) -> None:
    """A report of files (a row each) as one CSV; without ``skipped`` files that were skipped
    have no row."""
    rows = report if skipped else report.where(F.col("Processing_Status") != "Skipped")
    rows = rows.select(*REPORTS[kind]).orderBy("Filename").withColumnRenamed(REPORT[0], BYTE_ORDER_MARK + REPORT[0])
    rows.coalesce(1).write.csv(path, header=True, mode="overwrite")


def write_votes(voted: DataFrame, path: str, votes: str = "anomaly_votes") -> None:
    """All voted rows, those of all four detectors, and those of two or more."""
    for name, rows in (("all", voted), ("unanimous", voted.where(F.col(votes) == 4)), ("anomalies", voted.where(F.col(votes) >= 2))):
        rows.write.csv(f"{path}/{name}", header=True, mode="overwrite")


def report_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("files"), F.count_if(F.col("Processing_Status") == "Completed").alias("completed"), F.count_if(F.col("Processing_Status") == "Skipped").alias("skipped"),
        F.sum("Collected_Footnotes_Count").alias("footnotes"), F.avg("Collected_Footnotes_Count").alias("mean_footnotes"), F.count_if("Is_Different").alias("different"),
    )


#: Natural keys of the corpus tables.
KEYS = {
    "issues": ["journal_id", "issue_number"], "main_texts": ["issue_id", "page_name"], "document_references": ["issue_id", "reference_number"],
    "footnotes_table": ["issue_id", "footnote_number"], "journals": ["journal_name"],
}


def append_new(batch: DataFrame, path: str, table: str, order: list[str]) -> None:
    """Append the rows whose natural key the table does not have; the first of equal keys in
    the batch counts, and loading a batch again adds nothing."""
    spark = batch.sparkSession
    try:
        target = spark.read.parquet(f"{path}/{table}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        target = spark.createDataFrame([], batch.schema)
    new_rows(batch, target, KEYS[table], order).write.mode("append").parquet(f"{path}/{table}")

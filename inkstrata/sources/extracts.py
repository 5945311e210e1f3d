"""Extract files, metadata and databases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = """skipped BOOLEAN, content STRUCT<isPageScan: BOOLEAN, references: STRUCT<number_of_references: INT,
reference_blocks: ARRAY<STRUCT<title: STRING, reference_content: ARRAY<STRUCT<label: STRING, text: STRING>>>>>,
displayTitle: STRING, authors: ARRAY<STRING>, abstract: ARRAY<STRING>, pageRange: STRING, volume: STRING, issue: STRING,
publishedDate: STRING, year: STRING, stable: STRING, hasRendition: BOOLEAN>"""


def read_survey(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def _separators(spark: SparkSession, path: str) -> DataFrame:
    """(file, tab): whether the first kilobyte of each file holds a tab."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.contains(F.substring("content", 1, 1024), F.lit(b"\t")).alias("tab"))


def read_extract_csv(spark: SparkSession, path: str) -> DataFrame:
    """type, page, number, content of an extract; headers in any case, a byte order mark is
    dropped, rows that lack a field are left out. Each file has its own separator, a tab or a
    comma."""
    tabs = {r["tab"]: r["files"] for r in _separators(spark, path).groupBy("tab").agg(F.collect_list("file").alias("files")).collect()}
    parts = [_extract(spark, files, "\t" if tab else ",") for tab, files in tabs.items()]
    if not parts:
        raise ValueError(f"no files: {path}")
    return reduce(DataFrame.unionByName, parts)


def _extract(spark: SparkSession, files: list[str], separator: str) -> DataFrame:
    df = spark.read.csv(files, header=True, sep=separator, multiLine=True, escape='"', mode="PERMISSIVE")
    names = {c.replace("\ufeff", "").strip().strip('"').lower(): c for c in df.columns}
    lacking = [c for c in ("type", "page", "content") if c not in names]
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    number = F.col(f"`{names['number']}`") if "number" in names else F.lit(None).cast("string")
    out = df.select(F.lower(F.trim(F.col(f"`{names['type']}`"))).alias("type"), F.col(f"`{names['page']}`").alias("page"), number.alias("number"), F.col(f"`{names['content']}`").alias("content"))
    return out.where("type is not null and page is not null and content is not null")


def read_extract_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each page: name, MainText, references and footnotes as arrays."""
    note = "ARRAY<STRUCT<_number: STRING, _VALUE: STRING>>"
    df = spark.read.format("xml").option("rowTag", "Page").schema(f"_name STRING, MainText STRING, Reference {note}, footnote {note}").load(path)
    return df.select(F.col("_name").alias("page"), F.col("MainText").alias("content"), F.col("Reference").alias("references"), F.col("footnote").alias("footnotes"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and the metadata of each JSON file; one that is no JSON object has nulls."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), "/", -1), r"\.[^.]*$", "").alias("doc_id"), "value")
    meta = F.from_json("value", METADATA)
    return text.select("doc_id", (F.coalesce(meta["skipped"], F.lit(False)) | F.col("value").startswith("skipped: ")).alias("skipped"), meta["content"].alias("content"))


def reference_counts(meta: DataFrame) -> DataFrame:
    """doc_id, number_of_references, biggest_label_number (0 without a numeric label)."""
    labels = F.flatten(F.transform(F.coalesce("content.references.reference_blocks", F.array()), lambda b: F.coalesce(b["reference_content"]["label"], F.array().cast("array<string>"))))
    numbers = F.transform(labels, lambda x: x.try_cast("int"))
    return meta.select("doc_id", F.coalesce("content.references.number_of_references", F.lit(0)).alias("number_of_references"), F.coalesce(F.array_max(numbers), F.lit(0)).alias("biggest_label_number"))


def is_page_scan(meta: DataFrame) -> DataFrame:
    return meta.select("doc_id", F.coalesce("content.isPageScan", F.lit(False)).alias("is_page_scan"))


def read_database(spark: SparkSession, url: str, table: str, properties: dict[str, str]) -> DataFrame:
    """A database table; connection options come from the caller."""
    return spark.read.jdbc(url, table, properties=properties)


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return df.select("path", "length", "modificationTime").orderBy("path")

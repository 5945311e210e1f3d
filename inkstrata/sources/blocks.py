"""Files with a parser of the caller's: one row for each text block."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

SCHEMA = "doc_id string, page int, block_no int, text string, font string, font_size double, left double, top double, error string"


def read_blocks(spark: SparkSession, path: str, parse: Callable[[bytes], Iterable[dict]], pattern: str = "*.pdf") -> DataFrame:
    """Blocks of each file as ``parse`` yields them (page, text and, if known, font, font_size,
    left, top), control characters removed. The style is that of the block's last span. A
    file that the parser rejects is a row with ``error`` set."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(frames):
        for f in frames:
            for file, data in zip(f["path"], f["content"], strict=True):
                doc = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    rows = [dict.fromkeys(columns) | b | {"doc_id": doc, "block_no": i} for i, b in enumerate(parse(bytes(data)), 1)]
                except Exception as e:  # a damaged file is a row, not a failed job
                    rows = [dict.fromkeys(columns) | {"doc_id": doc, "error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame(rows, columns=columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, SCHEMA).withColumn("text", text.strip_control(F.col("text")))


def page_counts(blocks: DataFrame) -> DataFrame:
    return blocks.where("error is null").groupBy("doc_id").agg(F.max("page").alias("n_pages"), F.min_by("text", F.struct("page", "block_no")).alias("cover"))


def with_metadata(files: DataFrame, meta: DataFrame, how: str = "left") -> DataFrame:
    """Files and metadata by base name."""
    keyed = files.withColumn("doc_id", text.stem(F.col("path"))) if "doc_id" not in files.columns else files
    return keyed.join(meta, "doc_id", how)

"""A corpus from raw documents: language, near duplicates, repeated passages, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read back as the next one's ``docs``. Every stage works on all that its predecessor kept; all
but the last return the columns of ``documents``. Empty tables pass through as empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm import bpe, langid, minhash, mixing, suffixdedup
from inkstrata.llm.common import table, with_checked_broadcast, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE_SCORE = 0.5
#: A passage of over 50 words is a repeat, even if it has fewer than 400 bytes.
PASSAGE_WORDS = 51


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without letters and texts
    for which no learned language has half of the posterior go. Rows are judged one by one, so
    repeated rows and rows without doc_id stay or go like others; very long texts are read whole;
    columns other than those of documents are left out."""
    rest = ("text", "lang", "source", "n_chars")
    found = langid.identify(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), carry=rest)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select("doc_id", *[F.col(f"_{c}").alias(c) for c in rest])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates (shingles of five
    words, Jaccard 0.8 or more). Documents without words are no duplicates of each other. Rows
    without doc_id are not compared and stay; repeated rows of one doc_id are one document, of
    which all rows stay or go."""
    gone = minhash.near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id")
    return with_checked_broadcast(docs.select(*COLUMNS), written(gone, "gone"), "doc_id", "left_anti")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 400 that occur more than once and without the passages of
    over 50 words that another document holds too; a document of which nothing is left goes, one that was empty before stays. A character that a border cuts is
    dropped. Rows without doc_id are not searched and stay as they are."""
    cut = suffixdedup.remove_repeats(docs, 400, words=PASSAGE_WORDS, with_text=True, carry=("lang", "source", "n_chars"))
    cut = cut.where("n_removed = 0 or n_removed < n_bytes")
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("_n_chars"))
    return cut.select("doc_id", "text", F.col("_lang").alias("lang"), F.col("_source").alias("source"), chars.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it.

    Rows are known by two 64-bit hashes of all their columns, so rows without doc_id and
    different rows of one doc_id each get their own copies; equal rows get theirs together."""
    docs = docs.select(*COLUMNS).withColumns({"h1": F.xxhash64(*COLUMNS), "h2": F.xxhash64(F.lit(1), *COLUMNS)})
    mixed = mixing.mix_sources(docs, carry=("h1", "h2"))
    copies = mixed.groupBy(F.col("_h1").alias("h1"), F.col("_h2").alias("h2")).agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    taken = with_checked_broadcast(docs, written(copies, "copies"), ["h1", "h2"], "inner")
    one = F.first(F.struct(*COLUMNS, "copies")).alias("x")
    taken = taken.where("rows = 1").select(*COLUMNS, "copies").unionByName(taken.where("rows > 1").groupBy("h1", "h2").agg(one).select("x.*"))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and decoded bytes; a null text has none.
    Row by row: repeated rows repeat, rows without doc_id are encoded like others."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mix", mix), ("tokens", tokens)]

#: Language identification, sketches and suffix order are not expressible in SQL; each stage
#: is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

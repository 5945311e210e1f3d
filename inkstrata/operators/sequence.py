"""Ordered-sequence operators: gaps and islands, runs, carries. ``by`` is the partition (a
document, a user), ``order`` a total order within it; everything is one sort per partition
key, so the operators of one chain share a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept

Names = list[str]


def _w(by: Names, order: Names):
    return Window.partitionBy(*by).orderBy(*order)


def running_id(df: DataFrame, by: Names, order: Names, starts: Column, name: str) -> DataFrame:
    """Number of rows so far on which ``starts`` holds: the island each row belongs to."""
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("long")).over(w))


def paragraph_islands(df: DataFrame, by: Names, order: Names, structural: Column, top: str, gap: float = 35.0, name: str = "para_no") -> DataFrame:
    """A paragraph starts on a row that with its two predecessors is structural and stands
    ``gap`` or more below the third row before it."""
    w = _w(by, order)
    df = df.withColumn("_s", structural)
    start = F.col("_s") & F.lag("_s", 1).over(w) & F.lag("_s", 2).over(w) & (F.col(top) - F.lag(top, 3).over(w) >= gap)
    return running_id(df.withColumn("_b", start), by, order, F.col("_b"), name).drop("_s", "_b")


def gap_sessions(df: DataFrame, by: Names, order: Names, position: str | Column, gap: float, name: str = "line_no") -> DataFrame:
    """A new line where the distance to the previous row (not to the line's first) exceeds
    ``gap``; the first row is line 0."""
    w = _w(by, order)
    p = F.col(position) if isinstance(position, str) else position
    return running_id(df.withColumn("_b", p - F.lag(p).over(w) > gap), by, order, F.col("_b"), name).drop("_b")


def run_segments(df: DataFrame, by: Names, order: Names, separator: Column, least: int = 2, name: str = "segment_no") -> DataFrame:
    """Rows between runs of at least ``least`` separator rows; shorter runs do not separate.
    The first row that is no separator starts the first segment, whatever stands before it.
    Separators get the number of the segment they follow."""
    w = _w(by, order)
    df = df.withColumn("_s", F.coalesce(separator, F.lit(False)))
    full = F.col("_s")
    for k in range(1, least):
        full = full & F.coalesce(F.lag("_s", k).over(w), F.lit(False))
    df = df.withColumn("_full", full)
    before = F.coalesce(F.sum((~F.col("_s")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = ~F.col("_s") & ((before == 0) | F.lag("_full").over(w))
    return running_id(df.withColumn("_b", start), by, order, F.col("_b"), name).drop("_s", "_full", "_b")


def merge_segments(df: DataFrame, by: Names, segment: str, value: str, threshold: Column, name: str = "merged_no") -> DataFrame:
    """A segment of which no value exceeds the threshold joins the one before; the first
    always stays."""
    own = df.groupBy(*by, segment).agg(F.max((F.col(value) > threshold).cast("int")).alias("_some"))
    w = Window.partitionBy(*by).orderBy(segment)
    own = own.withColumn("_start", (F.col("_some") == 1) | (F.row_number().over(w) == 1))
    own = own.withColumn(name, F.sum(F.col("_start").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.join(own.select(*by, segment, name), [*by, segment])


def split_at_large(df: DataFrame, by: Names, order: Names, large: Column, name: str = "piece_no") -> DataFrame:
    """Each large row from the second on starts a piece; with fewer than two there is one."""
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.greatest(F.sum(F.coalesce(large, F.lit(False)).cast("long")).over(w), F.lit(1)))


def carry_forward(df: DataFrame, by: Names, order: Names, continues: Column, text: str, name: str = "content", separator: str = "", keep_open: bool = False) -> DataFrame:
    """Rows that continue on the next one are joined with it, in order, without a separator.
    An island that is still open at its partition's end is lost unless ``keep_open``."""
    w = _w(by, order)
    df = df.withColumn("_c", F.coalesce(continues, F.lit(False)))
    df = running_id(df.withColumn("_b", ~F.coalesce(F.lag("_c").over(w), F.lit(False))), by, order, F.col("_b"), "island_no")
    key = F.struct(*order, F.coalesce(text, F.lit("")).alias("_t"))
    last = F.max_by("_c", F.struct(*order))
    out = df.groupBy(*by, "island_no").agg(
        F.min(F.struct(*order)).alias("_first"), F.count("*").alias("n_parts"), last.alias("open"),
        F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: x["_t"]), separator).alias(name),
    )
    out = out.select(*by, "island_no", *[F.col("_first")[c].alias(f"first_{c}") for c in order], "n_parts", "open", name)
    return out if keep_open else out.where(~F.col("open")).drop("open")


def from_end(df: DataFrame, by: Names, order: Names, name: str = "from_end") -> DataFrame:
    """1 on the last row of each partition, 2 on the last but one, ..."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])))


def numbered(df: DataFrame, by: Names, order: Names, name: str) -> DataFrame:
    """1, 2, ... in each group, however large: rows are sorted by ranges over all tasks, each range of a group is
    numbered by itself, and what the ranges before it hold is added. ``order`` is total within a group."""
    ranged = kept(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "_p").agg(F.count("*").alias("_c"))  # a row for each range and group in it
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).drop("_c")
    null_safe = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in (*by, "_p")]
    out = ranged.alias("_l").join(counts.alias("_r"), null_safe).select("_l.*", "_r._base")
    own = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order))
    return out.withColumn(name, (own + F.col("_base")).cast("int")).drop("_p", "_base")


def two_numberings(df: DataFrame, page: Names, collected: Names, by: Names) -> DataFrame:
    """Numbers in page order and in the order of collection."""
    return numbered(numbered(df, by, page, "page_order_no"), by, collected, "collected_no")


def ordered_text(df: DataFrame, by: Names, order: Names, text: str, separator: str, name: str = "content") -> DataFrame:
    key = F.struct(*order, F.col(text).alias("_t"))
    return df.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: x["_t"]), separator).alias(name))


def largest(df: DataFrame, by: Names, size: Column, order: Names) -> DataFrame:
    """The row of the largest size of each partition, the first of equals."""
    w = Window.partitionBy(*by).orderBy(size.desc(), *order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

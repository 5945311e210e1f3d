"""Joins and reports of the corpus part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]], names: list[str]) -> DataFrame:
    """For each name tuple of ``parents`` the number of different values of every child
    (frame with ``key``, counted column). Children are reduced to their different values
    before they are joined, so that nothing fans out; a value that several parents of one
    name tuple hold counts once."""
    counts = []
    for name, (child, column) in children.items():
        pairs = child.select(key, F.col(column).alias("_x")).where("_x is not null").distinct()
        own = parents.select(key, *names).join(pairs, key).groupBy(*names).agg(F.count_distinct("_x").alias(name))
        counts.append((name, own))
    out = parents.select(*names).distinct()
    for name, own in counts:
        out = null_safe_left(out, own, names)
    return out.select(*names, *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n, _ in counts])


def null_safe_left(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    other = right.select(*[F.col(c).alias(f"_{c}" if c in on else c) for c in right.columns])
    match = reduce(lambda a, b: a & b, [left[c].eqNullSafe(other[f"_{c}"]) for c in on])
    return left.join(other, match, "left").drop(*[f"_{c}" for c in on])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def missing(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(present.select(*on).distinct(), on, "left_anti")


def new_rows(batch: DataFrame, target: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows to append so that each key is in the target once: keys that are there already stay
    out, of equal keys in the batch the first counts. Loading the same batch again adds
    nothing."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return missing(first, target, key)


def best_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, words: str = "words", least: float = 0.8) -> DataFrame:
    """For each left row the right row that holds the largest share of the left's different
    words, if that exceeds ``least``; ties to the smaller id.

    To hold more than ``least`` of n words a right row must hold one of any n - floor(least * n)
    of them, so rows meet on that many of the left's rarest words only, and the pairs found are
    counted in full: words that nearly all rows hold bring no pairs."""
    a = left.select(left_id, F.array_distinct(words).alias("_a")).where(F.size("_a") > 0)
    b = right.select(right_id, F.array_distinct(words).alias("_b"))
    of_a = a.select(left_id, F.size("_a").alias("_n"), F.explode("_a").alias("_w"))
    of_b = b.select(right_id, F.explode("_b").alias("_w"))
    held = of_b.join(of_a.select("_w").distinct(), "_w", "left_semi").groupBy("_w").agg(F.count("*").alias("_f"))
    rare = of_a.join(held, "_w").withColumn("_r", F.row_number().over(Window.partitionBy(left_id).orderBy("_f", "_w")))
    # words that no right row holds are the rarest of all and use up places
    seen = F.count("*").over(Window.partitionBy(left_id))
    rare = rare.withColumn("_places", F.col("_n") - F.floor(F.lit(least) * F.col("_n")) - (F.col("_n") - seen)).where("_r <= _places")
    pairs = rare.select(left_id, "_w").join(of_b, "_w").select(left_id, right_id).distinct()
    common = pairs.join(a, left_id).join(b, right_id).select(left_id, right_id, F.size(F.array_intersect("_a", "_b")).cast("long").alias("n_common"), F.size("_a").alias("n_words"))
    common = common.where(F.col("n_common") > least * F.col("n_words"))
    best = F.min(F.struct((-F.col("n_common") / F.col("n_words")).alias("share"), right_id, "n_common", "n_words"))
    return common.groupBy(left_id).agg(best.alias("_x")).select(left_id, f"_x.{right_id}", "_x.n_common", "_x.n_words")


def overlap_or_first(left: DataFrame, right: DataFrame, on: list[str], left_id: list[str], right_id: str, words: str, held: str, least: float = 0.8) -> DataFrame:
    """Of the right rows with equal ``on``, for each left row: the one that holds the largest
    share of its different words, if over ``least``, else the first. The best of a group is an
    aggregate, so that pairs of a group are never kept."""
    n = F.size(F.array_distinct(words))
    share = F.size(F.array_intersect(words, held)) / n
    share = F.when(F.size(F.array_intersect(words, held)) > least * n, share).otherwise(0.0)
    best = F.min(F.struct((-share).alias("s"), F.col(right_id).alias("id")))
    return left.join(right, on).groupBy(*on, *left_id).agg(best["id"].alias(right_id))


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_x: str, right_x: str, band: float) -> DataFrame:
    """Pairs with equal ``on`` and positions within ``band``: positions are cut into cells as
    wide as the band and joined on the cell and its neighbours."""
    cell = lambda x: F.floor(F.col(x) / F.lit(band)).cast("long")
    l = left.withColumn("_cell", F.explode(F.array(cell(left_x) - 1, cell(left_x), cell(left_x) + 1)))
    r = right.withColumn("_cell", cell(right_x))
    return l.join(r, [*on, "_cell"]).where(F.abs(F.col(left_x) - F.col(right_x)) <= band).drop("_cell")


def first_containing(text: Column, patterns: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The result of the first pattern that the text contains, in the given order."""
    out = F
    for pattern, result in patterns:
        out = out.when(text.contains(pattern), F.lit(result))
    return out.otherwise(F.lit(otherwise))

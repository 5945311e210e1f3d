"""Profiles of groups: cross tables, shares, deviations, scaling, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def crosstab_percent(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Row percentages of a fixed list of column values; a missing cell is 0. Null rows drop."""
    n = [F.count_if(F.col(column) == v).alias(f"pct_{v}") for v in values]
    out = df.where(F.col(row).isNotNull()).groupBy(row).agg(F.count_if(F.col(column).isin(values)).alias("_all"), *n)
    return out.select(row, *[F.coalesce(F.try_divide(F.col(f"pct_{v}") * 100.0, F.col("_all")), F.lit(0.0)).alias(f"pct_{v}") for v in values])


def modal_share(df: DataFrame, by: str, column: str) -> DataFrame:
    """Share of the most frequent value of each group."""
    counts = df.where(F.col(by).isNotNull() & F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg((F.max("n") / F.sum("n")).alias("modal_share"))


def group_profile(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), *aggs)


def melted(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(ids, columns, "feature", "value")


def deviation_from_rest(df: DataFrame, flag, columns: list[str], top: int = 10) -> DataFrame:
    """The features whose mean in the flagged rows differs most, in percent, from the rest."""
    f = flag.cast("boolean")
    means = df.agg(*[F.avg(F.when(f, F.col(c))).alias(f"a_{c}") for c in columns], *[F.avg(F.when(~f, F.col(c))).alias(f"b_{c}") for c in columns])
    rows = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a_{c}").alias("inside"), F.col(f"b_{c}").alias("outside")) for c in columns])).alias("x")).select("x.*")
    rows = rows.withColumn("deviation", F.try_divide(F.col("inside") - F.col("outside"), F.col("outside")) * 100)
    return rows.orderBy(F.desc(F.abs("deviation")), "feature").limit(top)


def robust_row_scale(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row by its own median and interquartile range (0 counts as 1e-9), then its
    minimum and maximum: long rows (key, feature, scaled)."""
    long = melted(df, [key], columns)
    q = long.groupBy(key).agg(F.percentile("value", [0.25, 0.5, 0.75]).alias("q"))
    iqr = F.col("q")[2] - F.col("q")[0]
    z = long.join(q, key).withColumn("z", (F.col("value") - F.col("q")[1]) / F.when(iqr == 0, 1e-9).otherwise(iqr))
    w = Window.partitionBy(key)
    scaled = F.coalesce(F.try_divide(F.col("z") - F.min("z").over(w), F.max("z").over(w) - F.min("z").over(w)), F.lit(0.0))
    return z.withColumn("scaled", scaled).select(key, "feature", "scaled")


def normalised_counts(df: DataFrame, column: str, digits: int = 3) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))
    return counts.withColumn("share", F.bround(F.col("n") / F.sum("n").over(every), digits))


def keyed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a keyed hash: the same rows on every engine run and partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, count, mean, std, min, q25, q50, q75, max) of numeric columns."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value").where("value is not null")
    q = F.percentile("value", [0.25, 0.5, 0.75])
    one = long.groupBy("feature").agg(F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), q.alias("q"), F.max("value").alias("max"))
    return one.select("feature", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def columns_like(df: DataFrame, prefix: str = "", numeric: bool = False) -> list[str]:
    """Names that begin with ``prefix``, if asked for only of numeric columns."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [c for c, kind in df.dtypes if c.startswith(prefix) and (not numeric or kind.startswith(kinds))]


def group_rate(df: DataFrame, by: str, flag, name: str = "rate") -> DataFrame:
    """Percentage of each group's rows on which the flag holds."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg((F.avg(flag.cast("double")) * 100).alias(name))


def top_groups(df: DataFrame, by: str, value: str, top: int = 10, digits: int = 3) -> DataFrame:
    """(by, count, mean) of the groups with the largest means."""
    one = df.groupBy(by).agg(F.count(value).alias("count"), F.round(F.avg(value), digits).alias("mean"))
    return one.orderBy(F.desc("mean"), by).limit(top)


def wide(df: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """Means of ``value`` in a column for each of a fixed list of column values; a missing cell
    is 0."""
    cells = df.groupBy(row).pivot(column, values).agg(F.avg(value))
    return cells.fillna(0.0, [str(v) for v in values])


def transposed(df: DataFrame, key: str, columns: list[str], keys: list) -> DataFrame:
    """Columns as rows: (feature, a column for each of a fixed list of key values)."""
    long = melted(df, [key], columns)
    return long.groupBy("feature").pivot(key, keys).agg(F.first("value"))

"""Recodes and scores of survey columns: pure column expressions.

Comparisons follow SQL: a null falls to the last branch, which is what the scores define.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The thirteen age bands, their midpoints, and the grades of general health.
AGE_BANDS = ["18-24", "25-29", "30-34", "35-39", "40-44", "45-49", "50-54", "55-59", "60-64", "65-69", "70-74", "75-79", "80 or older"]
AGE_MIDPOINTS = [21, 27, 32, 37, 42, 47, 52, 57, 62, 67, 72, 77, 85]
HEALTH_GRADES = ["Poor", "Fair", "Good", "Very good", "Excellent"]
RACES = ["American Indian/Alaskan Native", "Asian", "Black", "Hispanic", "Other", "White"]


def cases(col: Column, pairs, otherwise=None) -> Column:
    """Exact-match recode; values outside ``pairs`` give ``otherwise``."""
    out = F
    for value, result in pairs:
        out = out.when(col == F.lit(value), F.lit(result))
    return out.otherwise(F.lit(otherwise))


def steps(col: Column, limits, results, last: float) -> Column:
    """The result of the first limit that the value does not exceed, else ``last``."""
    out = F
    for limit, result in zip(limits, results, strict=True):
        out = out.when(col <= F.lit(limit), F.lit(result))
    return out.otherwise(F.lit(last))


def yes_no(df: DataFrame) -> DataFrame:
    """Every string column that holds nothing but Yes and No becomes 1 and 0; other values
    of string columns stay, so a column changes its type only when it is passed in ``coerce``."""
    kinds = dict(df.dtypes)
    out = [F.when(F.col(c) == "Yes", "1").when(F.col(c) == "No", "0").otherwise(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns]
    return df.select(*out)


def sex(col: Column) -> Column:
    return cases(col, [("Female", 0), ("Male", 1)])


def age_midpoint(col: Column) -> Column:
    return cases(col, zip(AGE_BANDS, AGE_MIDPOINTS, strict=True))


def age_ordinal(col: Column) -> Column:
    return cases(col, zip(AGE_BANDS, range(13), strict=True))


def age_group(ordinal: Column) -> Column:
    return steps(ordinal, [1, 4, 7], [0.0, 0.33, 0.66], 1.0)


def general_health(col: Column) -> Column:
    return cases(col, zip(HEALTH_GRADES, [0.0, 0.25, 0.5, 0.75, 1.0], strict=True))


def diabetic(col: Column) -> Column:
    c = col.cast("string")
    return cases(c, [("0", 0.0), ("No", 0.0), ("No, borderline diabetes", 0.33), ("Yes (during pregnancy)", 0.67), ("1", 1.0), ("Yes", 1.0)])


def one_hot(name: str, values, prefix: str | None = None) -> list[Column]:
    """A 0/1 column for each value of a fixed list; an unknown value is 0 in all."""
    return [F.when(F.col(name) == v, 1).otherwise(0).alias(f"{prefix or name}_{v}") for v in values]


def sleep_score(col: Column) -> Column:
    c = col.cast("double")
    return (
        F.when((c >= 7) & (c <= 9), 1.0)
        .when(((c >= 6) & (c < 7)) | ((c > 9) & (c <= 10)), 0.6)
        .when(((c >= 5) & (c < 6)) | ((c > 10) & (c <= 12)), 0.3)
        .otherwise(0.0)
    )


def fifths_score(col: Column) -> Column:
    """Mental and physical health: fifths of [0, 1]; a null is 1."""
    return steps(col.cast("double"), [0.2, 0.4, 0.6, 0.8], [0.0, 0.25, 0.5, 0.75], 1.0)


def bmi_score(col: Column) -> Column:
    """Scores with gaps: 24.9 < x < 25 and 29.9 < x < 30 belong to no band and give 0."""
    c = col.cast("double")
    return F.when((c >= 18.5) & (c <= 24.9), 1.0).when((c >= 25) & (c <= 29.9), 0.6).when((c >= 30) & (c <= 34.9), 0.3).otherwise(0.0)


def inverted_min_max(df: DataFrame, columns: list[str], suffix: str = "_inv") -> DataFrame:
    """1 - (x - min) / (max - min); null where all values are equal. The extremes are one
    aggregated row, joined by broadcast."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(ends))
    for c in columns:
        out = out.withColumn(c + suffix, 1 - F.try_divide((F.col(c) - F.col(f"lo_{c}")).cast("double"), (F.col(f"hi_{c}") - F.col(f"lo_{c}")).cast("double")))
    return out.drop(*ends.columns)


def percent_deviation(a: Column, b: Column) -> Column:
    """(a - b) / b * 100; infinite where the base is 0."""
    return F.when(b == 0, F.lit(float("inf"))).otherwise(F.try_divide(a - b, b) * 100)


def minus_log10(p: Column) -> Column:
    return -F.log10(F.when(p == 0, F.lit(1e-300)).otherwise(p))


def significance(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def accuracy_percent(collected: Column, expected: Column) -> Column:
    """'12.3%' where both counts are positive, else empty."""
    return F.when((collected > 0) & (expected > 0), F.format_string("%.1f%%", collected / expected * 100)).otherwise("")


def report_difference(collected: Column, biggest: Column, references: Column) -> Column:
    """Whether a count is off by more than 8 % of the references and by more than 3 items."""
    percent = F.when((references == 0) & (collected > 0), 100.0).otherwise(F.coalesce(F.try_divide(F.abs(collected - references), references) * 100, F.lit(0.0)))
    return F.coalesce((percent > 8) & ((F.abs(collected - biggest) > 3) | (F.abs(collected - references) > 3)), F.lit(False))

"""Group tests from sums: one aggregation each, whatever the number of rows. P-values come
from the incomplete beta function on the driver-size result rows."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, feature, n, mean, var) of groups with two values and more, null keys dropped."""
    aggs = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_samp(c).alias("var")) for c in columns]
    out = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.array(*aggs).alias("x"))
    return out.select(by, F.explode("x").alias("x")).select(by, "x.*").where("n >= 2")


def anova(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """One-way analysis of variance: (feature, k, n, f_stat)."""
    m = moments(df, by, columns)
    g = m.groupBy("feature").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("ss"), F.sum((F.col("n") - 1) * F.col("var")).alias("within"),
    )
    between = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return g.where("k >= 2").select("feature", "k", "n", F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f_stat"))


def welch(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Welch's t of every pair of groups: (feature, group_a, group_b, t_stat, dof)."""
    m = moments(df, by, columns)
    a = m.select("feature", F.col(by).alias("group_a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "mean", "var")])
    b = m.select("feature", F.col(by).alias("group_b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "mean", "var")])
    u, v = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    return a.join(b, "feature").where("group_a < group_b").select(
        "feature", "group_a", "group_b",
        F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(u + v)).alias("t_stat"),
        F.try_divide((u + v) * (u + v), u * u / (F.col("n_a") - 1) + v * v / (F.col("n_b") - 1)).alias("dof"),
    )


def _cuts(df: DataFrame, columns: list[str], ranges: int = 64) -> list[list[float]]:
    """Approximate quantiles of columns, in one pass."""
    return [list(x or []) for x in df.agg(*[F.percentile_approx(c, [i / ranges for i in range(1, ranges)], 10_000) for c in columns]).first()]


def counted_before(counts: DataFrame, by: list[str], value: str, n: str, name: str, ranges: int = 64, cuts: list[float] | None = None) -> DataFrame:
    """Sum of ``n`` over the smaller values of a group, for rows of different values. Values are
    cut into ranges at approximate quantiles; ranges are summed first, so that only a range's
    values are ordered in one task, however many a group has. ``cuts``: quantiles that are known."""
    cuts = _cuts(counts, [value], ranges)[0] if cuts is None else cuts
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    rows = counts.withColumn("_range", F.size(F.filter(cuts, lambda c: c < F.col(value))))
    sums = rows.groupBy(*by, "_range").agg(F.sum(n).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")  # at most ``ranges`` rows a group
    within = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, [*by, "_range"])
    return rows.withColumn(name, F.col("_base") + F.coalesce(F.sum(n).over(within), F.lit(0))).drop("_base", "_range")


def average_ranks(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """Tie-averaged ranks. Values are counted and the counts prefix-summed, so that only the
    different values of a group are ordered."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    ranks = counted_before(counts, by, value, "_c", "_b").withColumn(name, F.col("_b") + (F.col("_c") + 1) / 2.0)
    return df.join(ranks.drop("_c", "_b"), [*by, value])


def mann_whitney(df: DataFrame, flag: Column, value: str) -> DataFrame:
    """(u_stat, z) of the flagged against the other rows, two-sided, with tie correction."""
    rows = df.where(F.col(value).isNotNull()).select(flag.cast("boolean").alias("f"), F.col(value).alias("x"))
    counts = rows.groupBy("x").agg(F.count("*").alias("c"), F.count_if("f").alias("a"))
    ranked = counted_before(counts, [], "x", "c", "b").withColumn("r", F.col("b") + (F.col("c") + 1) / 2.0)
    s = ranked.agg(F.sum(F.col("r") * F.col("a")).alias("ra"), F.sum("a").alias("n1"), F.sum(F.col("c") - F.col("a")).alias("n2"), F.sum(F.pow(F.col("c"), F.lit(3.0)) - F.col("c")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("ra") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    return s.select(u.alias("u_stat"), F.try_divide(u - n1 * n2 / 2, sd).alias("z"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(rho) of tie-averaged ranks. Pairs of values are counted, and the ranks of x summed for each value
    of y, so that rows are read twice and never joined."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    cut_x, cut_y = _cuts(rows, ["x", "y"])
    pairs = rows.groupBy("x", "y").agg(F.count("*").alias("c"))
    rank = lambda c: F.col("b") + (F.col(c) + 1) / 2.0
    by_x = counted_before(rows.groupBy("x").agg(F.count("*").alias("cx")), [], "x", "cx", "b", cuts=cut_x).select("x", "cx", rank("cx").alias("rx"))
    by_y = pairs.join(by_x, "x").groupBy("y").agg(F.sum("c").alias("cy"), F.sum(F.col("c") * F.col("rx")).alias("sx"), F.sum(F.col("c") * F.col("rx") * F.col("rx")).alias("xx"))
    by_y = counted_before(by_y, [], "y", "cy", "b", cuts=cut_y).withColumn("ry", rank("cy"))
    s = by_y.agg(F.sum("cy").alias("n"), F.sum(F.col("sx") * F.col("ry")).alias("xy"), F.sum("xx").alias("xx"), F.sum(F.col("cy") * F.col("ry") * F.col("ry")).alias("yy"))
    middle = F.col("n") * F.pow((F.col("n") + 1) / 2.0, F.lit(2.0))
    return s.select(F.try_divide(F.col("xy") - middle, F.sqrt((F.col("xx") - middle) * (F.col("yy") - middle))).alias("rho"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs of columns, from one aggregation."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


# --- normality ------------------------------------------------------------------------


def shapiro_wilk(x: list[float]) -> tuple[float, float]:
    """(W, p) of 3 to 5,000 values by Royston's approximation; (nan, nan) for fewer, (1, 1) where
    all are equal."""
    n = len(x)
    if n < 3:
        return math.nan, math.nan
    x = sorted(x)
    middle = sum(x) / n
    spread = sum((v - middle) ** 2 for v in x)
    if spread <= 0:
        return 1.0, 1.0
    normal = NormalDist()
    m = [normal.inv_cdf((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    mm = sum(v * v for v in m)
    u = n**-0.5
    a = [0.0] * n
    if n == 3:
        a[0], a[2] = -math.sqrt(0.5), math.sqrt(0.5)
    else:
        last = _poly([m[-1] / math.sqrt(mm), 0.221157, -0.147981, -2.071190, 4.434685, -2.706056], u)
        first = 2 if n > 5 else 1
        before = _poly([m[-2] / math.sqrt(mm), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], u)
        if first == 2:
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
            a[-2], a[1] = before, -before
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[-1], a[0] = last, -last
        for i in range(first, n - first):
            a[i] = m[i] / math.sqrt(phi)
    w = min(1.0, sum(c * v for c, v in zip(a, x, strict=True)) ** 2 / spread)
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w == 1.0:
        return w, 1.0
    if n <= 11:
        g, centre, scale = 0.459 * n - 2.273, _poly([0.5440, -0.39978, 0.025054, -6.714e-4], n), math.exp(_poly([1.3822, -0.77857, 0.062767, -0.0020322], n))
        if math.log(1 - w) >= g:
            return w, 0.0
        z = (-math.log(g - math.log(1 - w)) - centre) / scale
    else:
        log = math.log(n)
        centre, scale = _poly([-1.5861, -0.31082, -0.083751, 0.0038915], log), math.exp(_poly([-0.4803, -0.082676, 0.0030302], log))
        z = (math.log(1 - w) - centre) / scale
    return w, 1 - normal.cdf(z)


def _poly(c: list[float], x: float) -> float:
    return sum(v * x**i for i, v in enumerate(c))


def normality(df: DataFrame, key: str, columns: list[str], most: int = 5000, seed: int = 42) -> DataFrame:
    """(feature, n, w, p_value) of the test on at most ``most`` rows of each column, chosen by a
    keyed hash among those that are not null, so that reruns agree."""
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key], columns, "feature", "value").where("value is not null")
    total = long.groupBy("feature").agg(F.count("*").alias("_n"))  # a row for each column
    # only hashes in the lowest part, which holds twice as many rows as are wanted, are ranked
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40))
    low = long.withColumn("_h", h).join(F.broadcast(total), "feature").where(F.col("_h") < F.greatest(F.lit(2.0 * most) / F.col("_n"), F.when(F.col("_n") <= 4 * most, 1.0).otherwise(0.0)) * (1 << 40))
    rank = F.row_number().over(Window.partitionBy("feature").orderBy("_h", key))
    chosen = low.withColumn("_r", rank).where(F.col("_r") <= most)

    def test(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shapiro_wilk(list(v)) for v in values], columns=["w", "p_value"])

    one = chosen.groupBy("feature").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("value")).alias("_v"))
    tested = F.pandas_udf(test, "w double, p_value double", F.PandasUDFType.SCALAR)(F.col("_v"))
    return one.select("feature", "n", tested.alias("x")).select("feature", "n", "x.*")


# --- p-values -------------------------------------------------------------------------


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by the continued fraction (modified Lentz)."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            t = 1.0
        elif i % 2 == 0:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + t * d) or tiny)
        c = (1 + t / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def f_p_value(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f is not None and f == f else float("nan")


def t_p_value(t: float, dof: float) -> float:
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t)) if t is not None and t == t else float("nan")


def chi2_cdf(x: float, dof: float) -> float:
    """The regularised lower incomplete gamma function of dof / 2 and x / 2, by its series."""
    a, x = dof / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1.0
    n = 0
    while term > 1e-17 * total:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a + 1)))


def z_p_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _of_pandas(fn):
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([fn(*x) for x in zip(*columns, strict=True)], dtype=float)

    return run


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    return F.pandas_udf(_of_pandas(f_p_value), "double", F.PandasUDFType.SCALAR)(f, d1, d2)


def t_p(t: Column, dof: Column) -> Column:
    return F.pandas_udf(_of_pandas(t_p_value), "double", F.PandasUDFType.SCALAR)(t, dof)


def anova_p(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """``anova`` with the p-value of each column."""
    return anova(df, by, columns).withColumn("p_value", f_p(F.col("f_stat"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")))


def welch_p(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """``welch`` with the two-sided p-value of each pair."""
    return welch(df, by, columns).withColumn("p_value", t_p(F.col("t_stat"), F.col("dof")))


def mann_whitney_p(df: DataFrame, flag: Column, value: str) -> DataFrame:
    """``mann_whitney`` with the two-sided p-value."""
    return mann_whitney(df, flag, value).withColumn("p_value", F.pandas_udf(_of_pandas(z_p_value), "double", F.PandasUDFType.SCALAR)(F.col("z")))


def significant(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """The tests whose p-value is below the level."""
    return tests.where((F.col("p_value") < level) & ~F.isnan("p_value"))

"""Group tests with p-values against integrals of the densities."""

import math

import numpy as np

from pyspark.sql import functions as F

from inkstrata.operators import stats


def f_tail(f, a, b):
    """By the trapezoid rule over the tail, in v = 1 / (1 + x)."""
    v = np.linspace(1e-9, 1 / (1 + f), 400_001)
    x = 1 / v - 1
    log = (a / 2) * np.log(a / b) + (a / 2 - 1) * np.log(x) - (a + b) / 2 * np.log1p(a * x / b) - (math.lgamma(a / 2) + math.lgamma(b / 2) - math.lgamma((a + b) / 2))
    y = np.exp(log) / v**2
    return float(((y[1:] + y[:-1]) / 2 * np.diff(v)).sum())


def test_p_values_of_group_tests(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, 240)
    a, b = rng.normal(0, 1, 240) + 1.0 * (g == 2), rng.normal(0, 1, 240)
    df = spark.createDataFrame([(int(i), float(x), float(y)) for i, x, y in zip(g, a, b, strict=True)], "g int, a double, b double")
    rows = {r["feature"]: r for r in stats.anova_p(df, "g", ["a", "b"]).collect()}
    for name in ("a", "b"):
        assert np.isclose(rows[name]["p_value"], f_tail(rows[name]["f_stat"], 2, 237), rtol=1e-4, atol=1e-7)
    assert [r["feature"] for r in stats.significant(stats.anova_p(df, "g", ["a", "b"])).collect()] == [x for x in ("a", "b") if rows[x]["p_value"] < 0.05] and rows["a"]["p_value"] < 0.05
    for r in stats.welch_p(df, "g", ["a"]).collect():
        assert np.isclose(r["p_value"], f_tail(r["t_stat"] ** 2, 1, r["dof"]), rtol=2e-3, atol=1e-6)
    m = stats.mann_whitney_p(df, F.col("g") == 2, "a").first()
    assert np.isclose(m["p_value"], math.erfc(abs(m["z"]) / math.sqrt(2)))


def test_rank_correlation_of_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 7, 500)
    y = x + rng.integers(0, 9, 500)
    rank = lambda v: np.array([(v < k).sum() + ((v == k).sum() + 1) / 2 for k in v])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (3, None)], "x int, y double")
    assert np.isclose(stats.spearman(df, "x", "y").first()[0], np.corrcoef(rank(x), rank(y))[0, 1])

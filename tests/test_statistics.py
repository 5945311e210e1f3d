"""Ranks, quantiles, neighbours and normality against NumPy, with several blocks and ranges."""

import random

import numpy as np
from pyspark.sql import functions as F

from inkstrata.operators import learn, profile, relational, stats


def test_shapiro_wilk_of_published_samples():
    w, p = stats.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert abs(w - 0.7888) < 5e-4 and abs(p - 0.0067) < 2e-4
    assert stats.shapiro_wilk([1.0, 1.0, 1.0]) == (1.0, 1.0) and np.isnan(stats.shapiro_wilk([1.0, 2.0])[0])
    rng = np.random.default_rng(1)
    assert stats.shapiro_wilk(rng.normal(size=800).tolist())[1] > 0.05 > stats.shapiro_wilk(rng.exponential(size=800).tolist())[1]


def test_normality_of_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b) if i % 3 else None) for i, (a, b) in enumerate(zip(rng.normal(size=400), rng.exponential(size=400), strict=True))]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    out = {r["feature"]: r for r in stats.normality(df, "id", ["a", "b"]).collect()}
    assert (out["a"]["n"], out["b"]["n"]) == (400, 266) and out["a"]["p_value"] > 0.05 > out["b"]["p_value"]
    assert np.isclose(out["a"]["w"], stats.shapiro_wilk([r[1] for r in rows])[0])
    assert stats.normality(df, "id", ["a"], most=50).first()["n"] == 50
    assert stats.normality(df.limit(0), "id", ["a"]).count() == 0


def test_ranks_over_ranges(spark):
    rng = random.Random(3)
    x = [rng.choice([0, 1, 1, 2, rng.randint(0, 1000)]) for _ in range(600)]
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(x)], "id int, x int, g int")
    want = {i: sum(u < v for u in x) + (sum(u == v for u in x) + 1) / 2 for i, v in enumerate(x)}
    assert {r["id"]: r["rank"] for r in stats.average_ranks(df, "x", []).collect()} == want
    own = {i: sum(u < v for u in x[i % 2 :: 2]) + (sum(u == v for u in x[i % 2 :: 2]) + 1) / 2 for i, v in enumerate(x)}
    assert {r["id"]: r["rank"] for r in stats.average_ranks(df, "x", ["g"]).collect()} == own


def test_quantile_by_histograms(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=3000), np.full(2000, 0.5), rng.exponential(size=1000) * 1e6])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for q in (0, 0.37, 0.5, 0.99, 1):
        assert np.isclose(learn.quantile(df, "x", q, few=50, bins=20), np.quantile(x, q))
    assert np.isnan(learn.quantile(df.limit(0), "x", 0.5))


def test_neighbours_clusters_and_silhouette_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(learn, "BLOCK", 60)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(80, 3)), rng.normal(size=(70, 3)) + 8])
    x[3] = x[4]
    df = spark.createDataFrame([(i, v.tolist(), int(i >= 80)) for i, v in enumerate(x)], "id bigint, v array<double>, c int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in learn.knn_edges(df, "id", "v", 5).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    assert got == {i: np.lexsort((np.arange(150), d[i]))[:5].tolist() for i in range(150)}
    np.fill_diagonal(d, 0)
    label = np.array([0] * 80 + [1] * 70)
    a = np.array([d[i, label == label[i]].sum() / ((label == label[i]).sum() - 1) for i in range(150)])
    b = np.array([d[i, label != label[i]].mean() for i in range(150)])
    assert np.isclose(learn.silhouette(df, "id", "v", "c").first()[0], ((b - a) / np.maximum(a, b)).mean())
    core = (d <= 1.0).sum(axis=1) >= 4
    clusters = {r["id"]: r["cluster"] for r in learn.dbscan(df, "id", "v", 1.0, 4).collect()}
    assert all((clusters[i] >= 0) == bool((core & (d[i] <= 1.0)).any()) for i in range(150))
    assert all(clusters[i] == clusters[j] for i in range(150) for j in range(150) if core[i] and core[j] and d[i, j] <= 1.0)


def test_overlap(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    left = [(i, [rng.choice(words[:5] + words) for _ in range(rng.randint(0, 12))]) for i in range(40)]
    right = [(i, [rng.choice(words[:5] + words) for _ in range(rng.randint(0, 80))]) for i in range(60)] + [(99, left[7][1])]
    for least in (0.5, 0.8):
        want = {}
        for i, a in left:
            shares = [(-len(set(a) & set(b)) / len(set(a)), j) for j, b in right if a and len(set(a) & set(b)) > least * len(set(a))]
            if shares:
                want[i] = min(shares)[1]
        got = relational.best_overlap(spark.createDataFrame(left, "l int, words array<string>"), spark.createDataFrame(right, "r int, words array<string>"), "l", "r", least=least)
        assert {r["l"]: r["r"] for r in got.collect()} == want and want


def test_columns_by_name_and_kind(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a_n int, a_s string, b double")
    assert profile.columns_like(df, "a_") == ["a_n", "a_s"] and profile.columns_like(df, numeric=True) == ["a_n", "b"]
    assert profile.described(df.withColumn("b", F.lit(None).cast("double")), ["a_n", "b"]).count() == 1


def test_forest_from_all_rows(spark):
    """Far rows are flagged, however few of all rows a tree sees; any partitions, no rows and equal rows."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    x[:6] += 15
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    flags = [{r["id"] for r in learn.isolation_forest(df.repartition(p), "id", "v", 0.002, 40, size=64).where("anomaly_iforest = -1").collect()} for p in (3, 8)]
    assert flags[0] == flags[1] == set(range(6))
    assert learn.isolation_forest(df.limit(0), "id", "v").count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(9)], "id bigint, v array<double>")
    assert learn.isolation_forest(same, "id", "v").where("anomaly_iforest = -1").count() == 0

"""Communities, spectral clusters, spanning trees and robust detectors, each on a case that simpler stand-ins miss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstrata.operators import graphs, learn, robust
from inkstrata.operators.stats import chi2_cdf


def planted(groups=4, size=12, inside=0.5, across=0.03, seed=1):
    rng = np.random.default_rng(seed)
    n = groups * size
    g = np.arange(n) // size
    u, v = np.triu_indices(n, 1)
    on = rng.random(len(u)) < np.where(g[u] == g[v], inside, across)
    return [(int(a), int(b)) for a, b in zip(u[on], v[on], strict=True)], g


def quality(edges, label, gamma=1.0):
    m2 = 2 * len(edges)
    k, inside = {}, 0
    for a, b in edges:
        k[label[a]] = k.get(label[a], 0) + 1
        k[label[b]] = k.get(label[b], 0) + 1
        inside += 2 * (label[a] == label[b])
    return inside / m2 - gamma * sum((x / m2) ** 2 for x in k.values())


def connected(edges, label):
    home = {}

    def top(x):
        while home.setdefault(x, x) != x:
            x = home[x]
        return x

    for a, b in edges:
        if label[a] == label[b]:
            home[top(a)] = top(b)
    roots = {}
    for x, c in label.items():
        roots.setdefault(c, set()).add(top(x))
    return all(len(r) == 1 for r in roots.values())


def test_communities_of_high_modularity_hang_together(spark):
    edges, g = planted()
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    found = {r["id"]: r["cluster"] for r in graphs.leiden(df, 1.0).collect()}
    assert connected(edges, found) and all(c == min(i for i in found if found[i] == c) for c in found.values())
    own = quality(edges, found)
    assert np.isclose(graphs.modularity(df, spark.createDataFrame(list(found.items()), "id bigint, cluster bigint")), own)
    plain = {r["id"]: r["cluster"] for r in learn.communities(df).collect()}
    truth = quality(edges, {i: int(c) for i, c in enumerate(g)})
    assert own >= quality(edges, plain) - 1e-9 and own >= 0.97 * truth


def test_resolution_and_weights_of_communities(spark):
    edges = [(a, b) for base in (0, 5, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 5), (9, 10)]
    df = spark.createDataFrame([(a, b, 2.0) for a, b in edges] + [(3, 3, 9.0)], "src bigint, dst bigint, w double").repartition(7)
    cliques = {frozenset(range(x, x + 5)) for x in (0, 5, 10)}
    groups = lambda rows: {frozenset(i for i in range(15) if rows[i] == c) for c in rows.values()}
    assert groups({r["id"]: r["cluster"] for r in graphs.leiden(df).collect()}) == cliques
    assert len(groups({r["id"]: r["cluster"] for r in graphs.leiden(df, resolution=0.01).collect()})) == 1
    assert graphs.leiden(df.where("src = dst")).count() == 0


def rings(n=60):
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    near = np.stack([np.cos(t), np.sin(t)], axis=1)
    return np.concatenate([near, 3 * near])


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")


def test_spectral_clusters_separate_two_rings(spark):
    x = rings()
    edges = learn.knn_edges(table(spark, x), "id", "v", 4)
    # a bridge, so that the graph is in one piece
    edges = edges.select("src", "dst").union(spark.createDataFrame([(0, 60)], "src bigint, dst bigint"))
    vectors, values = graphs.spectral_embedding(edges, 2)
    got = {r["id"]: r["cluster"] for r in graphs.rows_clustered(vectors, 2).collect()}
    assert len({got[i] for i in range(60)}) == len({got[i] for i in range(60, 120)}) == 1 and got[0] != got[60]
    a = np.zeros((120, 120))
    for r in edges.collect():
        a[r["src"], r["dst"]] += 1
        a[r["dst"], r["src"]] += 1
    d = 1 / np.sqrt(a.sum(axis=1))
    want = np.linalg.eigvalsh(d[:, None] * a * d)[::-1][:2]
    assert np.allclose(values, want, atol=1e-4)


def prim(x):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    best, total, inside = d[0].copy(), [], {0}
    best[0] = np.inf
    while len(inside) < n:
        i = int(best.argmin())
        total.append(best[i])
        inside.add(i)
        best = np.minimum(best, d[i])
        best[list(inside)] = np.inf
    return np.sort(total)


@pytest.mark.parametrize("k", [3])
def test_spanning_tree_and_single_linkage(spark, k):
    rng = np.random.default_rng(2)
    # tight groups of more than k rows, whose nearest neighbours never leave them
    x = np.concatenate([rng.normal(c, 0.05, (20, 3)) for c in rng.normal(0, 3, (12, 3))] + [rng.normal(0, 3, (40, 3))])
    df = table(spark, x)
    edges = learn.knn_edges(df, "id", "v", k)
    tree = graphs.spanning_tree(df, "id", "v", edges)
    assert np.allclose(np.sort([r["dist"] for r in tree.collect()]), prim(x))
    if k == 3:
        heights = prim(x)
        got = {r["id"]: r["cluster"] for r in graphs.cut(df, "id", tree, height=float(heights[-9] + 1e-9)).collect()}
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= heights[-9] + 1e-9
        label = np.arange(len(x))
        for _ in range(len(x)):
            label = np.where(d, label[None], len(x)).min(axis=1)
        assert [got[i] for i in range(len(x))] == label.tolist()
        assert len({r["cluster"] for r in graphs.cut(df, "id", tree, clusters=9).collect()}) == 9


def test_robust_covariance_finds_what_hides_the_plain_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 3))
    x[:90] = rng.normal(0, 0.3, (90, 3)) + [12, 12, 0]  # a group that pulls mean and covariance towards it
    df = table(spark, x)
    flagged = lambda out: {r["id"] for r in out.where("anomaly_ee = -1").collect()}
    share = 90 / 600
    assert flagged(robust.robust_envelope(df, "id", "v", share)) == set(range(90))
    assert len(flagged(learn.elliptic_envelope(df, "v", share)) & set(range(90))) < 75
    mean, cov = robust.minimum_covariance(df, "id", "v")
    assert np.abs(mean).max() < 0.2 and np.abs(cov - np.eye(3)).max() < 0.3


def test_chi2():
    assert np.isclose(chi2_cdf(3.841459, 1), 0.95) and np.isclose(chi2_cdf(11.0705, 5), 0.95, atol=1e-6) and np.isclose(robust.chi2_quantile(0.975, 3), 9.348404, atol=1e-5)


def test_one_class_machine_flags_a_share_at_the_margin(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal([-3, 0], 0.4, (300, 2)), rng.normal([3, 0], 0.4, (300, 2)), [[0, 0], [0, 4], [-7, 0]]])
    out = robust.one_class_machine(table(spark, x), "id", "v", nu=0.05, gamma=0.5, features=400, score="margin").collect()
    bad = {r["id"] for r in out if r["anomaly_svm"] == -1}
    assert abs(len(bad) / len(x) - 0.05) < 0.01 and {600, 601, 602} <= bad
    assert all((r["margin"] < 0) == (r["id"] in bad) for r in out)
    # the middle between two groups is near the mean of all rows, but outside of both
    assert next(r["margin"] for r in out if r["id"] == 600) < 0


def test_optimum_of_the_one_class_machine(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 2))
    nu, m = 0.2, 300
    gen = np.random.default_rng(0)
    w, b = gen.normal(size=(2, m)) * np.sqrt(2 * 0.5), gen.uniform(0, 2 * np.pi, m)
    phi = np.cos(x @ w + b) * np.sqrt(2 / m)
    # the dual by many exact steps in NumPy
    alpha = np.full(120, 1 / 120)
    for t in range(3000):
        s = phi @ (alpha @ phi)
        low = np.zeros(120)
        low[np.argsort(s, kind="stable")[:24]] = 1 / 24
        alpha += 2 / (t + 3) * (low - alpha)
    s = phi @ (alpha @ phi)
    out = robust.one_class_machine(table(spark, x), "id", "v", nu=nu, gamma=0.5, features=m, rounds=40, score="margin").orderBy("id").collect()
    margin = np.array([r["margin"] for r in out])
    assert np.corrcoef(margin, s)[0, 1] > 0.995


def test_single_linkage_at_a_height_needs_no_tree_and_no_neighbours(spark, monkeypatch):
    monkeypatch.setattr(graphs, "BLOCK", 32)
    rng = np.random.default_rng(8)
    # one large cluster, copies, small clusters over several blocks, rows alone, one without a vector
    x = np.concatenate([rng.normal(0, 0.4, (300, 3)), np.repeat(rng.normal(6, 1, (3, 3)), 12, axis=0), rng.normal(-6, 1.5, (60, 3)), rng.uniform(-30, 30, (40, 3))])
    rows = [(i + 5, v.tolist()) for i, v in enumerate(x)] + [(1, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    for height in (0.0, 0.35, 1.2):
        got = {r["id"]: r["cluster"] for r in graphs.single_linkage(df, "id", "v", height=height).collect()}
        near, label = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= height, np.arange(len(x))
        while True:
            new = np.where(near, label[None], len(x)).min(axis=1)
            if (new == label).all():
                break
            label = new
        assert got == {1: 1} | {i + 5: int(c) + 5 for i, c in enumerate(label)}


def test_neighbours_over_blocks_bring_only_what_can_be_nearest(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, (150, 4)), np.repeat(rng.normal(0, 1, (4, 4)), 9, axis=0), 1e4 + rng.normal(0, 1e-3, (40, 4)), [[1e20] * 4, [-1e20] * 4]])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), d[i]))[:5]}
    for block in (16_384, 64, 4):
        monkeypatch.setattr(learn, "BLOCK", block)
        assert {(r["src"], r["dst"]) for r in learn.knn_edges(table(spark, x), "id", "v", 5).collect()} == want
    # a row whose bound is known takes no row beyond it from another block
    row, at = learn._close(x[:150], x[150:186], np.full(150, 0.5), 10_000)
    assert set(zip(row.tolist(), at.tolist())) >= set(zip(*np.nonzero(d[:150, 150:186] <= 0.5))) and len(row) < 150


def test_dbscan_in_cells_writes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(0, 0.05, (200, 3)), np.repeat(rng.normal(1, 0.1, (5, 3)), 6, axis=0), rng.uniform(-1.5, 1.5, (400, 3)), np.arange(12)[:, None] * [[0.25, 0, 0]] + 3])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = (d <= 0.25).sum(axis=1) >= 5
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where((d <= 0.25) & core[None], label[None], len(x)).min(axis=1), len(x))
        if (new == label).all():
            break
        label = new
    number = {c: i for i, c in enumerate(sorted({int(c) for c in label[core]}))}
    want = {}
    for i in range(len(x)):
        near = [(d[i, j], j) for j in np.flatnonzero(core & (d[i] <= 0.25))]
        want[i] = number[int(label[min(near)[1]])] if near else -1
    monkeypatch.setattr(learn, "_with_blocks", None)  # by which all pairs came
    got = {r["id"]: r["cluster"] for r in learn.dbscan(table(spark, x), "id", "v", 0.25, 5).collect()}
    assert got == want and len(number) > 3 and -1 in want.values()


def test_scores_and_neighbours_are_computed_once(spark):
    """each pass of a quantile went through the neighbours, and each use of the edges, again."""
    rows = spark.range(60).select("id", F.array((F.col("id") % 7).cast("double"), (F.col("id") * F.col("id") % 11).cast("double")).alias("v"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    edges = learn.knn_edges(rows, "id", "v", 5)
    lof = learn.lof(edges, 5)
    assert "FlatMapGroups" in plan(edges) and "FlatMapGroups" not in plan(lof)
    flagged = learn._flag_top(learn._scored(rows, "v", lambda x: x[:, 0], "s"), "s", 0.2, "flag")
    assert "Python" not in plan(flagged) and flagged.where("flag = -1").count() == flagged.where("s > 5.1").count() == 8

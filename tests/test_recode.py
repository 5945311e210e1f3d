import math

from pyspark.sql import functions as F

from inkstrata.functions import recode as r
from inkstrata.functions import text as t
from inkstrata.operators import learn, profile, relational, stats


def one(spark, values, fn, kind="double"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [row[0] for row in df.select(fn(F.col("x"))).collect()]


def test_scores_have_their_gaps_and_defaults(spark):
    assert one(spark, [18.5, 24.9, 24.95, 25.0, 29.95, 30.0, 35.0, None], r.bmi_score) == [1, 1, 0, 0.6, 0, 0.3, 0, 0]
    assert one(spark, [5.0, 6.0, 7.0, 9.0, 10.0, 12.0, 12.5, None], r.sleep_score) == [0.3, 0.6, 1, 1, 0.6, 0.3, 0, 0]
    assert one(spark, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0, None], r.fifths_score) == [0, 0, 0.25, 0.5, 0.75, 1, 1]
    assert one(spark, ["No", "Yes (during pregnancy)", "0", "?", None], r.diabetic, "string") == [0, 0.67, 0, None, None]
    assert one(spark, ["18-24", "80 or older", "x"], r.age_midpoint, "string") == [21, 85, None]
    assert one(spark, [0, 4, 7, 12], r.age_group, "int") == [0.0, 0.33, 0.66, 1.0]


def test_report_expressions(spark):
    df = spark.createDataFrame([(100, 100, 100), (80, 100, 100), (5, 0, 0), (0, 0, 0), (98, 100, 100)], "c int, b int, n int")
    assert [x[0] for x in df.select(r.report_difference(F.col("c"), F.col("b"), F.col("n"))).collect()] == [False, True, True, False, False]
    assert [x[0] for x in df.select(r.accuracy_percent(F.col("c"), F.col("b"))).collect()] == ["100.0%", "80.0%", "", "", "98.0%"]
    assert one(spark, [0.0, 1.0], r.minus_log10) == [300.0, 0.0]
    assert one(spark, [0.0005, 0.005, 0.04, 0.5], r.significance) == ["***", "**", "*", ""]


def test_text(spark):
    assert one(spark, ["a12b3", "abc"], t.first_digits, "string") == ["12", "abc"]
    assert one(spark, ["a12b3", "abc"], lambda c: t.last_digits(c, F.lit("Unknown")), "string") == ["3", "Unknown"]
    assert one(spark, ["12a", "abc", " 7"], t.unsigned, "string") == [12, 0, 7]
    assert one(spark, ["p02", "p3", "x"], t.page_is_even, "string") == [True, False, False]
    sizes = one(spark, ["ace", "ace,", "bad", "gap", "by"], lambda c: t.effective_font_size(F.lit(30), c), "string")
    assert sizes == [30, 27, 20, 20, 15]
    df = spark.createDataFrame([("abcdefghij", "abcdefghxy"), ("abc", "xyz")], "a string, b string")
    assert [x[0] for x in df.select(t.close_labels(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_upsert_is_idempotent(spark):
    batch = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "k int, v string, o int")
    target = spark.createDataFrame([(2,)], "k int")
    new = relational.new_rows(batch, target, ["k"], ["o"])
    assert [tuple(x) for x in new.collect()] == [(1, "a", 1)]
    assert relational.new_rows(batch, target.unionByName(new.select("k")), ["k"], ["o"]).count() == 0


def test_p_values():
    assert math.isclose(stats.f_p_value(3.0, 4, 20), 0.0432010, rel_tol=1e-4)
    assert math.isclose(stats.t_p_value(2.0, 10), 0.0733880, rel_tol=1e-4)
    assert math.isclose(stats.z_p_value(1.96), 0.0499958, rel_tol=1e-4)


def test_p_value_columns(spark):
    df = spark.createDataFrame([(3.0, 4.0, 20.0)], "f double, a double, b double")
    assert math.isclose(df.select(stats.f_p(F.col("f"), F.col("a"), F.col("b"))).first()[0], 0.0432010, rel_tol=1e-4)


def test_crosstab_rows_sum_to_100(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "r string, c string")
    out = profile.crosstab_percent(df, "r", "c", ["x", "y"]).collect()
    assert {x["r"]: (x["pct_x"], x["pct_y"]) for x in out} == {"a": (50.0, 50.0), "b": (100.0, 0.0)}


def test_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    data = [(i, [float(v) for v in rng.normal(c, 0.1, 2)]) for i, c in enumerate([0.0] * 30 + [5.0] * 30)] + [(99, [50.0, 50.0])]
    df = spark.createDataFrame(data, "row_id bigint, x array<double>")
    found = {r["row_id"]: r["cluster"] for r in learn.dbscan(df, "row_id", "x", 1.0, 5).collect()}
    assert {found[i] for i in range(30)} == {0} and {found[i] for i in range(30, 60)} == {1} and found[99] == -1
    assert learn.cut_tree(learn.ward(np.array([[0.0], [0.1], [5.0], [5.2]])), 4, clusters=2) == [1, 1, 2, 2]
    assert learn.chord_elbow([1, 2, 3, 4], [10, 2, 1, 0.5]) == 2
    edges = learn.knn_edges(df, "row_id", "x", 5)
    scores = {r["row_id"]: r["lof"] for r in learn.lof(edges, 5).collect()}
    assert max(scores, key=scores.get) == 99
    flagged = learn.isolation_forest(df, "row_id", "x", share=0.01, trees=20)
    assert flagged.where("anomaly_iforest = -1").select("row_id").first()[0] == 99

"""Known answers: separation types, verdicts, trees, day index, Shapley values."""

import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwatch.operators import labels, leakage, removal, stumps, timing
from labelwatch.operators.tree_paths import TreePaths, probability_shapley
from labelwatch.operators.reporting import sig_figs
from labelwatch.sources.views import LabelledTable


def table(spark, columns, y):
    names = list(columns)
    rows = [(i, int(y[i]), *[float(columns[n][i]) for n in names]) for i in range(len(y))]
    schema = "id long, label int, " + ", ".join(f"{n} double" for n in names)
    return LabelledTable(spark.createDataFrame(rows, schema), tuple(names), "t")


def test_separation_types(spark):
    y = [1] * 5 + [0] * 5
    t = table(spark, {"disjoint": [1, 2, 3, 4, 5, 6, 7, 8, 9, 9], "mass": [1, 2, 3, 4, 9, 9, 9, 9, 9, 9],
                      "overlap": [1, 5, 3, 9, 2, 1, 5, 3, 9, 9]}, y)
    got = {r["feature"]: r["separation_type"] for r in leakage.separation_type(t).collect()}
    assert got == {"disjoint": "disjoint", "mass": "degenerate_point_mass", "overlap": "genuine_overlap"}


def test_threshold_same_under_any_partitioning(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    t = table(spark, {"x": rng.normal(y * 2.0), "k": rng.integers(0, 3, 200)}, y)
    a = sorted(leakage.best_threshold(LabelledTable(t.frame.repartition(1), t.features, "t")).collect())
    b = sorted(leakage.best_threshold(LabelledTable(t.frame.repartition(32), t.features, "t")).collect())
    assert a == b


def test_depth_three_tree_learns_alternating_bands(spark):
    x = list(range(40))
    y = [(v // 10) % 2 for v in x]
    t = table(spark, {"x": x}, y)
    t = LabelledTable(t.frame.withColumn("split", F.when(F.col("id") % 5 == 2, "test").otherwise("train")), ("x",), "t")
    assert stumps.single_feature_tree([t]).first()["accuracy"] == 1.0


def test_published_curve_gives_the_published_verdicts(spark):
    acc = [1.0] + [0.9999, 0.9998, 0.9997, 0.9996, 0.9995, 0.9994, 0.9992, 0.999, 0.998, 0.997, 0.9965, 0.9963, 0.996] + [0.989191]
    rows = [("p", i, 50 - i, a, "f") for i, a in enumerate(acc)]
    curve = spark.createDataFrame(rows, "dataset string, iteration int, n_features int, accuracy double, removed_feature string")
    got = {r["threshold"]: r["verdict"] for r in removal.verdict_at(curve).collect()}
    assert got == {0.97: "undetermined", 0.98: "undetermined", 0.99: "repairable", 0.995: "repairable"}


def test_label_gate_refuses_inversion(spark):
    df = spark.createDataFrame([("a",)] * 7 + [("b",)] * 3, "raw string")
    assert labels.checked_labels(df, "raw", {"a": 1, "b": 0}, 0.7, "t").count() == 10
    with pytest.raises(ValueError):
        labels.checked_labels(df, "raw", {"a": 0, "b": 1}, 0.7, "t")
    with pytest.raises(ValueError):
        labels.checked_labels(df, "raw", {"a": 1}, 0.7, "t")


def test_day_index_across_block_borders(spark, monkeypatch):
    clocks = ["23:00:00", "23:30:00", "00:10:00", "00:20:00", "12:00:00", "01:00:00", "00:30:00", "02:00:00"]
    rows = [("f", i, c) for i, c in enumerate(clocks)]
    for block in (1, 2, 3, 100):
        monkeypatch.setattr(timing, "LINE_BLOCK", block)
        got = timing.day_index(spark.createDataFrame(rows, "file string, line_no long, clock string")).orderBy("line_no").collect()
        assert [r["day"] for r in got] == [0, 0, 1, 1, 1, 2, 3, 3]


def test_significant_figures(spark):
    df = spark.createDataFrame([(123456.789,), (0.00012345678,), (0.0,), (-98.7654321,)], "x double")
    got = [r["x"] for r in sig_figs(df, ["x"]).collect()]
    assert got == pytest.approx([123457.0, 0.000123457, 0.0, -98.7654], rel=1e-12)


def brute_shapley(x, background, low, high, value):
    n = len(x)

    def f(point):
        return float(value[((point > low) & (point <= high)).all(axis=1)].sum())

    phi = np.zeros(n)
    for b in background:
        for j in range(n):
            others = [i for i in range(n) if i != j]
            for size in range(n):
                for s in itertools.combinations(others, size):
                    w = factorial(size) * factorial(n - size - 1) / factorial(n)
                    base = b.copy()
                    base[list(s)] = x[list(s)]
                    with_j = base.copy()
                    with_j[j] = x[j]
                    phi[j] += w * (f(with_j) - f(base))
    return phi / len(background)


def test_leaf_formula_is_the_shapley_value():
    rng = np.random.default_rng(3)
    low = np.where(rng.random((6, 4)) < 0.5, -np.inf, rng.random((6, 4)) - 0.5)
    high = np.where(rng.random((6, 4)) < 0.5, np.inf, rng.random((6, 4)) + 0.3)
    value = rng.random(6)
    paths = TreePaths(np.tile(np.arange(4), 6), low.ravel(), high.ravel(), np.arange(0, 25, 4), value, np.ones(6), 6, 1)
    x, bg = rng.random((3, 4)), rng.random((5, 4))
    got = probability_shapley(x, bg, paths)
    for i in range(3):
        assert got[i] == pytest.approx(brute_shapley(x[i], bg, low, high, value), abs=1e-12)

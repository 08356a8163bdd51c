"""Boosted trees: both ways of growing agree, splits equal a search over all of them, quality equals Spark ML's."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from seqloom.operators import baseline, boosting


def table(spark, n=120, features=3, slots=2, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, features)).round(2)
    y = np.stack([x[:, 0] * (k + 1) + np.abs(x[:, 1]) + 0.1 * rng.normal(size=n) for k in range(slots)], axis=1)
    rows = [(i, x[i].tolist(), i % 3, y[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id int, features array<double>, fold int, target array<double>"), x, y


def test_best_split_equals_a_search_over_all():
    rng = np.random.default_rng(4)
    sizes = [3, 1, 5]
    layout = boosting.Layout(np.cumsum([0, *sizes[:-1]]), sum(sizes))
    for _ in range(30):
        bins = np.stack([rng.integers(0, s, 20) for s in sizes], axis=1).astype(np.uint8)
        y, node = rng.normal(size=20), rng.integers(0, 2, 20)
        f, c, v = boosting.best_splits(boosting.histogram(bins.astype(np.int64) + layout.starts, node, 2, y, layout), layout)
        for k in range(2):
            own = node == k
            options = [(((y[own] - np.where(r := bins[own, j] > b, y[own][r].mean(), y[own][~r].mean())) ** 2).sum(), j, b)
                       for j, s in enumerate(sizes) for b in range(s - 1) if 0 < (bins[own, j] > b).sum() < own.sum()]
            error, j, b = min(options)
            right = bins[own, f[k]] > c[k]
            assert ((y[own] - np.where(right, v[k, 1], v[k, 0])) ** 2).sum() == pytest.approx(error)


def test_passes_and_sent_rows_grow_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 2)
    monkeypatch.setattr(boosting, "FAN", 2)
    df, *_ = table(spark)
    df = df.repartition(5).withColumn("target", F.when(F.col("id") == 7, F.array(F.lit(None).cast("double"), F.lit(1.0))).otherwise(F.col("target")))
    one, two = ({r["id"]: r for r in baseline.gbm_predictions(df, slots=[0, 1], iterations=5, small=s).collect()} for s in (1 << 20, 0))
    assert len(one) == len(two) == 120
    for i, r in one.items():
        assert two[i]["in_sample"] == pytest.approx(r["in_sample"]) and two[i]["held_out"] == pytest.approx(r["held_out"])


def test_quality_equals_spark_ml(spark):
    df, _, y = table(spark, n=400, slots=1)
    out = baseline.gbm_predictions(df, slots=[0], iterations=40).collect()
    seen = df.withColumns({"v": array_to_vector("features"), "label": F.col("target")[0]})
    other = GBTRegressor(featuresCol="v", labelCol="label", maxIter=40, maxDepth=3, stepSize=0.1, seed=1).fit(seen).transform(seen).collect()

    def r2(pairs):
        a, p = np.array(pairs).T
        return 1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum()

    mine, theirs = r2([(r["target"][0], r["in_sample"][0]) for r in out]), r2([(r["label"], r["prediction"]) for r in other])
    assert mine > theirs - 0.02 and r2([(r["target"][0], r["held_out"][0]) for r in out]) > 0.8


def test_constant_targets_and_no_rows(spark):
    df, *_ = table(spark, n=30, slots=1)
    flat = baseline.gbm_predictions(df.withColumn("target", F.array(F.lit(2.5))), slots=[0], iterations=3).collect()
    assert {r["in_sample"][0] for r in flat} == {2.5}
    assert baseline.gbm_predictions(df.where("id < 0"), slots=[0], iterations=3).count() == 0


def test_smaller_children_and_joint_bins_give_all_sums(monkeypatch):
    monkeypatch.setattr(boosting, "JOINT", 40)
    rng = np.random.default_rng(5)
    sizes = [7, 5, 1, 30, 3]
    layout = boosting.Layout(np.cumsum([0, *sizes[:-1]]), sum(sizes))
    assert layout.runs == [(0, 3), (3, 4), (4, 5)]
    bins = np.stack([rng.integers(0, s, 500) for s in sizes], axis=1).astype(np.uint8)
    columns, y, summed = np.ascontiguousarray(bins.T), rng.normal(size=500), []
    whole = boosting._cells
    monkeypatch.setattr(boosting, "_cells", lambda joint, *rest: summed.append(len(joint[0])) or whole(joint, *rest))
    # The node at 1 is not split.
    feature, cut, right, sums = np.array([3, -1, 0, -1, -1, 4, -1]), np.array([20, 0, 1, 0, 0, 0, 0]), None, None
    for level in range(3):
        summed.clear()
        found = layout.by_bin(boosting.level_sums(boosting.joint_bins(columns, layout), columns, y, feature, cut, level, right, layout))
        sums = boosting.both_children(sums, found, right) if level else found
        node = boosting.leaves(feature, cut, columns, level)
        assert np.allclose(sums, boosting.histogram(bins.astype(np.int64) + layout.starts, node, 1 << level, y, layout))
        assert level == 0 or max(summed) <= 250
        here = slice((1 << level) - 1, (2 << level) - 1)
        right = boosting.small_children(sums, feature[here], cut[here], layout)
    everything = boosting.leaves(feature, cut, columns, 3)
    assert set(everything) == {0, 4, 5, 6} and len(set(bins[everything == 0, 3] > 20)) == 1


def test_a_pass_reads_packed_rows(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(boosting, "stored", lambda df, whole=boosting.stored: kept.append(whole(df)) or kept[-1])
    df, *_ = table(spark, n=200)
    baseline.gbm_predictions(df.coalesce(1), slots=[0], iterations=2, small=0).collect()
    assert kept[-1].count() == 1 and {t for _, t in kept[-1].dtypes} == {"binary"}


def test_root_sums_follow_from_the_tree_before(monkeypatch):
    """Sent rows: after the first tree no pass sums all rows, and the trees are those of residuals that are summed anew."""
    rng = np.random.default_rng(7)
    sizes = [9, 4, 1, 12]
    layout = boosting.Layout(np.cumsum([0, *sizes[:-1]]), sum(sizes), 300)
    columns = np.stack([rng.integers(0, s, 300) for s in sizes]).astype(np.uint8)
    y, levels = columns[0] * 0.3 - (columns[3] > 5) + rng.normal(size=300), []
    monkeypatch.setattr(boosting, "level_sums", lambda *a, whole=boosting.level_sums, **more: levels.append(a[5]) or whole(*a, **more))
    made = boosting.grow(columns, y, layout, 6, 3)
    assert levels.count(0) == 1
    now, flat = np.full(300, y.mean()), columns.T.astype(np.int64) + layout.starts
    for feature, cut, value in zip(made.feature, made.cut, made.value):
        for level in range(3):
            here = slice((1 << level) - 1, (2 << level) - 1)
            f, c, last = boosting.best_splits(boosting.histogram(flat, boosting.leaves(feature, cut, columns, level), 1 << level, y - now, layout), layout)
            assert (f == feature[here]).all() and (c == cut[here]).all()
        assert value == pytest.approx(last.ravel())
        now += boosting.RATE * value[boosting.leaves(feature, cut, columns, 3)]


def test_more_rows_are_summed_by_more_joint_bins():
    sizes = [10] * 400
    small, large = (boosting.Layout(np.cumsum([0, *sizes[:-1]]), sum(sizes), rows) for rows in (0, 400_000))
    assert len(small.runs) == 200 and len(large.runs) == 134
    assert boosting.joint_bins(np.zeros((400, 3), np.uint8), large)[0].dtype == np.uint16

"""Operators against straightforward computations on small inputs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.catalog import baselines
from seqloom.fixed import RESIDUES
from seqloom.operators import ablation, association, baseline, pools, ranking, scoring


@pytest.fixture(scope="module")
def values(spark):
    """Two groups, one of them with a third of its rows equal, plus missing values."""
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 5)) for _ in range(200)] + [("a", 1.25)] * 100
    rows += [("b", rng.choice([-1e9, 0.0, 1e-12, 3.0, 7e8])) for _ in range(57)] + [("b", None), ("b", float("nan"))]
    return spark.createDataFrame(rows, "g string, x double"), rows


def of_group(rows, g):
    return np.array([x for k, x in rows if k == g and x is not None and x == x])


def test_percentiles_match_numpy(values):
    df, rows = values
    for row in ranking.percentiles(df, ["g"], "x", {"p02": 0.02, "p50": 0.5, "p95": 0.95, "top": 1.0}).collect():
        wanted = np.percentile(of_group(rows, row["g"]), [2, 50, 95, 100])
        assert [row["p02"], row["p50"], row["p95"], row["top"]] == pytest.approx(list(wanted))


def test_cumulative_counts(values):
    df, rows = values
    for row in ranking.cumulative_counts(df, ["g"], "x").collect():
        x = of_group(rows, row["g"])
        assert (row["n"], row["upto"], row["total"]) == ((x == row["x"]).sum(), (x <= row["x"]).sum(), len(x))


def test_spread_ranks_are_a_permutation(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    assert sorted(r["rank"] for r in ranking.spread_ranks(df, "id", F.lit(1)).collect()) == list(range(1000))
    inside = ranking.spread_ranks(df, "id", F.lit(1), groups=["g"]).collect()
    for g in range(3):
        mine = sorted(r["rank"] for r in inside if r["g"] == g)
        assert mine == list(range(len(mine)))


def test_best_of_n_agrees_with_simulation(spark, values):
    df, rows = values
    df, x = df.where("g = 'a'"), of_group(rows, "a")
    exact = {r["n_draws"]: r for r in pools.best_of_n(df, ["g"], "x", grid=[1, 4, 16, 64]).collect()}
    drawn = {r["n_draws"]: r for r in pools.best_of_n_bootstrap(df, ["g"], "x", grid=[1, 4, 16], replicates=4000).collect()}
    rng = np.random.default_rng(0)
    assert set(exact) == {1, 4, 16}
    for n, row in exact.items():
        best = rng.choice(x, (40000, n)).max(axis=1)
        assert row["mean"] == pytest.approx(best.mean(), abs=0.15)
        assert row["std"] == pytest.approx(best.std(), abs=0.15)
        assert row["p50"] == pytest.approx(np.percentile(best, 50), abs=0.3)
        assert drawn[n]["mean"] == pytest.approx(best.mean(), abs=0.4) and drawn[n]["n_replicates"] == 4000
    means = [exact[n]["mean"] for n in (1, 4, 16)]
    assert means == sorted(means) and means[-1] <= x.max()


@pytest.mark.parametrize("hits,size,wanted", [(1, 100, 69.0), (0, 100, None), (5, 5, 1.0)])
def test_samples_to_reach(spark, hits, size, wanted):
    assert spark.range(1).select(pools.samples_to_reach(F.lit(hits), F.lit(size))).first()[0] == wanted


def test_r2_across_degenerate_and_plain(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 2.0), (1.0, 1.0, 3.0, 3.5), (1.0, 2.0, 8.0, 6.0)], "c double, d double, y double, p double")
    row = df.agg(scoring.r2_across("c", "c").alias("a"), scoring.r2_across("c", "d").alias("b"), scoring.r2_across("y", "p").alias("e"),
                 scoring.pearson("c", "y").alias("f")).first()
    assert (row["a"], row["b"], row["f"]) == (1.0, 0.0, None)
    assert row["e"] == pytest.approx(1 - (1 + 0.25 + 4) / 26)


def test_signed_rank(spark):
    """One to ten all positive but the smallest: two of 1,024 sign patterns reach so low a sum, each side."""
    rows = [("exact", float(i)) for i in range(2, 11)] + [("exact", -1.0)]
    rows += [("tied", x) for x in (1.0, 1.0, -1.0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, diff double")
    exact = {r["g"]: r for r in ablation.signed_rank_test(df, ["g"], method="exact").collect()}
    assert exact["exact"]["rank_sum_positive"] == 54 and exact["exact"]["p_value"] == pytest.approx(2 * 2 / 1024)
    assert exact["tied"]["p_value"] is None
    out = {r["g"]: r for r in ablation.signed_rank_test(df, ["g"]).collect()}
    assert out["exact"]["z"] == pytest.approx((1 - 27.5) / (10 * 11 * 21 / 24) ** 0.5)
    assert (out["tied"]["n_nonzero"], out["tied"]["n_zero"], out["tied"]["rank_sum_positive"]) == (4, 1, 8.0)
    # Ranks 2, 2, 2, 4: mean 5, variance (4*5*9 - (27-3)/2) / 24 = 7.
    from math import erfc, sqrt
    assert out["tied"]["p_value"] == pytest.approx(erfc(abs(2 - 5) / sqrt(7) / sqrt(2)))


def test_group_folds_are_greedy(spark):
    rng = random.Random(2)
    sizes = [400, 37, 37, 12] + [rng.randrange(1, 9) for _ in range(60)] + [1] * 100
    df = spark.createDataFrame([(f"g{i}",) for i, n in enumerate(sizes) for _ in range(n)], "g string")
    folds = {r["g"]: r["fold"] for r in baseline.group_folds(df, "g", 5).collect()}
    assert len(folds) == len(sizes)
    got = [sum(n for i, n in enumerate(sizes) if folds[f"g{i}"] == f) for f in range(5)]
    loads = [0] * 5
    for n in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += n
    assert got == loads


def test_ridge_matches_direct_solution(spark):
    rng = np.random.default_rng(1)
    n, p = 120, 6
    x = rng.normal(size=(n, p))
    x[:, 5] = 2.0
    y = np.hstack([x[:, :3] @ rng.normal(size=(3, 8)) + rng.normal(size=(n, 8))])
    rows = [(i, x[i].tolist(), y[i].tolist(), i % 4) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, features array<double>, target array<double>, fold int").repartition(3)
    models = baseline.fit_ridge(df, p)

    def direct(xs, ys, a):
        m, s = xs.mean(0), xs.std(0)
        s[s == 0] = 1
        z = (xs - m) / s
        w = np.linalg.solve(z.T @ z + a * np.eye(p), z.T @ (ys - ys.mean(0)))
        return lambda q: (q - m) / s @ w + ys.mean(0)

    def loo(xs, ys, a):
        m, s = xs.mean(0), xs.std(0)
        s[s == 0] = 1
        z = (xs - m) / s
        h = 1 / len(xs) + np.einsum("ij,jk,ik->i", z, np.linalg.inv(z.T @ z + a * np.eye(p)), z)
        return (((ys - direct(xs, ys, a)(xs)) / (1 - h)[:, None]) ** 2).sum()

    out = {r["id"]: r for r in baseline.ridge_predictions(df, models).collect()}
    fold = np.arange(n) % 4
    for f in (-1, 0, 1, 2, 3):
        train = fold != f
        best = min(baseline.PENALTIES, key=lambda a: loo(x[train], y[train], a))
        assert models[f].penalty == pytest.approx(best)
        predict = direct(x[train], y[train], best)
        rows_of = range(n) if f == -1 else np.flatnonzero(~train)
        name = "in_sample" if f == -1 else "held_out"
        for i in rows_of:
            assert out[i][name] == pytest.approx(list(predict(x[i])), abs=1e-8)


def test_boosted_trees_fit_and_hold_out(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=2)], i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, features array<double>, fold int").withColumn("target", F.array(F.col("features")[0] * 2))
    out = baseline.gbm_predictions(df, slots=[0], iterations=10).collect()
    assert len(out) == 80 and all(r["held_out"][0] is not None for r in out)
    error = np.mean([(r["in_sample"][0] - r["target"][0]) ** 2 for r in out])
    assert error < 1.0


def test_registered_trees_and_grid_do_the_whole_job(spark, monkeypatch):
    # Stand-ins for the ensembles: the registered work is eight slots with folds, and the whole grid.
    asked = []

    def fitted(df, slots=None, held_out=True, **_):
        asked.append((slots, held_out))
        slots = list(range(8)) if slots is None else slots
        own = F.array(*(F.col("target")[s] for s in slots))
        return df.withColumns({"in_sample": own, "held_out": own if held_out else F.array(*(F.lit(None).cast("double") for _ in slots)), "fitted_target": own})

    monkeypatch.setattr(baseline, "gbm_predictions", fitted)
    queries, folder = baselines.ENTRIES, "/root/testdata/sf0.001"
    trees = queries["boosted_trees"].run(spark, folder)
    assert {r["n"] for r in trees.groupBy("doc_id").agg(F.count_distinct("property").alias("n")).collect()} == {8}
    assert trees.where("held_out IS NULL AND target IS NOT NULL").isEmpty()
    grid = queries["baseline_grid"].run(spark, folder).collect()
    assert len({(r["property"], r["feature_set"], r["model"]) for r in grid}) == len(grid) == 48
    assert asked == [(None, True)] * 4
    assert queries["baseline_summary"].run(spark, folder).count() == 6
    assert [r["model"] for r in queries["best_baseline"].run(spark, folder).collect()] == ["gbm"]


def test_schemes(spark):
    schemes = association.schemes_table(spark)
    assert association.scheme_defects(schemes).isEmpty()
    broken = spark.createDataFrame([("s", "g", a) for a in "ACDEFGHIKLMNPQRSTVWWX"], "scheme string, residue_group string, residue string")
    assert {(r["residue"], r["defect"]) for r in association.scheme_defects(broken).collect()} == {
        ("W", "repeated"), ("X", "unexpected"), ("Y", "missing")}
    differing = association.scheme_differences(schemes, "A_lehninger_style", "B_alternative").collect()
    assert sorted(r["residue"] for r in differing) == ["C", "G", "H", "Y"]


def test_extremes_need_enough_individuals(spark):
    people = spark.createDataFrame([(i, 1, [0.0] * 20, *[float(i)] * 4) for i in range(5)],
                                   "idv_id int, n_sequences int, fraction_sums array<double>, toughness double, E double, strength double, strain double")
    assert association.extremes(people, 2).count() == 16
    with pytest.raises(Exception, match="at least 6"):
        association.extremes(people, 3).collect()


def test_signed_rank_of_millions_of_rows(spark):
    df = spark.range(2_100_000).select(F.lit("a").alias("g"), (F.pmod("id", F.lit(7)) - F.lit(2.0)).alias("diff"))
    row = ablation.signed_rank_test(df, ["g"]).first()
    # Sizes 1 (two sevenths of the rows, one of them negative), 2 (likewise), 3 and 4, each 300,000 rows to a sign.
    k, m = 300_000, 1_800_000
    ranks = [(2 * k + 1) / 2, 2 * k + (2 * k + 1) / 2, 4 * k + (k + 1) / 2, 5 * k + (k + 1) / 2]
    plus = k * sum(ranks)
    variance = (m * (m + 1) * (2 * m + 1) - (2 * ((2 * k) ** 3 - 2 * k) + 2 * (k**3 - k)) / 2) / 24
    assert (row["n_nonzero"], row["n_zero"], row["rank_sum_positive"]) == (m, k, plus)
    assert abs(row["z"] - (m * (m + 1) / 2 - plus - m * (m + 1) / 4) / variance**0.5) < 1e-6


def test_pairs_of_many_runs(monkeypatch):
    texts = pd.Series(["ACCA", None, "", "A", "CAXAC" * 3, "AC" * 40, "Y"])
    whole = baseline._pairs_of_run(texts)
    monkeypatch.setattr(baseline, "PAIR_RUN", 5)
    assert (baseline._pairs_of(texts) == whole).all()
    assert baseline._pairs_of(texts[:0]).shape == (0, 400)


def test_ridge_passes_read_stored_features(spark, monkeypatch):
    """Features are computed once, whatever the number of passes, and no pass reads a sequence."""
    kept, counted = [], spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<bigint>")
    def residues(texts: pd.Series) -> pd.Series:
        counted.add(len(texts))
        return pd.Series(list(baseline._residues_of(texts)), index=texts.index)

    monkeypatch.setattr(baseline, "residue_counts", residues)
    monkeypatch.setattr(baseline, "stored", lambda df, whole=baseline.stored: kept.append(whole(df)) or kept[-1])
    rng = np.random.default_rng(2)
    rows = [(i, "".join("ACDEFGHIKL"[j] for j in rng.integers(0, 10, 30)), rng.normal(size=8).tolist()) for i in range(60)] + [(60, "", [0.0] * 8)]
    df = spark.createDataFrame(rows, "id int, sequence string, target array<double>").repartition(3)
    scores = baseline.evaluate_ridge(df, "id", "sequence", "dipeptide").collect()
    assert len(scores) == 8 and counted.value == 61
    assert kept and not any("sequence" in df.columns for df in kept)


def test_errors_of_all_penalties_are_those_of_each():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(50, 4)), rng.normal(size=(50, 8))
    m = np.hstack([x, y, np.ones((50, 1))])
    model = baseline.Ridge(m.T @ m, 4)
    z, errors = model.project(x), model.loo_errors(x, y)
    for a, found in zip(baseline.PENALTIES, errors):
        leverage = 1 / 50 + (z * z) @ (1 / (model.values + a))
        assert found == pytest.approx((((y - model.predict(x, a)) / (1 - leverage)[:, None]) ** 2).sum())


def test_residues_of_many_runs(monkeypatch):
    texts = pd.Series(["ACCA", None, "", "A", "CAXéAC" * 3, "AC" * 40, "Y"])
    monkeypatch.setattr(baseline, "PAIR_RUN", 5)
    assert baseline._residues_of(texts).tolist() == [[(t or "").count(a) for a in RESIDUES] for t in texts]

"""Composition baselines: feature columns, folds, ridge with leave-one-out choice of the penalty,
boosted trees, and the mean predictor.

Ridge needs two passes whatever the number of folds: Gram matrices per fold (each training set is
the total less its fold), then the leave-one-out error of every penalty for every training set.
Both reduce to arrays whose size depends on the number of features only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from seqloom.fixed import CANONICAL_MOTIFS, MECHANICAL_SLOTS, PROPERTIES, RESIDUES, SEED
from seqloom.functions.motifs import motif_density
from seqloom.functions.residues import DIPEPTIDES, log_length, residue_fractions
from seqloom.functions.vectors import r2_within
from seqloom.operators import boosting
from seqloom.operators.curation import long_vector, property_name
from seqloom.operators.ranking import spread_ranks
from seqloom.operators.scoring import r2_across
from seqloom.session import stored

PENALTIES = np.logspace(-3, 4, 30)
SALTS = 32
#: Letters whose pairs are counted at once.
PAIR_RUN = 1 << 18


# --- Features --------------------------------------------------------------------------

def composition_features(df: DataFrame, seq: str) -> list[Column]:
    return [*residue_fractions(seq), log_length(seq).alias("log_length")]


def motif_features(df: DataFrame, seq: str) -> list[Column]:
    return [motif_density(seq, p).alias(f"motif_{m}") for m, p in CANONICAL_MOTIFS.items()]


def _in_runs(texts: pd.Series, count, width: int) -> np.ndarray:
    """`count` of a run of texts after the other. Texts are counted PAIR_RUN letters at a time, since the arrays behind a
    letter take some fifty bytes."""
    run = np.cumsum([len(t or "") for t in texts], dtype=np.int64) // PAIR_RUN
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    parts = [count(texts.iloc[a:b]) for a, b in zip(starts, [*starts[1:], len(texts)])]
    return np.concatenate(parts) if parts else np.zeros((0, width), dtype=np.int64)


def _pairs_of(texts: pd.Series) -> np.ndarray:
    """Overlapping pairs of standard residues in each text, 400 counts in alphabetical order."""
    return _in_runs(texts, _pairs_of_run, len(RESIDUES) ** 2)


def _residues_of(texts: pd.Series) -> np.ndarray:
    """How often each text has each residue, 20 counts in alphabetical order."""
    return _in_runs(texts, _residues_of_run, len(RESIDUES))


def _places(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The number of every letter's residue, -1 for other letters and for the line breaks between texts; the row of each."""
    joined = "\n".join(t or "" for t in texts)
    letters = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.full(128, -1, dtype=np.int64)
    code[[ord(r) for r in RESIDUES]] = np.arange(len(RESIDUES))
    sizes = np.array([len(t or "") + 1 for t in texts], dtype=np.int64)
    return np.where(letters < 128, code[np.minimum(letters, 127)], -1), np.repeat(np.arange(len(texts)), sizes)[: len(letters)]


def _residues_of_run(texts: pd.Series) -> np.ndarray:
    place, row = _places(texts)
    size = len(RESIDUES)
    return np.bincount((row * size + place)[place >= 0], minlength=len(texts) * size).reshape(-1, size)


def _pairs_of_run(texts: pd.Series) -> np.ndarray:
    """The same for one run of texts at once, from the codes of their letters."""
    place, row = _places(texts)
    row = row[: max(len(row) - 1, 0)]
    # Texts are a line break apart, so no pair goes across two of them.
    pair = np.where((place[:-1] >= 0) & (place[1:] >= 0), place[:-1] * len(RESIDUES) + place[1:], -1)
    size = len(RESIDUES) ** 2
    return np.bincount((row * size + pair)[pair >= 0], minlength=len(texts) * size).reshape(-1, size)


@F.pandas_udf(ArrayType(LongType()))
def pair_counts(texts: pd.Series) -> pd.Series:
    return pd.Series(list(_pairs_of(texts)), index=texts.index)


@F.pandas_udf(ArrayType(LongType()))
def residue_counts(texts: pd.Series) -> pd.Series:
    return pd.Series(list(_residues_of(texts)), index=texts.index)


@F.pandas_udf(ArrayType(DoubleType()))
def dipeptide_fractions(texts: pd.Series) -> pd.Series:
    """400 fractions in alphabetical order over max(length - 1, 1) positions."""
    widths = np.array([max(len(t or "") - 1, 1) for t in texts])
    return pd.Series(list(_pairs_of(texts) / widths[:, None]), index=texts.index)


def pair_width(seq: str) -> Column:
    return F.greatest(F.length(seq) - 1, F.lit(1))


def dipeptide_counts(df: DataFrame, row_id: str, seq: str, *more: Column) -> DataFrame:
    """(row id, dipeptide, n, more...): overlapping pairs of standard residues that a sequence has, without a shuffle."""
    names = F.array(*[F.lit(d) for d in DIPEPTIDES])
    each = df.select(row_id, *more, F.posexplode(pair_counts(seq)).alias("_place", "n")).where("n > 0")
    return each.withColumn("dipeptide", F.get(names, F.col("_place"))).drop("_place")


FEATURE_SETS = ["composition", "composition+motifs", "dipeptide"]


def with_features(df: DataFrame, row_id: str, seq: str, feature_set: str, name: str = "features") -> DataFrame:
    """Append the feature array: 21, 26 or 421 doubles, NULL where a sequence without residues has none."""
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"no features are defined under {feature_set!r}, only under: {', '.join(FEATURE_SETS)}")
    counts = [F.col("_counts")[i].cast("double") / F.nullif(F.length(seq), F.lit(0)) for i in range(len(RESIDUES))]
    base = [*counts, F.when(F.length(seq) > 0, log_length(seq))]
    if feature_set == "composition+motifs":
        base = base + motif_features(df, seq)
    # What Python counts comes first, so that the other columns are computed in the same stage as what follows them.
    counted = df.withColumn("_counts", residue_counts(seq))
    if feature_set != "dipeptide":
        return counted.withColumn(name, F.array(*base)).drop("_counts")
    pairs = counted.withColumn("_pairs", dipeptide_fractions(seq))
    return pairs.withColumn(name, F.concat(F.array(*base), "_pairs")).drop("_counts", "_pairs")


# --- Folds -----------------------------------------------------------------------------

def with_folds(df: DataFrame, row_id: str, k: int, seed: int = SEED) -> DataFrame:
    """Shuffled folds whose sizes differ by at most one."""
    return spread_ranks(df, row_id, F.lit(seed), F.lit("fold"), rank="_r").withColumn(
        "fold", F.pmod(F.col("_r"), F.lit(k)).cast("int")
    ).drop("_r")


def _deal(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, list[int]]]:
    """Greedy dealing of groups, given (size, number of groups) largest first: each group goes to the
    fold with the fewest rows. Groups of one size are dealt in cycles over the folds that lag, so the
    result is a few (size, first position, cycle of folds) rules rather than one entry per group."""
    loads, rules = [0] * k, []
    for size, n_groups in sizes:
        done = 0
        while done < n_groups:
            order = sorted(range(k), key=lambda f: (loads[f], f))
            lowest = loads[order[0]]
            cycle = [f for f in order if loads[f] < lowest + size]
            waiting = [loads[f] for f in order if loads[f] >= lowest + size]
            left = n_groups - done
            rounds = max(1, (waiting[0] - lowest) // size) if waiting else -(-left // len(cycle))
            dealt = min(rounds * len(cycle), left)
            rules.append((size, done, cycle))
            for i, f in enumerate(cycle):
                loads[f] += size * (dealt // len(cycle) + (1 if i < dealt % len(cycle) else 0))
            done += dealt
    return rules


def group_folds(df: DataFrame, group: str, k: int, seed: int = SEED) -> DataFrame:
    """(group, fold): whole groups, the largest first, each to the fold with the fewest rows.

    Only the histogram of group sizes reaches the driver; groups of one size are dealt by their
    position in a random order, so their number may grow with the data."""
    counts = df.groupBy(group).agg(F.count("*").alias("_size"))
    histogram = counts.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("_size")).collect()
    rules = [(size, first, cycle) for size, first, cycle in _deal([(r["_size"], r["n"]) for r in histogram], k)]
    following = {}
    for (size, first, _), after in zip(rules, rules[1:] + [(None, None, None)]):
        following[(size, first)] = after[1] if after[0] == size else None
    table = df.sparkSession.createDataFrame(
        [(size, first, following[(size, first)], cycle) for size, first, cycle in rules],
        "_size bigint, _first bigint, _next bigint, _cycle array<int>",
    )
    placed = spread_ranks(counts, group, F.lit(seed), F.lit("group"), rank="_position", groups=["_size"])
    position = F.col("_position")
    ruled = placed.join(table, "_size").where(
        (position >= F.col("_first")) & (F.col("_next").isNull() | (position < F.col("_next")))
    )
    index = F.pmod(position - F.col("_first"), F.size("_cycle")).cast("int")
    return ruled.select(group, F.get("_cycle", index).alias("fold"))


def with_group_folds(df: DataFrame, group: str, k: int, seed: int = SEED) -> DataFrame:
    return df.join(group_folds(df, group, k, seed), group)


# --- Mean predictor ---------------------------------------------------------------------

def mean_predictor_scores(df: DataFrame, target: str = "target", fold: str = "fold") -> DataFrame:
    """Per slot and fold: R2 on the fold of the mean over the other folds."""
    long = long_vector(df, [fold], y=target)
    sums = long.groupBy("slot", fold).agg(
        F.count("*").alias("n"), F.sum("y").alias("s"), F.avg("y").alias("m"), F.var_pop("y").alias("v")
    )
    others = Window.partitionBy("slot")
    train_mean = (F.sum("s").over(others) - F.col("s")) / F.nullif(F.sum("n").over(others) - F.col("n"), F.lit(0))
    residual = F.col("n") * (F.col("v") + (F.col("m") - F.col("_train")) * (F.col("m") - F.col("_train")))
    spread = F.col("n") * F.col("v")
    return sums.withColumn("_train", train_mean).select(
        "slot", fold,
        F.when(spread == 0, F.when(residual == 0, 1.0).otherwise(0.0))
        .otherwise(1.0 - residual / F.nullif(spread, F.lit(0.0)))
        .alias("r2"),
    )


# --- Ridge -----------------------------------------------------------------------------

def _sum_by(df: DataFrame, key: str) -> dict[int, np.ndarray]:
    """Element-wise sums of array rows per key, reduced in two steps so that no task adds them all."""
    vectors = df.select(key, array_to_vector("payload").alias("v"), F.pmod(F.col("part"), F.lit(SALTS)).alias("salt"))
    partial = vectors.groupBy(key, "salt").agg(Summarizer.sum(F.col("v")).alias("v"))
    final = partial.groupBy(key).agg(Summarizer.sum(F.col("v")).alias("v")).select(key, vector_to_array("v").alias("v"))
    return {row[key]: np.asarray(row["v"]) for row in final.collect()}


class Ridge:
    """Standardised ridge regression with one penalty shared by all targets."""

    def __init__(self, gram: np.ndarray, n_features: int):
        self.n, p = gram[-1, -1], n_features
        sums, t_sums = gram[-1, :p], gram[-1, p:-1]
        self.mean, self.t_mean = sums / self.n, t_sums / self.n
        cov = gram[:p, :p] - np.outer(sums, sums) / self.n
        scale = np.sqrt(np.maximum(np.diag(cov), 0) / self.n)
        # A constant column has a scale at the level of rounding; it then carries no information.
        tiny = scale <= 1e-9 * np.maximum(np.abs(self.mean), 1e-300)
        self.scale = np.where(tiny | (scale == 0), 1.0, scale)
        z = cov / np.outer(self.scale, self.scale)
        z[tiny, :] = 0
        z[:, tiny] = 0
        cross = (gram[:p, p:-1] - np.outer(sums, t_sums) / self.n) / self.scale[:, None]
        cross[tiny, :] = 0
        self.values, self.basis = np.linalg.eigh(z)
        self.values = np.maximum(self.values, 0)
        self.rotated = self.basis.T @ cross
        self.penalty = None

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.basis

    def predict(self, x: np.ndarray, penalty: float | None = None) -> np.ndarray:
        a = self.penalty if penalty is None else penalty
        return self.project(x) @ (self.rotated / (self.values + a)[:, None]) + self.t_mean

    def loo_errors(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sum of squared leave-one-out errors of these training rows, per penalty."""
        z = self.project(x)
        weights = 1.0 / (self.values[:, None] + PENALTIES)
        leverage = 1.0 / self.n + (z * z) @ weights
        fitted = z @ (self.rotated[:, :, None] * weights[:, None, :]).reshape(len(weights), -1)
        residual = (y - self.t_mean)[:, :, None] - fitted.reshape(len(y), -1, len(PENALTIES))
        return np.sum((residual / np.maximum(1.0 - leverage, 1e-12)[:, None, :]) ** 2, axis=(0, 1))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _complete(features: str) -> Column:
    return F.forall(features, lambda x: x.isNotNull())


def fit_ridge(df: DataFrame, n_features: int, features: str = "features", target: str = "target",
              fold: str = "fold") -> dict[int, Ridge]:
    """Model per held-out fold, and under key -1 the model of all rows. Rows that lack a feature are not fitted."""
    columns = df.where(_complete(features)).select(F.col(features).alias("x"), F.col(target).alias("y"), F.col(fold).alias("fold"))

    def gram(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for f, part in pdf.groupby("fold"):
                m = np.hstack([_stack(part["x"]), _stack(part["y"]), np.ones((len(part), 1))])
                sums[f] = sums.get(f, 0) + m.T @ m
        if sums:
            yield pd.DataFrame({"fold": list(sums), "payload": [g.ravel() for g in sums.values()]})

    width = n_features + len(PROPERTIES) + 1
    partial = columns.mapInPandas(gram, "fold int, payload array<double>").withColumn("part", F.spark_partition_id())
    by_fold = {f: v.reshape(width, width) for f, v in _sum_by(partial, "fold").items()}
    whole = sum(by_fold.values())
    models = {-1: Ridge(whole, n_features), **{f: Ridge(whole - g, n_features) for f, g in by_fold.items()}}
    shared = df.sparkSession.sparkContext.broadcast(models)

    def errors(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for f, part in pdf.groupby("fold"):
                x, y = _stack(part["x"]), _stack(part["y"])
                for held_out, model in shared.value.items():
                    if held_out != f:
                        sums[held_out] = sums.get(held_out, 0) + model.loo_errors(x, y)
        if sums:
            yield pd.DataFrame({"model": list(sums), "payload": list(sums.values())})

    scored = columns.mapInPandas(errors, "model int, payload array<double>").withColumn("part", F.spark_partition_id())
    for held_out, loss in _sum_by(scored, "model").items():
        models[held_out].penalty = float(PENALTIES[int(np.argmin(loss))])
    return models


def ridge_predictions(df: DataFrame, models: dict[int, Ridge], features: str = "features", fold: str = "fold") -> DataFrame:
    """Append the in-sample prediction and the prediction of the model that did not see the row; both NULL for a row
    that lacks a feature."""
    shared = df.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("struct<in_sample array<double>, held_out array<double>>")
    def predict(x: pd.Series, folds: pd.Series) -> pd.DataFrame:
        values = _stack(x)
        inside = shared.value[-1].predict(values)
        outside = np.empty_like(inside)
        for f in folds.unique():
            rows = (folds == f).to_numpy()
            outside[rows] = shared.value[f].predict(values[rows])
        return pd.DataFrame({"in_sample": list(inside), "held_out": list(outside)})

    both = [F.when(_complete(features), F.col(f"_p.{name}")).alias(name) for name in ("in_sample", "held_out")]
    return df.withColumn("_p", predict(features, fold)).select("*", *both).drop("_p")


# --- Boosted trees -----------------------------------------------------------------------

def gbm_predictions(df: DataFrame, features: str = "features", target: str = "target", fold: str = "fold",
                    slots: list[int] | None = None, iterations: int = 300, depth: int = 3, held_out: bool = True,
                    small: int = boosting.SMALL) -> DataFrame:
    """The same two predictions from gradient-boosted trees, one ensemble per slot and training set, all grown together."""
    slots = list(range(len(PROPERTIES))) if slots is None else slots
    n_features = df.select(F.max(F.size(features))).first()[0] or 0
    edges = boosting.bin_edges(df, features, n_features)
    sizes = [len(e) + 1 for e in edges]
    layout = boosting.Layout(np.cumsum([0, *sizes[:-1]])[: len(sizes)], sum(sizes))
    rows = stored(boosting.binned(df, features, edges).withColumns({"_target": F.col(target), "_fold": F.col(fold).cast("bigint")}))
    folds = [r["_fold"] for r in rows.select("_fold").distinct().orderBy("_fold").collect()] if held_out else []
    keys = [(slot, f) for slot in slots for f in [-1, *folds]]
    models = boosting.fit_ensembles(rows, keys, layout, iterations, depth, small) if n_features else []
    predicted = boosting.ensemble_predictions(rows, keys, models, slots, n_features) if models else rows.withColumns(
        {name: F.array().cast("array<double>") for name in ("in_sample", "held_out")})
    return predicted.select(*df.columns, "in_sample", "held_out", F.array(*[F.col(target)[s] for s in slots]).alias("fitted_target"))


# --- Scores ----------------------------------------------------------------------------

def baseline_scores(predicted: DataFrame, model: str, feature_set: str, target: str = "target", fold: str = "fold") -> DataFrame:
    """Per property: in-sample R2, mean and sample SD of the folds' R2, and the mean predictor's R2, over the rows
    that have a prediction."""
    predicted = stored(predicted.where(F.col("in_sample").isNotNull()).select(target, fold, "in_sample", "held_out"))
    long = long_vector(predicted, [fold], y=target, a="in_sample", b="held_out")
    inside = long.groupBy("slot").agg(r2_across("y", "a").alias("r2_in_sample"))
    folds = long.groupBy("slot", fold).agg(r2_across("y", "b").alias("r2"))
    outside = folds.groupBy("slot").agg(F.avg("r2").alias("r2_cv_mean"), F.stddev_samp("r2").alias("r2_cv_std"))
    trivial = mean_predictor_scores(predicted, target, fold).groupBy("slot").agg(
        F.avg("r2").alias("r2_cv_predict_mean_baseline")
    )
    return inside.join(outside, "slot").join(trivial, "slot").select(
        property_name("slot").alias("property"), F.lit(feature_set).alias("feature_set"), F.lit(model).alias("model"),
        "r2_in_sample", "r2_cv_mean", "r2_cv_std", "r2_cv_predict_mean_baseline",
    )


def evaluate_ridge(df: DataFrame, row_id: str, seq: str, feature_set: str, target: str = "target", k: int = 5,
                   seed: int = SEED) -> DataFrame:
    # Every pass reads the features, which are computed once; no sequence goes through the order of the folds.
    features = with_features(df, row_id, seq, feature_set).select(row_id, target, "features")
    prepared = stored(with_folds(features, row_id, k, seed))
    models = fit_ridge(prepared, feature_count(feature_set), target=target)
    return baseline_scores(ridge_predictions(prepared, models), "ridge", feature_set, target)


def feature_count(feature_set: str) -> int:
    base = len(RESIDUES) + 1
    return base + {"composition": 0, "composition+motifs": len(CANONICAL_MOTIFS), "dipeptide": len(DIPEPTIDES)}[feature_set]


def evaluate_grid(df: DataFrame, row_id: str, seq: str, target: str = "target", k: int = 5, seed: int = SEED,
                  iterations: int = 300) -> DataFrame:
    """Every feature set under both models, one table."""
    frames = []
    folded = stored(with_folds(df, row_id, k, seed))
    for feature_set in FEATURE_SETS:
        prepared = stored(with_features(folded, row_id, seq, feature_set).select(row_id, target, "fold", "features"))
        models = fit_ridge(prepared, feature_count(feature_set), target=target)
        frames.append(baseline_scores(ridge_predictions(prepared, models), "ridge", feature_set, target))
        frames.append(baseline_scores(gbm_predictions(prepared, target=target, iterations=iterations),
                                      "gbm", feature_set, target))
    return reduce(DataFrame.unionByName, frames)


def grid_summary(scores: DataFrame) -> DataFrame:
    """Mean R2 over the mechanical properties and over all eight, per model and feature set."""
    mechanical = F.col("property").isin([PROPERTIES[i] for i in MECHANICAL_SLOTS])
    return scores.groupBy("feature_set", "model").agg(
        F.avg(F.when(mechanical, F.col("r2_in_sample"))).alias("mean_r2_in_sample_mechanical"),
        F.avg(F.when(mechanical, F.col("r2_cv_mean"))).alias("mean_r2_cv_mechanical"),
        F.avg("r2_in_sample").alias("mean_r2_in_sample_all8"),
        F.avg("r2_cv_mean").alias("mean_r2_cv_all8"),
    )


def best_baseline(summary: DataFrame) -> DataFrame:
    """The model and feature set with the best cross-validated mechanical mean."""
    return summary.orderBy(F.desc("mean_r2_cv_mechanical"), "feature_set", "model").limit(1)


def within_vector_scores(predicted: DataFrame, row_id: str, target: str = "target") -> DataFrame:
    """Per row: R2 over the eight slots of the in-sample prediction."""
    return predicted.select(row_id, r2_within(target, "in_sample").alias("r2"))

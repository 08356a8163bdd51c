"""Gradient-boosted regression trees on binned features, many ensembles at a time.

Features are binned once at exact quantiles. All ensembles (one for each target and training set) then grow
together. A pass over the rows gives every ensemble's sums of residuals by node, feature and bin, and a
level of all their trees: depth times iterations passes, however many ensembles there are. Of two children
only the smaller is summed, the other is its parent less that; a few features are summed at once by their joint
bins. Tasks combine their sums in Arrow batches, sums are added in a tree keyed by ensemble, and one sum for each
node, feature and bin reaches the driver. Rows are kept packed; the predictions of all ensembles stand in one row and
are stored every BLOCK iterations, so that a pass replays BLOCK trees at most.

Where the binned rows fit in SMALL bytes they are sent to the tasks instead, each of which grows whole
ensembles: the same trees without a job for every level. There the sums at the root follow from those of the tree
before: a row's residual falls by what its leaf adds, so that rows counted by leaf and bin are all that is needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from seqloom.operators.ranking import percentiles
from seqloom.session import stored

#: Bins of a feature; binned rows that are sent to the tasks at most, in bytes.
BINS, SMALL = 32, 256 << 20
#: Iterations between stored predictions; partial sums that one task adds; bytes of partial sums that the driver adds.
BLOCK, FAN, ADDED = 10, 32, 16 << 20
#: Joint bins of features that are summed at once, for one run of features and for all; rows that a step handles at once.
JOINT, CELLS, RUN = 1024, 1 << 15, 1 << 14
RATE = 0.1
#: The least gain of a split: below it, sums differ by rounding only.
LEAST_GAIN = 1e-10


@dataclass(frozen=True)
class Layout:
    """Where each feature's bins start among all bins."""

    starts: np.ndarray
    total: int
    #: Rows that are summed at once, for one ensemble: the more, the more joint bins pay.
    rows: int = 0

    @cached_property
    def ends(self) -> np.ndarray:
        return np.append(self.starts[1:], self.total)

    @cached_property
    def runs(self) -> list[tuple[int, int]]:
        """First and last (exclusive) of consecutive features that are summed by their joint bins."""
        sizes = (self.ends - self.starts).tolist()
        for limit in (JOINT, JOINT // 4, JOINT // 16, 0):
            out, first, joint, cells = [], 0, 1, 0
            for f, size in enumerate(sizes):
                if f > first and joint * size > limit:
                    out.append((first, f))
                    first, joint, cells = f, 1, cells + joint
                joint *= size
            if cells + joint <= max(CELLS, 2 * self.rows):
                break
        return [*out, (first, len(sizes))]

    @cached_property
    def cells(self) -> list[tuple[int, ...]]:
        """The numbers of bins of each run's features."""
        sizes = (self.ends - self.starts).tolist()
        return [tuple(sizes[first:last]) for first, last in self.runs]

    def by_bin(self, sums: np.ndarray) -> np.ndarray:
        """Sums by bin from those by joint bins, which are the last axis."""
        out, at = [], 0
        for shape in self.cells:
            n = math.prod(shape)
            part = sums[..., at : at + n].reshape(*sums.shape[:-1], *shape)
            axes = range(sums.ndim - 1, part.ndim)
            out += [part.sum(axis=tuple(a for a in axes if a != k)) for k in axes]
            at += n
        return np.concatenate(out, axis=-1)


def bin_edges(df: DataFrame, features: str, n_features: int) -> list[np.ndarray]:
    """Inner edges of each feature's bins: its distinct exact quantiles. Rows at an edge lie below it."""
    long = df.select(F.posexplode(features).alias("feature", "value"))
    found = {r["feature"]: [v for k, v in r.asDict().items() if k != "feature"] for r in percentiles(long, ["feature"], "value", {f"q{i}": i / BINS for i in range(1, BINS)}).collect()}
    return [np.unique(np.array([v for v in found.get(f, []) if v is not None], dtype=float)) for f in range(n_features)]


def binned(df: DataFrame, features: str, edges: list[np.ndarray]) -> DataFrame:
    """`df` with `_bins`: one byte for each feature."""
    shared = df.sparkSession.sparkContext.broadcast(edges)

    @F.pandas_udf("binary")
    def cut(values):
        x = np.array(values.tolist(), dtype=float)
        out = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(shared.value)], axis=1).astype(np.uint8)
        return values.__class__([row.tobytes() for row in out])

    return df.withColumn("_bins", cut(features))


# --- Trees: nodes of a full binary tree by level; a node without a split sends every row left ---

def leaves(feature: np.ndarray, cut: np.ndarray, columns: np.ndarray, levels: int) -> np.ndarray:
    """The node at depth `levels` (counted from 0 in its level) that each row reaches; `columns` (features, rows)."""
    node = np.zeros(columns.shape[1], dtype=np.uint8)
    for level in range(levels):
        right = np.zeros(len(node), dtype=bool)
        for i in range(1 << level):
            f = feature[i + (1 << level) - 1]
            if f >= 0:
                right |= (columns[f] > int(cut[i + (1 << level) - 1])) & (node == i)
        node = 2 * node + right
    return node


def histogram(flat: np.ndarray, node: np.ndarray, nodes: int, residual: np.ndarray, layout: Layout) -> np.ndarray:
    """Sums of residuals and numbers of rows (2, nodes, bins); `flat` holds each row's bins among all bins."""
    index = (node[:, None] * layout.total + flat).ravel()
    size = nodes * layout.total
    sums = np.bincount(index, weights=np.repeat(residual, flat.shape[1]), minlength=size)
    return np.stack([sums, np.bincount(index, minlength=size)]).reshape(2, nodes, layout.total)


def best_splits(sums: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node its feature (-1: none) and bin, and the means of its left and right rows (nodes, 2).

    The split that lowers the squared error most; of equal ones the first feature and the lowest bin.
    """
    (total, count), ends = sums, layout.ends
    upto = np.cumsum(sums, axis=2)
    before = np.where(layout.starts > 0, upto[:, :, np.maximum(layout.starts - 1, 0)], 0.0)
    left = upto - np.repeat(before, ends - layout.starts, axis=2)
    whole = sums[:, :, layout.starts[0] : ends[0]].sum(axis=2)[:, :, None]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - whole[0] ** 2 / whole[1]
    gain = np.where((left[1] > 0) & (right[1] > 0), gain, -np.inf)
    at = np.argmax(np.where(gain >= gain.max(axis=1, keepdims=True) * (1 - 1e-12) - 1e-12, 1, 0), axis=1)
    node = np.arange(len(total))
    splits = gain[node, at] > LEAST_GAIN
    feature = np.where(splits, np.searchsorted(layout.starts, at, side="right") - 1, -1)
    cut = np.where(splits, at - layout.starts[np.maximum(feature, 0)], 0)
    mean = np.divide(whole[0, :, 0], whole[1, :, 0], out=np.zeros(len(node)), where=whole[1, :, 0] > 0)
    sides = []
    for part in (left, right):
        n = part[1, node, at]
        sides.append(np.where(splits, np.divide(part[0, node, at], n, out=np.zeros(len(node)), where=n > 0), mean))
    return feature, cut, np.stack(sides, axis=1)


def joint_bins(columns: np.ndarray, layout: Layout) -> list[np.ndarray]:
    """For each run of features every row's place among their joint bins."""
    sizes, out = layout.ends - layout.starts, []
    for (first, last), shape in zip(layout.runs, layout.cells):
        index = columns[first].astype(np.int64)
        for f in range(first + 1, last):
            index = index * sizes[f] + columns[f]
        out.append(index.astype(np.uint16) if math.prod(shape) <= 1 << 16 else index)
    return out


def _cells(joint: list[np.ndarray], layout: Layout, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums of the weights, or numbers of rows, in all joint bins."""
    return np.concatenate([np.bincount(index, weights, math.prod(shape)) for index, shape in zip(joint, layout.cells)])


def level_sums(joint: list[np.ndarray], columns: np.ndarray, residual: np.ndarray, feature: np.ndarray, cut: np.ndarray,
               level: int, right: np.ndarray, layout: Layout, counts: bool = True, sums: bool = True) -> np.ndarray:
    """Sums of residuals and numbers of rows by joint bins: of all rows at level 0, further down of one child of each node
    of the level above (2, nodes, cells), the right one where `right` says so. A node without a split has no right child. The numbers of all rows, which no tree
    changes, are left at 0 without `counts`, and the sums of residuals without `sums`."""
    above = max(1, (1 << level) >> 1)
    out = np.zeros((2, above, sum(map(math.prod, layout.cells))))
    if level == 0:
        out[0, 0] = _cells(joint, layout, residual)
        if counts:
            out[1, 0] = _cells(joint, layout)
        return out
    node = leaves(feature, cut, columns, level - 1)
    for i in range(above):
        f, c = feature[i + above - 1], cut[i + above - 1]
        if f >= 0:
            own = np.flatnonzero(((columns[f] > int(c)) == right[i]) & (node == i))
            there = [np.take(index, own, mode="clip") for index in joint]
            if sums:
                out[0, i] = _cells(there, layout, residual[own])
            out[1, i] = _cells(there, layout)
    return out


def small_children(sums: np.ndarray, feature: np.ndarray, cut: np.ndarray, layout: Layout) -> np.ndarray:
    """For each node whether its right child is the smaller one, which is the one without rows where there is no split."""
    out = []
    for count, f, c in zip(sums[1], feature, cut):
        at = layout.starts[max(f, 0)]
        left = count[at : at + c + 1].sum()
        out.append(f < 0 or count[layout.starts[0] : layout.ends[0]].sum() - left <= left)
    return np.array(out, dtype=bool)


def both_children(parents: np.ndarray, small: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of all nodes of a level from those of their parents and of the smaller children."""
    other, side = parents - small, right[None, :, None]
    return np.stack([np.where(side, other, small), np.where(side, small, other)], axis=2).reshape(len(parents), -1, parents.shape[2])


@dataclass
class Ensemble:
    """Trees of one target and training set: features and cuts (iterations, nodes), values (iterations, leaves)."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """Sum over the trees from `first` on, with the start where `first` is 0."""
        out = np.full(len(bins), self.start if first == 0 else 0.0)
        for at in range(0, len(bins), RUN):
            out[at : at + RUN] += self.added(np.ascontiguousarray(bins[at : at + RUN].T), first)
        return out

    def added(self, columns: np.ndarray, first: int = 0) -> np.ndarray:
        """Sum over the trees from `first` on, without the start; `columns` (features, rows)."""
        out = np.zeros(columns.shape[1])
        levels = int(self.value.shape[1]).bit_length() - 1
        for feature, cut, value in zip(self.feature[first:], self.cut[first:], self.value[first:]):
            out += (RATE * value)[leaves(feature, cut, columns, levels)]
        return out


def grow(columns: np.ndarray, target: np.ndarray, layout: Layout, iterations: int, depth: int) -> Ensemble:
    """An ensemble from rows that are all here; `columns` (features, rows)."""
    start = float(target.mean()) if len(target) else 0.0
    now, nodes = np.full(len(target), start), 2**depth
    joint = joint_bins(columns, layout)
    features, cuts, values, root = [], [], [], None

    def found(level, sums=True):
        return layout.by_bin(level_sums(joint, columns, target - now, feature, cut, level, right, layout, sums=sums)[0 if sums else 1 :])

    for iteration in range(iterations):
        feature, cut = np.full(nodes - 1, -1), np.zeros(nodes - 1, dtype=np.int64)
        value, sums, right = np.zeros((1, 2)), None, np.zeros(0, dtype=bool)
        for level in range(depth):
            if level:
                sums = both_children(sums, found(level), right)
            else:
                root = sums = found(level) if root is None else root
            f, c, value = best_splits(sums, layout)
            right = small_children(sums, f, c, layout)
            feature[(1 << level) - 1 : (2 << level) - 1], cut[(1 << level) - 1 : (2 << level) - 1] = f, c
        if iteration + 1 < iterations:
            fallen = RATE * value.ravel() @ both_children(sums[1:], found(depth, sums=False), right)[0]
            root = np.stack([root[0] - fallen, root[1]])
        now += RATE * value.ravel()[leaves(feature, cut, columns, depth)]
        features.append(feature)
        cuts.append(cut)
        values.append(value.ravel())
    return Ensemble(start, np.array(features, dtype=np.int64).reshape(-1, nodes - 1), np.array(cuts, dtype=np.int64).reshape(-1, nodes - 1), np.array(values).reshape(-1, nodes))


def _columns(batch: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column("_bins").to_pylist()), dtype=np.uint8).reshape(-1, n_features)
    target = np.array(batch.column("_target").to_pylist(), dtype=float).reshape(len(bins), -1)
    return bins, target, batch.column("_fold").to_numpy(zero_copy_only=False).astype(np.int64)


def _trained(keys: list[tuple[int, int]], e: int, target: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Rows that ensemble `e` learns from: those outside its fold whose target is a number."""
    slot, held_out = keys[e]
    return np.flatnonzero((fold != held_out) & np.isfinite(target[:, slot]))


def fit_ensembles(rows: DataFrame, keys: list[tuple[int, int]], layout: Layout, iterations: int, depth: int, small: int = SMALL) -> list[Ensemble]:
    """An ensemble for each key (slot of the target, fold that is held out or -1). `rows` has `_bins`, `_target`
    (array) and `_fold`; nulls among targets take no part."""
    n_features = len(layout.starts)
    size = rows.select(F.sum(F.length("_bins") + 8 * F.size("_target") + 8)).first()[0] or 0
    return (_fit_sent if size <= small else _fit_in_passes)(rows, keys, layout, iterations, depth, n_features)


def _fit_sent(rows, keys, layout, iterations, depth, n_features) -> list[Ensemble]:
    spark = rows.sparkSession
    # Bounded by `small`; in an order that does not depend on partitions.
    table = rows.select("_bins", "_target", "_fold").toArrow()
    parts = [(np.ascontiguousarray(b.T), t, f) for b, t, f in (_columns(batch, n_features) for batch in table.to_batches())]
    del table
    columns = np.concatenate([p[0] for p in parts] or [np.zeros((n_features, 0), np.uint8)], axis=1)
    target, fold = (np.concatenate([p[i] for p in parts] or [empty]) for i, empty in ((1, np.zeros((0, 1))), (2, np.zeros(0))))
    del parts
    shared = spark.sparkContext.broadcast((columns, target, fold))
    layout = Layout(layout.starts, layout.total, columns.shape[1])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            columns, target, fold = shared.value
            for e in batch.column("id").to_pylist():
                own = _trained(keys, e, target, fold)
                made = grow(np.take(columns, own, axis=1), target[own, keys[e][0]], layout, iterations, depth)
                yield pa.RecordBatch.from_pydict({
                    "e": [e], "start": [made.start], "feature": [made.feature.ravel()], "cut": [made.cut.ravel()], "value": [made.value.ravel()],
                })

    schema = "e bigint, start double, feature array<bigint>, cut array<bigint>, value array<double>"
    found = {r["e"]: r for r in spark.range(0, len(keys), 1, len(keys)).mapInArrow(run, schema).collect()}
    shared.unpersist()
    nodes = 2**depth
    return [Ensemble(found[e]["start"], np.array(found[e]["feature"]).reshape(-1, nodes - 1), np.array(found[e]["cut"]).reshape(-1, nodes - 1), np.array(found[e]["value"]).reshape(-1, nodes)) for e in range(len(keys))]


def _fit_in_passes(rows, keys, layout, iterations, depth, n_features) -> list[Ensemble]:
    spark = rows.sparkSession
    nodes, count = 2**depth, len(keys)
    # Starts: means of each ensemble's rows, from sums by fold.
    means = rows.select("_fold", F.posexplode("_target").alias("slot", "y")).where("y IS NOT NULL AND NOT isnan(y)").groupBy("_fold", "slot").agg(F.sum("y").alias("s"), F.count("*").alias("n")).collect()
    def start(slot, out):
        s, n = (sum(r[k] for r in means if r["slot"] == slot and r["_fold"] != out) for k in ("s", "n"))
        return s / n if n else 0.0

    models = [Ensemble(start(*key), np.zeros((0, nodes - 1), np.int64), np.zeros((0, nodes - 1), np.int64), np.zeros((0, nodes))) for key in keys]
    state = stored(_packed(rows, models, n_features))
    first, parts = 0, (state.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    whole = [None] * count
    for iteration in range(iterations):
        if iteration - first == BLOCK:
            state, first = stored(_advanced(state, models, first)), iteration
        feature, cut = np.full((count, nodes - 1), -1), np.zeros((count, nodes - 1), dtype=np.int64)
        value, sums, right = np.zeros((count, nodes)), [None] * count, [np.zeros(0, dtype=bool)] * count
        for level in range(depth):
            here = slice((1 << level) - 1, (2 << level) - 1)
            for e, found in _level(state, models, first, feature, cut, right, level, keys, layout, parts, not iteration):
                sums[e] = both_children(sums[e], found, right[e]) if level else found.copy()
                if not iteration and not level:
                    whole[e] = found[1]
                elif not level:
                    sums[e][1] = whole[e]
            for e in range(count):
                feature[e, here], cut[e, here], last = best_splits(sums[e], layout)
                right[e] = small_children(sums[e], feature[e, here], cut[e, here], layout)
                if level == depth - 1:
                    value[e] = last.ravel()
        for e, m in enumerate(models):
            models[e] = Ensemble(m.start, np.vstack([m.feature, feature[e]]), np.vstack([m.cut, cut[e]]), np.vstack([m.value, value[e]]))
    return models


def _packed(rows: DataFrame, models: list[Ensemble], n_features: int) -> DataFrame:
    """A row for each Arrow batch of rows, as bytes: bins (features, rows), targets (slots, rows; NaN: none), folds, and in
    `_now` the predictions of all ensembles (ensembles, rows)."""
    starts = np.array([m.start for m in models])

    def run(batches):
        for batch in batches:
            bins, target, fold = _columns(batch, n_features)
            now = np.repeat(starts, len(fold))
            yield pa.RecordBatch.from_pydict({"_bins": [bins.T.tobytes()], "_target": [target.T.tobytes()], "_fold": [fold.tobytes()], "_now": [now.tobytes()]})

    return rows.select("_bins", "_target", "_fold").mapInArrow(run, "_bins binary, _target binary, _fold binary, _now binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    for row in zip(*(column.to_pylist() for column in batch.columns)):
        bins, target, fold, now = (np.frombuffer(cell, dtype=kind) for cell, kind in zip(row, (np.uint8, float, np.int64, float)))
        yield [bins.reshape(-1, len(fold)), target.reshape(-1, len(fold)), fold, now.reshape(-1, len(fold))]


def _since(models: list[Ensemble], first: int) -> list[Ensemble]:
    return [Ensemble(m.start, m.feature[first:], m.cut[first:], m.value[first:]) for m in models]


def _advanced(state: DataFrame, models: list[Ensemble], first: int) -> DataFrame:
    recent = _since(models, first)

    def run(batches):
        for batch in batches:
            moved = [(now + np.stack([m.added(columns) for m in recent])).tobytes() for columns, _, _, now in _unpacked(batch)]
            yield batch.set_column(3, "_now", pa.array(moved, pa.binary()))

    return state.mapInArrow(run, state.schema)


def _level(state, models, first, feature, cut, right, level, keys, layout, parts, counts):
    """(ensemble, sums of `level_sums`) from one pass over all rows."""
    recent, above = _since(models, first), max(1, (1 << level) >> 1)
    shape, cells = (2, above, layout.total), sum(map(math.prod, layout.cells))
    # Ensembles that learn from the same rows stand together.
    order = sorted(range(len(keys)), key=lambda e: keys[e][1])

    def run(batches):
        sums = [np.zeros((2, above, cells)) for _ in keys]
        for columns, target, fold, now in (block for batch in batches for block in _unpacked(batch)):
            joint, finite, taken = joint_bins(columns, layout), np.isfinite(target), None
            for e in order:
                slot, held_out = keys[e]
                # The rows outside a fold serve all targets that have no gaps.
                rows = (held_out, None if finite[slot].all() else slot)
                if rows != taken:
                    own = np.flatnonzero((fold != held_out) & finite[slot])
                    taken, mine, there = rows, columns[:, own], [index[own] for index in joint]
                residual = (target[slot] - now[e])[own] - recent[e].added(mine)
                sums[e] += level_sums(there, mine, residual, feature[e], cut[e], level, right[e], layout, counts or level > 0)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"e": list(range(len(keys))), "part": [part] * len(keys), "sums": [layout.by_bin(s).tobytes() for s in sums]})

    def add(group: pa.Table) -> pa.Table:
        added = sum(np.frombuffer(v.as_py(), dtype=float) for v in group.column("sums"))
        return pa.table({"e": group.column("e")[:1], "part": group.column("part")[:1], "sums": pa.array([added.tobytes()], pa.binary())})

    partial = state.mapInArrow(run, "e bigint, part bigint, sums binary")
    while parts > 1 and parts * len(keys) * int(np.prod(shape)) * 8 > ADDED:
        parts = -(-parts // FAN)
        partial = partial.withColumn("part", F.floor(F.col("part") / FAN).cast("bigint")).groupBy("e", "part").applyInArrow(add, partial.schema)
    found = {}
    for r in sorted(partial.collect(), key=lambda r: (r["e"], r["part"])):
        found[r["e"]] = found.get(r["e"], 0.0) + np.frombuffer(r["sums"], dtype=float).reshape(shape)
    return list(found.items())


def ensemble_predictions(rows: DataFrame, keys: list[tuple[int, int]], models: list[Ensemble], slots: list[int], n_features: int) -> DataFrame:
    """`rows` with `in_sample` and `held_out`: for each slot the prediction of the ensemble that saw all rows, and
    of the one that did not see the row's fold (null where there is none)."""
    shared = rows.sparkSession.sparkContext.broadcast({key: model for key, model in zip(keys, models)})

    @F.pandas_udf("struct<in_sample array<double>, held_out array<double>>")
    def predict(packed, fold):
        import pandas as pd

        bins = np.frombuffer(b"".join(packed.tolist()), dtype=np.uint8).reshape(-1, n_features)
        inside = np.stack([shared.value[slot, -1].predict(bins) for slot in slots], axis=1)
        outside = [[None] * len(slots) for _ in range(len(bins))]
        for f in fold.unique():
            own = np.flatnonzero((fold == f).to_numpy())
            for k, slot in enumerate(slots):
                if (slot, f) in shared.value:
                    for i, v in zip(own, shared.value[slot, f].predict(bins[own]).tolist()):
                        outside[i][k] = v
        return pd.DataFrame({"in_sample": inside.tolist(), "held_out": outside})

    return rows.withColumn("_p", predict("_bins", "_fold")).select("*", "_p.in_sample", "_p.held_out").drop("_p")

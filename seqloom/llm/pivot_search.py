"""Exact top-k search by inner product over a pivot-distance index.

Vectors are lifted by one coordinate so that the largest inner product is the smallest distance: a
candidate x gets sqrt(M - |x|^2) with M the largest squared norm, a query gets 0. Each candidate is keyed
by its nearest pivot and its distance to it; the vectors of a pivot, sorted by distance, fall into annuli
of bounded size. A query starts with the annuli nearest to its own distance from its nearest pivots,
which gives it a k-th best score. By the triangle inequality an annulus [lo, hi] of pivot p holds nothing
nearer than max(lo - d, d - hi), d the query's distance from p; only annuli that this does not rule out
are searched then, and among their vectors only those whose own distance passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seqloom.llm.common import stored, table

#: Vectors that pivots are drawn from (by a hash of the id), and how many pivots.
SAMPLE, PIVOTS = 4096, 48
#: Vectors of an annulus and queries of a block at most.
ANNULUS, BLOCK = 4096, 1024
#: Annuli that a query starts with.
FIRST = 2
TOP = 5
SCALE, QUERY_STEP = 256, 50
#: Distances are floating-point: bounds give way by this share.
SLACK = 1e-9
#: Sums of whole numbers are exact in floating point below this; no score is larger than the largest squared norm.
EXACT = float(1 << 53)
#: Scores are long; the norm is summed in floating point, so a little below 2^63.
LARGEST = float(1 << 63) * (1 - 1e-9)


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, as doubles. Vectors that are null or hold null
    or non-finite components are left out, and those of no component."""
    x = F.col("embedding")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    good = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, finite))
    return good.select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double")).alias("v"))


def farthest_first(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other."""
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squared, 0))


def indexed(vectors: DataFrame, pivots: np.ndarray, most: float) -> DataFrame:
    """Candidates with pivot, distance and annulus; annuli number a pivot's vectors in order of distance.

    Ranks come from counts of narrow distance bands, so no task orders all vectors of a pivot.
    """

    def run(batches):
        for batch in batches:
            v = matrix(batch.column("v"))
            lifted = np.concatenate([v, np.sqrt(np.maximum(most - (v**2).sum(axis=1), 0))[:, None]], axis=1)
            d = distances(lifted, pivots)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["vec_id", "v", "pivot", "distance"])

    keyed = stored(vectors.mapInArrow(run, "vec_id bigint, v array<double>, pivot int, distance double"))
    # Bands hold about a quarter of an annulus on average; annuli are runs of bands, and a band that is
    # larger than an annulus (vectors at one distance) is divided by a hash of the id.
    span = keyed.groupBy("pivot").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count("*").alias("held"))
    banded = keyed.join(F.broadcast(span), "pivot")
    band = F.floor((F.col("distance") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * F.ceil(4 * F.col("held") / ANNULUS))
    banded = banded.select("vec_id", "v", "pivot", "distance", band.alias("band"))
    counts = banded.groupBy("pivot", "band").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pivot").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counts.select("pivot", "band", F.floor(before / ANNULUS).alias("run"), F.ceil(F.col("n") / ANNULUS).alias("parts"))
    split = banded.join(runs, ["pivot", "band"]).withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("vec_id"), "parts")).otherwise(F.lit(0)))
    return split.select("vec_id", "v", "distance", F.struct("pivot", "run", "part").alias("annulus"))


def queried(vectors: DataFrame, pivots: np.ndarray, step: int) -> DataFrame:
    """Queries with their distance from every pivot."""

    def run(batches):
        for batch in batches:
            v = matrix(batch.column("v"))
            d = distances(np.concatenate([v, np.zeros((len(v), 1))], axis=1), pivots)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(list(d), pa.list_(pa.float64()))], ["query_id", "q", "ds"])

    return vectors.where(F.col("vec_id") % step == 0).mapInArrow(run, "query_id bigint, q array<double>, ds array<double>")


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise the `top` largest scores, ties to the smaller id. `ids` rise along each row's axis."""
    order = np.argsort(-scores, axis=1, kind="stable")[:, :top]
    return np.take_along_axis(scores, order, axis=1), ids[order]


def searched(routes: DataFrame, index: DataFrame, top: int) -> DataFrame:
    """Top candidates of each route: (query, annulus) pairs meet in groups of one annulus and one block of queries."""
    blocks = routes.groupBy("annulus").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    routed = routes.join(blocks, "annulus").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).drop("blocks")
    wanted = blocks.select(F.col("annulus").alias("place"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("part"))
    held = index.select("vec_id", "v", "distance", F.col("annulus").alias("place")).join(wanted, "place")

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, vectors = left, right.sort_by("vec_id")
        if not (len(queries) and len(vectors)):
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        x, ids, away = matrix(vectors["v"]), vectors["vec_id"].to_numpy(), vectors["distance"].to_numpy()
        q, of = matrix(queries["q"]), queries["query_id"].to_numpy()
        whole = queries["whole"][0].as_py()
        scores = q.astype(np.int64) @ x.T.astype(np.int64) if whole else q @ x.T
        # Not the query's own row, and nothing the triangle inequality rules out.
        gap = np.abs(queries["d"].to_numpy()[:, None] - away[None, :])
        out = (of[:, None] == ids[None, :]) | (gap > queries["reach"].to_numpy()[:, None])
        nothing = -np.iinfo(np.int64).max if whole else -np.inf
        scores[out] = nothing
        got, near = best(scores, ids, top)
        real = got > nothing
        return pa.table({"query_id": pa.array(np.repeat(of, real.sum(axis=1))), "vec_id": pa.array(near[real]), "score": pa.array(got[real].astype(np.int64))})

    groups = routed.groupBy("annulus", "block").cogroup(held.groupBy("place", "part"))
    return groups.applyInArrow(lambda left, right: pair(left, right), "query_id bigint, vec_id bigint, score bigint")


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(vectors: DataFrame, top: int = TOP, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: for every query (vec_id divisible by `step`) its `top` best other rows.

    The commonest length of the vectors is the table's (of equally common ones the larger); others have no inner
    product with its vectors and are left out. Repeated rows of one id count once. Scores are exact: they
    are taken in whole numbers where the largest squared norm, which bounds them, passes 2^53. From 2^63 on no long
    holds them, and the search raises an error. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    good = stored(usable(vectors))
    lengths = good.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("held"))
    length = lengths.agg(F.max(F.struct("held", "length"))["length"].alias("length"))
    # One row.
    every = stored(good.join(F.broadcast(length), F.size("v") == F.col("length")).drop("length").dropDuplicates(["vec_id"]))
    most = every.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))).first()[0]
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if most is None:
        return spark.createDataFrame([], schema)
    if most >= LARGEST:
        raise ValueError("scores of vectors this long may not fit a 64-bit integer")
    whole = bool(most >= EXACT)
    sample = np.array([r["v"] for r in every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()])
    pivots = farthest_first(np.concatenate([sample, np.sqrt(np.maximum(most - (sample**2).sum(axis=1), 0))[:, None]], axis=1), PIVOTS)
    index = stored(indexed(every, pivots, most))
    annuli = stored(index.groupBy("annulus").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi")))
    queries = stored(queried(every, pivots, step))
    from_pivot = queries.select("query_id", F.posexplode("ds").alias("pivot", "d"))
    gap = F.greatest(F.col("lo") - F.col("d"), F.col("d") - F.col("hi"), F.lit(0.0))
    met = from_pivot.join(annuli.withColumn("pivot", F.col("annulus.pivot")), "pivot").withColumn("gap", gap)
    near = met.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("gap", "d", "annulus"))).where(F.col("at") <= FIRST)
    start = near.select("query_id", "annulus", "d", F.lit(float("inf")).alias("reach"), F.lit(whole).alias("whole")).join(queries.select("query_id", "q"), "query_id")
    first = stored(ranked(searched(start, index, top), top))
    # |q - x|^2 = |q|^2 + M - 2 q.x in the lifted space: the k-th score bounds the distance of what can still come in.
    norm = F.aggregate("q", F.lit(0.0), lambda s, e: s + e * e)
    kth = first.where(F.col("rank") == top).select("query_id", F.col("score").alias("kth"))
    reach = F.when(F.col("kth").isNull(), float("inf")).otherwise(F.sqrt(F.greatest(norm + most - 2 * F.col("kth"), F.lit(0.0))) * (1 + SLACK) + SLACK * (1 + most**0.5))
    bounded = queries.join(kth, "query_id", "left").select("query_id", "q", reach.alias("reach"))
    left = met.join(near.select("query_id", "annulus"), ["query_id", "annulus"], "left_anti").join(bounded, "query_id")
    rest = left.where(F.col("gap") <= F.col("reach")).select("query_id", "annulus", "d", "reach", F.lit(whole).alias("whole"), "q")
    both = first.select("query_id", "vec_id", "score").unionByName(searched(rest, index, top))
    return ranked(both, top).select("query_id", "rank", "vec_id", "score")


def op8_pivot_search(spark, folder):
    return search(table(spark, folder, "embeddings"))


OP8_SQL = """
WITH v AS (
  SELECT DISTINCT ON (vec_id) vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

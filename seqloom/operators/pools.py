"""Candidate pools: one row per parsed candidate with its novelty flag and score, keyed by `set`."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqloom.fixed import CANDIDATE_GRID, SEED, TARGETS
from seqloom.functions.hashing import digest, draw_unit
from seqloom.functions.vectors import is_finite, spread
from seqloom.operators.ranking import cumulative_counts, percentiles

RANK_BLOCK = 1024


def targets_table(spark: SparkSession) -> DataFrame:
    """(set, target, published_r2): eight rows."""
    rows = [(name, target, r2) for name, (target, r2) in TARGETS.items()]
    return spark.createDataFrame(rows, "set string, target array<double>, published_r2 double")


def scoreable(pool: DataFrame) -> DataFrame:
    return pool.where(F.col("forward_parsed") & F.col("novel_exact") & is_finite("r2"))


def samples_to_reach(hits, size) -> Column:
    """Median number of draws until one hits: NULL without hits, 1 when all hit."""
    hits, size = (F.col(c) if isinstance(c, str) else c for c in (hits, size))
    miss = F.when((hits > 0) & (hits < size), 1.0 - hits / size)
    return F.when(hits == 0, F.lit(None).cast("double")).when(hits >= size, 1.0).otherwise(
        F.ceil(F.lit(log(0.5)) / F.log(miss)).cast("double")
    )


def pool_summary(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts, score distribution, published comparison and best row of every set."""
    counts = pool.groupBy("set").agg(
        F.count("*").alias("n_parsed_rows"),
        F.count_if("novel_exact").alias("n_novel"),
        F.count_if("forward_parsed").alias("n_forward_parsed"),
    )
    scored = scoreable(pool).join(F.broadcast(targets), "set")
    # A plain max_by keeps an arbitrary one of tied rows; the earliest candidate wins here.
    best = F.max_by(F.struct("mae", digest("sequence").alias("digest"), "length", "candidate_index"),
                    F.struct(F.col("r2"), -F.col("candidate_index")))
    scores = scored.groupBy("set").agg(
        F.count("*").alias("n_scored"),
        F.max("r2").alias("r2_max"),
        F.avg("r2").alias("r2_mean"),
        F.coalesce(F.stddev_samp("r2"), F.lit(0.0)).alias("r2_std"),
        F.min("r2").alias("r2_min"),
        F.avg((F.col("r2") >= F.col("published_r2")).cast("double")).alias("frac_above_published"),
        F.count_if(F.col("r2") >= F.col("published_r2")).alias("hits"),
        best.alias("best"),
    )
    quantiles = percentiles(scored, ["set"], "r2", {"r2_p05": 0.05, "r2_median": 0.5, "r2_p95": 0.95})
    return (
        counts.join(scores, "set", "left")
        .join(quantiles, "set", "left")
        .join(F.broadcast(targets), "set")
        .select(
            "set", "published_r2", spread("target").alias("target_spread"),
            "n_parsed_rows", "n_novel", "n_forward_parsed", F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
            "r2_max", "r2_mean", "r2_median", "r2_std", "r2_p05", "r2_p95", "r2_min", "frac_above_published",
            samples_to_reach("hits", "n_scored").alias("n_required"),
            (F.col("r2_max") - F.col("r2_mean")).alias("selection_gain"),
            F.col("best.mae").alias("mae_at_best"), F.col("best.length").alias("best_length"),
            F.col("best.candidate_index").alias("best_index"), F.col("best.digest").alias("best_digest"),
        )
    )


def best_rows(pool: DataFrame) -> DataFrame:
    """The best scoreable candidate of every set, earliest on ties."""
    scored = scoreable(pool)
    others = [c for c in scored.columns if c != "set"]
    best = F.max_by(F.struct(*others), F.struct(F.col("r2"), -F.col("candidate_index")))
    return scored.groupBy("set").agg(best.alias("_best")).select("set", "_best.*")


def reliable(n, size) -> Column:
    """A grid entry the pool can support: at most a tenth of it, and always 1."""
    n, size = (F.col(c) if isinstance(c, str) else c for c in (n, size))
    return n <= F.greatest(F.lit(1), F.floor(size / 10))


def _with_grid(counts: DataFrame, grid: list[int], capped: bool) -> DataFrame:
    gridded = counts.withColumn("n_draws", F.explode(F.array(*[F.lit(n) for n in grid])))
    return gridded.where(reliable("n_draws", "total") if capped else F.col("n_draws") <= F.col("total"))


def best_of_n(
    pool: DataFrame, groups: list[str] = ["set"], score: str = "r2", grid: list[int] = CANDIDATE_GRID,
    capped: bool = True, min_pool: int = 1,
) -> DataFrame:
    """Distribution of the best of n draws with replacement, in closed form.

    With F the pool's distribution, the maximum of n draws is at most x with probability F(x)^n;
    no replicate is simulated, so the result carries no sampling error.
    """
    counts = cumulative_counts(pool, groups, score).where(F.col("total") >= min_pool)
    counts = _with_grid(counts, grid, capped)
    x, n = F.col(score), F.col("n_draws")
    at = F.pow(F.col("upto") / F.col("total"), n)
    below = F.pow((F.col("upto") - F.col("n")) / F.col("total"), n)
    weight = at - below
    mean = F.sum(x * weight)
    return counts.groupBy(*groups, "n_draws").agg(
        F.max("total").alias("n_pool"),
        mean.alias("mean"),
        F.sqrt(F.greatest(F.sum(x * x * weight) - mean * mean, F.lit(0.0))).alias("std"),
        F.min(F.when(at >= 0.05, x)).alias("p05"),
        F.min(F.when(at >= 0.5, x)).alias("p50"),
        F.min(F.when(at >= 0.95, x)).alias("p95"),
        F.max(n > F.col("total") / 10).alias("extrapolated"),
    )


def best_of_n_bootstrap(
    pool: DataFrame, groups: list[str] = ["set"], score: str = "r2", grid: list[int] = CANDIDATE_GRID,
    replicates: int = 2000, seed: int = SEED, capped: bool = True, min_pool: int = 1,
) -> DataFrame:
    """The same curve by simulation. The best of n draws sits at rank ceil(m * U^(1/n)) of the sorted
    pool, so a replicate costs one draw whatever n is; ranks meet the pool on blocks of ranks."""
    counts = cumulative_counts(pool, groups, score).where(F.col("total") >= min_pool)
    sizes = _with_grid(counts.groupBy(*groups).agg(F.max("total").alias("total")), grid, capped)
    draws = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = draw_unit(F.lit(seed), *[F.col(g) for g in groups], F.col("n_draws"), F.col("replicate"))
    rank = F.ceil(F.col("total") * F.pow(u, 1.0 / F.col("n_draws")))
    draws = draws.withColumn("_rank", F.greatest(rank, F.lit(1))).withColumn(
        "_block", F.floor(F.col("_rank") / RANK_BLOCK)
    )
    first = F.col("upto") - F.col("n") + 1
    blocks = F.sequence(F.floor(first / RANK_BLOCK), F.floor(F.col("upto") / RANK_BLOCK))
    ranges = counts.select(*groups, score, first.alias("_first"), "upto", F.explode(blocks).alias("_block"))
    hit = draws.join(ranges, [*groups, "_block"]).where(F.col("_rank").between(F.col("_first"), F.col("upto")))
    moments = hit.groupBy(*groups, "n_draws").agg(
        F.count("*").alias("n_replicates"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"),
        F.max(F.col("n_draws") > F.col("total") / 10).alias("extrapolated"),
    )
    quantiles = percentiles(hit, [*groups, "n_draws"], score, {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return moments.join(quantiles, [*groups, "n_draws"])


def selection_summary(pool: DataFrame, targets: DataFrame, min_pool: int = 4) -> DataFrame:
    """What one draw gives against the pool maximum, for sets with enough scored candidates."""
    scored = scoreable(pool).join(F.broadcast(targets), "set")
    hit = F.col("r2") >= F.col("published_r2")
    summary = scored.groupBy("set").agg(
        F.count("*").alias("n_pool"), F.first("published_r2").alias("published_r2"), F.avg("r2").alias("mean_r2"),
        F.max("r2").alias("max_r2"), F.avg(hit.cast("double")).alias("frac_at_or_above"), F.count_if(hit).alias("_hits"),
    ).where(F.col("n_pool") >= min_pool)
    medians = percentiles(scored, ["set"], "r2", {"median_r2": 0.5})
    return summary.join(medians, "set").select(
        "set", "n_pool", "published_r2", "mean_r2", "median_r2", "max_r2", "frac_at_or_above",
        samples_to_reach("_hits", "n_pool").alias("n_to_reach"), (F.col("max_r2") - F.col("mean_r2")).alias("selection_gain"),
    )


def novelty_audit(pool: DataFrame) -> DataFrame:
    """Per set: copy counts and rate, how concentrated the copies are, distinct novel sequences."""
    by_sequence = pool.groupBy("set", "novel_exact", digest("sequence").alias("_digest")).agg(F.count("*").alias("n"))
    copy = ~F.col("novel_exact")
    copies = F.sum(F.when(copy, F.col("n")).otherwise(0))
    return by_sequence.groupBy("set").agg(
        F.sum("n").alias("n_parsed"),
        copies.alias("n_verbatim_copies"),
        (copies / F.sum("n")).alias("copy_rate"),
        (F.sum("n") - copies).alias("n_novel"),
        F.count_if(copy).alias("n_distinct_copied_sequences"),
        F.coalesce(F.max(F.when(copy, F.col("n"))) / F.nullif(copies, F.lit(0)), F.lit(0.0)).alias(
            "most_repeated_copy_share"
        ),
        F.count_if(~copy).alias("n_distinct_novel"),
    )


def overall_copy_rate(audit: DataFrame) -> DataFrame:
    """Ratio of sums, not the mean of the sets' rates."""
    return audit.agg(
        F.sum("n_verbatim_copies").alias("n_copies"), F.sum("n_parsed").alias("n_parsed"),
        (F.sum("n_verbatim_copies") / F.sum("n_parsed")).alias("copy_rate"),
    )


def similarity_summary(scores: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """Mean, median and max of each column per group, three decimals."""
    out = scores.groupBy(*groups).agg(
        *[f(c).alias(f"{c}_{name}") for c in columns for name, f in (("mean", F.avg), ("max", F.max))]
    )
    for c in columns:
        out = out.join(percentiles(scores, groups, c, {f"{c}_median": 0.5}), groups)
    measured = [f"{c}_{name}" for c in columns for name in ("mean", "median", "max")]
    return out.select(*groups, *[F.round(m, 3).alias(m) for m in measured])


def parse_accounting(answers: DataFrame, groups: list[str], status: str = "status") -> DataFrame:
    """Attempts, parsed, both kinds of rejection and the parse rate (NULL without attempts)."""
    s = F.col(status)
    return answers.groupBy(*groups).agg(
        F.count("*").alias("attempted"),
        F.count_if(s == "parsed").alias("parsed"),
        F.count_if(s == "unparseable").alias("rejected_unparseable"),
        F.count_if(s == "invalid_aa").alias("rejected_invalid_aa"),
        (F.count_if(s == "parsed") / F.nullif(F.count("*"), F.lit(0))).alias("parse_rate"),
    )


def scorer_comparison(pool: DataFrame, targets: DataFrame, first: str = "r2", second: str = "r2_second") -> DataFrame:
    """Per set: the two scorers' maxima and means, inflation of the maximum, identical share, gaps."""
    both = pool.where(is_finite(first) & is_finite(second)).join(F.broadcast(targets), "set")
    a, b = F.col(first), F.col(second)
    published = F.first("published_r2")
    return both.groupBy("set").agg(
        F.count("*").alias("n"),
        F.max(a).alias("max_first"), F.max(b).alias("max_second"),
        (F.max(b) - F.max(a)).alias("max_inflation"),
        F.avg(a).alias("mean_first"), F.avg(b).alias("mean_second"),
        F.avg((F.abs(a - b) < 1e-9).cast("double")).alias("frac_scores_identical"),
        (published - F.max(a)).alias("gap_first"), (published - F.max(b)).alias("gap_second"),
    )


def score_histogram(pool: DataFrame, groups: list[str], score: str = "r2", bins: int = 40, low_q: float = 0.02,
                    high: float = 1.0) -> DataFrame:
    """Plot-ready counts after clipping to [p2, 1]; the last bin is closed."""
    lows = percentiles(pool, groups, score, {"_low": low_q})
    clipped = pool.join(lows, groups).select(
        *groups, "_low", F.least(F.greatest(F.col(score), F.col("_low")), F.lit(high)).alias("_x")
    )
    width = (F.lit(high) - F.col("_low")) / bins
    bin_index = F.least(F.floor((F.col("_x") - F.col("_low")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    return (
        clipped.withColumn("bin", F.coalesce(bin_index, F.lit(0)).cast("int"))
        .groupBy(*groups, "bin")
        .agg(F.count("*").alias("n"), F.min(F.col("_low") + F.col("bin") * width).alias("left_edge"))
    )

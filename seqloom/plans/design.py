"""The design loop: attempts -> parsed candidates -> novelty -> prediction -> score, all targets at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from seqloom.fixed import DECODING_BUDGETS
from seqloom.functions.prompts import letters_before_answer, parse_vector
from seqloom.functions.vectors import mae, max_abs_error, r2_within, rmse
from seqloom.operators.agreement import literal_motifs, with_motif_counts
from seqloom.functions.descriptors import with_descriptors
from seqloom.operators.pools import best_rows
from seqloom.operators.ranking import percentiles
from seqloom.operators.similarity import flag_novel, nearest_neighbours
from seqloom.plans.inference import design_rows
from seqloom.session import stored

Predict = Callable[[DataFrame, str], DataFrame]


def score_candidates(candidates: DataFrame, targets: DataFrame, predict: Predict) -> DataFrame:
    """Append prediction, forward_parsed, r2, mae, rmse. The targets are eight fixed rows."""
    predicted = predict(candidates, "sequence").join(F.broadcast(targets), "set")
    return predicted.withColumns({
        "forward_parsed": F.col("prediction").isNotNull(),
        "r2": r2_within("target", "prediction"),
        "mae": mae("target", "prediction"),
        "rmse": rmse("target", "prediction"),
    })


def build_pool(attempts: DataFrame, targets: DataFrame, known: DataFrame, predict: Predict) -> DataFrame:
    """Pool rows of all parsed attempts (set, attempt, text)."""
    parsed = design_rows(attempts).where(F.col("status") == "parsed").drop("text", "status")
    flagged = flag_novel(parsed.withColumnRenamed("attempt", "candidate_index"), known)
    scored = score_candidates(flagged.withColumn("length", F.length("sequence")), targets, predict)
    return scored.drop("target", "published_r2")


def best_with_neighbours(pool: DataFrame, known: DataFrame, n: int = 2, known_id: str = "known_id") -> DataFrame:
    """The best candidate of every set and its nearest known sequences: (set, name, role, sequence, containment)."""
    # One row per set: written out once, so that the pool is not scored again for every use.
    best = stored(best_rows(pool).select("set", "sequence"))
    neighbours = nearest_neighbours(best, known, "set", known_id=known_id, n=n)
    named = neighbours.join(known.select(F.col(known_id).alias("ref_id"), "sequence"), "ref_id").select(
        "set",
        F.concat("set", F.lit("_nb"), "neighbour").alias("name"),
        F.concat(F.lit("neighbour"), "neighbour").alias("role"),
        "sequence", "containment",
    )
    generated = best.select(
        "set", F.concat("set", F.lit("_gen")).alias("name"), F.lit("generated").alias("role"), "sequence"
    )
    return stored(generated.unionByName(named, allowMissingColumns=True))


def described_specimens(specimens: DataFrame) -> DataFrame:
    """Descriptors of the specimens; those with non-standard letters drop out."""
    return with_descriptors(specimens, "sequence").where(F.col("status") == "ok")


def motif_specimens(specimens: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Motif counts of every specimen with its set and role joined on by name."""
    patterns = literal_motifs() if patterns is None else patterns
    counts = with_motif_counts(specimens.select("name", "sequence"), "sequence", patterns)
    roles = specimens.select("name", "set", "role", "containment")
    return counts.join(roles, "name", "left")


def budget_summary(answered: DataFrame, budgets: list[int] = DECODING_BUDGETS) -> DataFrame:
    """Per decoding budget: parse rate of the rows that were asked, and letters emitted before a parsed answer."""
    parsed = F.when(F.col("answer").isNotNull(), parse_vector("answer").isNotNull())
    rows = answered.select("budget", parsed.alias("parsed"), letters_before_answer("answer").alias("extra"))
    rates = rows.groupBy("budget").agg(
        F.count("*").alias("n"), F.count_if("parsed").alias("n_parsed"),
        F.avg(F.col("parsed").cast("double")).alias("parse_rate"),
        F.coalesce(F.max(F.when(F.col("parsed"), F.col("extra"))), F.lit(0)).alias("max_extra_letters"),
    )
    medians = percentiles(rows.where("parsed"), ["budget"], "extra", {"median_extra_letters": 0.5})
    return rates.join(medians, "budget", "left")


def decoding_agreement(df: DataFrame, first: str, second: str, tolerance: float = 1e-9) -> DataFrame:
    """How often two decodings of the same prompt agree, differ, or parse on one side only."""
    a, b = F.col(first), F.col(second)
    gap = max_abs_error(first, second)
    both = a.isNotNull() & b.isNotNull()
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(both & (gap <= tolerance)).alias("identical"),
        F.count_if(both & (gap > tolerance)).alias("differing"),
        F.count_if(a.isNotNull() != b.isNotNull()).alias("only_one_parsed"),
        F.count_if(a.isNull() & b.isNull()).alias("neither_parsed"),
        F.coalesce(F.max(F.when(both & (gap > tolerance), gap)), F.lit(0.0)).alias("max_abs_difference"),
    )


def batch_mismatches(df: DataFrame, first: str, second: str, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose prediction depends on the batch it ran in."""
    a, b = F.col(first), F.col(second)
    differs = (a.isNotNull() != b.isNotNull()) | (a.isNotNull() & b.isNotNull() & (max_abs_error(first, second) > tolerance))
    return df.agg(F.count("*").alias("n"), F.count_if(differs).alias("mismatches"))


def verify_published(specimens: DataFrame, targets: DataFrame, predict: Predict) -> DataFrame:
    """Re-score published sequences (set, id, sequence) against their target and published score."""
    scored = score_candidates(specimens, targets, predict)
    return scored.select(
        "set", "id", F.length("sequence").alias("length"), "published_r2", F.col("r2").alias("our_r2"),
        (~F.col("forward_parsed")).alias("parse_failed"), (F.col("r2") - F.col("published_r2")).alias("difference"),
        "prediction",
    )


def repeatability(df: DataFrame, groups: list[str], prediction: str = "prediction") -> DataFrame:
    """Draws and distinct outputs per group; a vector without any value is no output."""
    output = F.when(F.exists(prediction, lambda x: x.isNotNull()), F.col(prediction))
    return df.groupBy(*groups).agg(F.count("*").alias("n_draws"), F.count_distinct(output).alias("n_distinct"))

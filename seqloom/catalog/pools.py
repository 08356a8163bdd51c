"""Candidate pools: summaries, audits, best-of-n curves, scorer comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog.base import Entry
from seqloom.catalog.bindings import attempts, pool, rescored_pool, sequences, table
from seqloom.catalog.oracle import ATTEMPTS, POOL, SEED_SQL, SEQS, TARGETS_SQL, int_draw, prediction, r2, spread, with_
from seqloom.fixed import CANDIDATE_GRID
from seqloom.functions.vectors import spread as spread_of
from seqloom.operators import pools
from seqloom.operators.curation import with_copies
from seqloom.operators.pools import targets_table
from seqloom.plans import design
from seqloom.plans.inference import CLASS_BY_SLOT, predict_properties


def pool_rows(spark, folder):
    return pool(spark, folder).select(
        "set", "candidate_index", "length", "novel_exact", "forward_parsed", "r2", "mae", "rmse"
    )


def pool_summary(spark, folder):
    return pools.pool_summary(pool(spark, folder), targets_table(spark))


def best_rows(spark, folder):
    return pools.best_rows(pool(spark, folder)).select("set", "candidate_index", "length", "r2")


def selection_summary(spark, folder):
    return pools.selection_summary(pool(spark, folder), targets_table(spark))


def best_of_n(spark, folder):
    return pools.best_of_n(pools.scoreable(pool(spark, folder)), min_pool=4)


def best_of_n_uncapped(spark, folder):
    return pools.best_of_n(pools.scoreable(pool(spark, folder)), capped=False)


def best_of_n_bootstrap(spark, folder):
    return pools.best_of_n_bootstrap(pools.scoreable(pool(spark, folder)), min_pool=4)


def best_of_n_matrix(spark, folder):
    """Mean best of n with one column per n."""
    curve = pools.best_of_n(pools.scoreable(pool(spark, folder)), capped=False)
    return curve.groupBy("set").pivot("n_draws", CANDIDATE_GRID).agg(F.first("mean"))


def prices_best_of_n(spark, folder):
    """Best-of-n curve of line prices within every ship flag: a large pool per group."""
    lines = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("set"), "l_extendedprice")
    return pools.best_of_n(lines, ["set"], "l_extendedprice")


def low_start_sets(spark, folder):
    """How many sets start below the threshold for small n."""
    curve = pools.best_of_n(pools.scoreable(pool(spark, folder)), capped=False)
    low = F.when((F.col("n_draws") <= 4) & (F.col("mean") < 0), F.col("set"))
    return curve.agg(F.count_distinct(low).alias("n_sets"))


def novelty_audit(spark, folder):
    return pools.novelty_audit(pool(spark, folder))


def overall_copy_rate(spark, folder):
    return pools.overall_copy_rate(pools.novelty_audit(pool(spark, folder)))


def source_copy_audit(spark, folder):
    """The same audit with sources as sets: which documents also occur elsewhere."""
    rows = with_copies(sequences(spark, folder)).withColumn("novel_exact", F.col("n_copies") == 1)
    return pools.novelty_audit(rows.withColumnRenamed("source", "set"))


def scorer_comparison(spark, folder):
    return pools.scorer_comparison(pools.scoreable(rescored_pool(spark, folder)), targets_table(spark))


def score_histogram(spark, folder):
    return pools.score_histogram(pools.scoreable(pool(spark, folder)), ["set"]).select("set", "bin", "n")


def published_check(spark, folder):
    """Every document re-scored against the target of its attempt's set."""
    docs = sequences(spark, folder).select(F.col("doc_id").alias("attempt"), "sequence")
    specimens = attempts(spark, folder).select("set", "attempt").join(docs, "attempt").withColumnRenamed("attempt", "id")
    return design.verify_published(specimens, targets_table(spark), predict_properties).drop("prediction")


def target_spreads(spark, folder):
    """Target spread of every set with the number of attempts made for it."""
    made = attempts(spark, folder).groupBy("set").agg(F.count("*").alias("n_attempts"))
    return targets_table(spark).select("set", spread_of("target").alias("target_spread"), "published_r2").join(made, "set")


_HITS = "count(*) FILTER (WHERE r2 >= published_r2)"
_NEEDED = """CASE WHEN hits = 0 THEN NULL WHEN hits >= n THEN 1.0 ELSE ceil(ln(0.5) / ln(1.0 - hits / n)) END"""
_BEST = """best AS (SELECT "set", arg_max(struct_pack(mae, length, candidate_index, sequence), (r2, -candidate_index)) AS b FROM scored GROUP BY "set")"""


def _curve(source: str, group: str, score: str, where: str, floor: int = 1) -> str:
    return f"""counts AS MATERIALIZED (
  SELECT {group}, x, c, sum(c) OVER (PARTITION BY {group} ORDER BY x) AS upto, sum(c) OVER (PARTITION BY {group}) AS total
  FROM (SELECT {group}, {score} AS x, count(*) AS c FROM {source} GROUP BY ALL)),
grid AS (SELECT * FROM (VALUES {', '.join(f'({n})' for n in CANDIDATE_GRID)}) AS g(n_draws)),
weights AS MATERIALIZED (
  SELECT {group}, n_draws, total, x, pow((upto / total)::DOUBLE, n_draws) AS reached,
         pow((upto / total)::DOUBLE, n_draws) - pow(((upto - c) / total)::DOUBLE, n_draws) AS w
  FROM counts, grid WHERE total >= {floor} AND {where}),
curve AS MATERIALIZED (
  SELECT {group}, n_draws::BIGINT AS n_draws, any_value(total)::BIGINT AS n_pool, sum(x * w) AS mean,
         sqrt(greatest(sum(x * x * w) - pow(sum(x * w), 2), 0.0)) AS std, min(x) FILTER (WHERE reached >= 0.05) AS p05,
         min(x) FILTER (WHERE reached >= 0.5) AS p50, min(x) FILTER (WHERE reached >= 0.95) AS p95,
         bool_or(n_draws > total / 10) AS extrapolated FROM weights GROUP BY {group}, n_draws)"""


_CAPPED = "n_draws <= greatest(1, floor(total / 10))"
_UNCAPPED = "n_draws <= total"
_CURVE_COLUMNS = ["mean", "std", "p05", "p50", "p95"]
_DRAW = int_draw(SEED_SQL, '"set"', "n_draws", "replicate")
_SAMPLED = f"""printf('%.3f', (length(sequence) - length(translate(sequence, '{CLASS_BY_SLOT[0]}', '')))::DOUBLE / length(sequence)
  + (('0x' || substr(md5(concat_ws(':', candidate_index, sequence)), 1, 15))::BIGINT % 3) / 1000)::DOUBLE"""

ENTRIES = {
    "pool_rows": Entry(pool_rows, with_(POOL, """
SELECT "set", candidate_index, length, novel_exact, forward_parsed, r2, mae, rmse FROM pool"""), ["r2", "mae", "rmse"]),
    "pool_summary": Entry(pool_summary, with_(f"""{POOL},
{_BEST},
counts AS (SELECT "set", count(*) AS n_parsed_rows, count(*) FILTER (WHERE novel_exact) AS n_novel, count(*) FILTER (WHERE forward_parsed) AS n_forward_parsed FROM pool GROUP BY "set"),
stats AS (SELECT "set", count(*) AS n_scored, max(r2) AS r2_max, avg(r2) AS r2_mean, quantile_cont(r2, 0.5) AS r2_median,
                 coalesce(stddev_samp(r2), 0.0) AS r2_std, quantile_cont(r2, 0.05) AS r2_p05, quantile_cont(r2, 0.95) AS r2_p95, min(r2) AS r2_min,
                 avg((r2 >= published_r2)::INT) AS frac_above_published, {_HITS} AS hits, count(*) AS n FROM scored GROUP BY "set")""", f"""
SELECT "set", published_r2, {spread('target')} AS target_spread, n_parsed_rows, n_novel, n_forward_parsed, n_scored,
       r2_max, r2_mean, r2_median, r2_std, r2_p05, r2_p95, r2_min, frac_above_published, {_NEEDED} AS n_required,
       r2_max - r2_mean AS selection_gain, b.mae AS mae_at_best, b.length AS best_length, b.candidate_index AS best_index,
       sha256(b.sequence) AS best_digest
FROM counts JOIN stats USING ("set") JOIN best USING ("set") JOIN targets USING ("set")"""),
        ["target_spread", "r2_max", "r2_mean", "r2_median", "r2_std", "r2_p05", "r2_p95", "r2_min", "frac_above_published",
         "n_required", "selection_gain", "mae_at_best"]),
    "best_rows": Entry(best_rows, with_(f"{POOL},\n{_BEST}", """
SELECT "set", b.candidate_index AS candidate_index, b.length AS length, r2 FROM best JOIN (SELECT "set", max(r2) AS r2 FROM scored GROUP BY "set") USING ("set")"""), ["r2"]),
    "selection_summary": Entry(selection_summary, with_(f"""{POOL},
s AS (SELECT "set", count(*) AS n, any_value(published_r2) AS published_r2, avg(r2) AS mean_r2, quantile_cont(r2, 0.5) AS median_r2,
             max(r2) AS max_r2, {_HITS} AS hits FROM scored GROUP BY "set" HAVING count(*) >= 4)""", f"""
SELECT "set", n AS n_pool, published_r2, mean_r2, median_r2, max_r2, hits / n AS frac_at_or_above, {_NEEDED} AS n_to_reach,
       max_r2 - mean_r2 AS selection_gain FROM s"""), ["mean_r2", "median_r2", "max_r2", "frac_at_or_above", "n_to_reach", "selection_gain"]),
    "best_of_n": Entry(best_of_n, with_(f"{POOL},\n" + _curve("scored", '"set"', "r2", _CAPPED, 4), "SELECT * FROM curve"), _CURVE_COLUMNS),
    "best_of_n_uncapped": Entry(
        best_of_n_uncapped, with_(f"{POOL},\n" + _curve("scored", '"set"', "r2", _UNCAPPED), "SELECT * FROM curve"), _CURVE_COLUMNS
    ),
    "best_of_n_bootstrap": Entry(best_of_n_bootstrap, with_(f"""{POOL},
ranked AS MATERIALIZED (SELECT "set", r2, row_number() OVER (PARTITION BY "set" ORDER BY r2) AS rank, count(*) OVER (PARTITION BY "set") AS m FROM scored),
draws AS MATERIALIZED (
  SELECT "set", n_draws, m, greatest(ceil(m * pow({_DRAW} / 1152921504606846976.0::DOUBLE, 1.0::DOUBLE / n_draws)), 1)::BIGINT AS rank
  FROM (SELECT DISTINCT "set", m FROM ranked WHERE m >= 4), (VALUES {', '.join(f'({n})' for n in CANDIDATE_GRID)}) AS g(n_draws), range(2000) AS t(replicate)
  WHERE n_draws <= greatest(1, floor(m / 10)))""", """
SELECT "set", n_draws::BIGINT AS n_draws, count(*) AS n_replicates, avg(r2) AS mean, stddev_samp(r2) AS std, bool_or(n_draws > draws.m / 10) AS extrapolated,
       quantile_cont(r2, 0.05) AS p05, quantile_cont(r2, 0.5) AS p50, quantile_cont(r2, 0.95) AS p95
FROM draws JOIN ranked USING ("set", rank) GROUP BY "set", n_draws"""), _CURVE_COLUMNS),
    "best_of_n_matrix": Entry(best_of_n_matrix, with_(f"{POOL},\n" + _curve("scored", '"set"', "r2", _UNCAPPED), 'SELECT "set", ' + ", ".join(
        f'max(mean) FILTER (WHERE n_draws = {n}) AS "{n}"' for n in CANDIDATE_GRID
    ) + ' FROM curve GROUP BY "set"'), [str(n) for n in CANDIDATE_GRID]),
    "prices_best_of_n": Entry(prices_best_of_n, with_(_curve(
        '(SELECT l_returnflag AS "set", l_extendedprice FROM lineitem)', '"set"', "l_extendedprice", _CAPPED), "SELECT * FROM curve"), _CURVE_COLUMNS),
    "low_start_sets": Entry(low_start_sets, with_(f"{POOL},\n" + _curve("scored", '"set"', "r2", _UNCAPPED), """
SELECT count(DISTINCT "set") FILTER (WHERE n_draws <= 4 AND mean < 0) AS n_sets FROM curve""")),
    "novelty_audit": Entry(novelty_audit, with_(f"""{POOL},
c AS (SELECT "set", novel_exact, sequence, count(*) AS n FROM pool GROUP BY ALL)""", """
SELECT "set", sum(n)::BIGINT AS n_parsed, coalesce(sum(n) FILTER (WHERE NOT novel_exact), 0)::BIGINT AS n_verbatim_copies,
       coalesce(sum(n) FILTER (WHERE NOT novel_exact), 0) / sum(n) AS copy_rate, coalesce(sum(n) FILTER (WHERE novel_exact), 0)::BIGINT AS n_novel,
       count(*) FILTER (WHERE NOT novel_exact) AS n_distinct_copied_sequences,
       coalesce(max(n) FILTER (WHERE NOT novel_exact) / sum(n) FILTER (WHERE NOT novel_exact), 0.0) AS most_repeated_copy_share,
       count(*) FILTER (WHERE novel_exact) AS n_distinct_novel FROM c GROUP BY "set\"""")),
    "overall_copy_rate": Entry(overall_copy_rate, with_(POOL, """
SELECT count(*) FILTER (WHERE NOT novel_exact) AS n_copies, count(*) AS n_parsed, count(*) FILTER (WHERE NOT novel_exact) / count(*) AS copy_rate FROM pool""")),
    "source_copy_audit": Entry(source_copy_audit, with_(f"""{SEQS},
copies AS (SELECT source AS "set", sequence, count(*) OVER (PARTITION BY sequence) = 1 AS novel_exact FROM seqs),
c AS (SELECT "set", novel_exact, sequence, count(*) AS n FROM copies GROUP BY ALL)""", """
SELECT "set", sum(n)::BIGINT AS n_parsed, coalesce(sum(n) FILTER (WHERE NOT novel_exact), 0)::BIGINT AS n_verbatim_copies,
       coalesce(sum(n) FILTER (WHERE NOT novel_exact), 0) / sum(n) AS copy_rate, coalesce(sum(n) FILTER (WHERE novel_exact), 0)::BIGINT AS n_novel,
       count(*) FILTER (WHERE NOT novel_exact) AS n_distinct_copied_sequences,
       coalesce(max(n) FILTER (WHERE NOT novel_exact) / sum(n) FILTER (WHERE NOT novel_exact), 0.0) AS most_repeated_copy_share,
       count(*) FILTER (WHERE novel_exact) AS n_distinct_novel FROM c GROUP BY "set\"""")),
    "scorer_comparison": Entry(scorer_comparison, with_(f"""{POOL},
again AS (SELECT *, {r2('target', f'([{_SAMPLED}] || prediction[2:])')} AS again FROM scored)""", """
SELECT "set", count(*) AS n, max(r2) AS max_first, max(again) AS max_second, max(again) - max(r2) AS max_inflation, avg(r2) AS mean_first,
       avg(again) AS mean_second, avg((abs(r2 - again) < 1e-9)::INT) AS frac_scores_identical,
       any_value(published_r2) - max(r2) AS gap_first, any_value(published_r2) - max(again) AS gap_second FROM again GROUP BY "set\""""),
        ["max_first", "max_second", "max_inflation", "mean_first", "mean_second", "frac_scores_identical", "gap_first", "gap_second"]),
    "score_histogram": Entry(score_histogram, with_(f"""{POOL},
lows AS (SELECT "set", quantile_cont(r2, 0.02) AS low FROM scored GROUP BY "set")""", """
SELECT "set", coalesce(least(floor((least(greatest(r2, low), 1.0) - low) / nullif((1.0 - low) / 40, 0)), 39), 0)::BIGINT AS bin, count(*) AS n
FROM scored JOIN lows USING ("set") GROUP BY ALL""")),
    "published_check": Entry(published_check, with_(f"""{ATTEMPTS},
{TARGETS_SQL},
d AS MATERIALIZED (
  SELECT "set", attempt AS id, seqs.sequence, target, published_r2, {prediction('seqs.sequence')} AS prediction
  FROM attempts JOIN seqs ON doc_id = attempt JOIN targets USING ("set"))""", f"""
SELECT "set", id, length(sequence) AS length, published_r2, {r2('target', 'prediction')} AS our_r2, false AS parse_failed,
       {r2('target', 'prediction')} - published_r2 AS difference FROM d"""), ["our_r2", "difference"]),
    "target_spreads": Entry(target_spreads, with_(POOL, f"""
SELECT "set", {spread('target')} AS target_spread, published_r2, n_attempts
FROM targets JOIN (SELECT "set", count(*) AS n_attempts FROM attempts GROUP BY "set") USING ("set")"""), ["target_spread"]),
}

"""Replayable pseudo-randomness: a draw depends on (seed, row id, ...), never on the partition."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_RANGE = float(1 << 60)


def _col(part) -> Column:
    return part if isinstance(part, Column) else F.lit(part)


def draw_hex(*parts) -> Column:
    """32 hex digits; sorting by it gives a uniform order."""
    return F.md5(F.concat_ws(":", *[_col(p).cast("string") for p in parts]))


def draw_int(*parts) -> Column:
    """Uniform integer in [0, 2^60)."""
    return F.conv(F.substring(draw_hex(*parts), 1, 15), 16, 10).cast("bigint")


def draw_unit(*parts) -> Column:
    """Uniform double in [0, 1)."""
    return draw_int(*parts).cast("double") / F.lit(HASH_RANGE)


def draw_below(n: Column, *parts) -> Column:
    """Uniform integer in [0, n); NULL where n is 0."""
    return F.pmod(draw_int(*parts), F.nullif(n.cast("bigint"), F.lit(0).cast("bigint")))


def digest(sequence) -> Column:
    """Identity of a long string, so that shuffles on it carry 64 bytes rather than the string."""
    return F.sha2(F.col(sequence) if isinstance(sequence, str) else sequence, 256)


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` (lambdas otherwise re-evaluate what they capture)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

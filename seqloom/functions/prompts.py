"""Prompt texts and the parsing of bracketed answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from seqloom.fixed import FORWARD_TASK, INVERSE_TASK, RESIDUES, SOLUBILITY_TASK
from seqloom.functions.hashing import let

# Decimal or scientific notation with optional digit grouping, or the special values.
_DIGITS = r"[0-9](?:_?[0-9])*"
FLOAT_PATTERN = (
    rf"^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))$"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


@F.pandas_udf(StringType())
def _three_decimals(vectors: pd.Series) -> pd.Series:
    # Correct rounding of the binary value; the JVM formatter rounds its decimal text half-up.
    return vectors.map(lambda v: None if v is None else ",".join(f"{x:.3f}" for x in v))


def format_vector(vector) -> Column:
    """Eight values, three decimals, comma-separated. Any other size fails the job."""
    vector = _col(vector)
    checked = F.when(vector.isNull() | (F.size(vector) == 8), vector).otherwise(
        F.raise_error(F.concat(F.lit("expected 8 properties, got "), F.size(vector).cast("string")))
    )
    return _three_decimals(checked)


def forward_prompt(seq) -> Column:
    return F.concat(F.lit(FORWARD_TASK + "<"), _col(seq), F.lit(">"))


def inverse_prompt(vector) -> Column:
    return F.concat(F.lit(INVERSE_TASK + "<"), format_vector(vector), F.lit(">"))


def solubility_prompt(seq) -> Column:
    return F.concat(F.lit(SOLUBILITY_TASK + "<"), _col(seq), F.lit(">"))


def task_of(prompt) -> Column:
    return F.nullif(F.regexp_extract(prompt, "^([A-Za-z]+)<", 1), F.lit(""))


def continuation(text, prompt) -> Column:
    """The text after the prompt, or the whole text when it does not start with it."""
    text, prompt = _col(text), _col(prompt)
    return F.when(F.startswith(text, prompt), F.substr(text, F.length(prompt) + 1)).otherwise(text)


def bracketed(text) -> Column:
    """Contents of the first [...] group; NULL when absent or unterminated."""

    def contents(x: Column) -> Column:
        return F.when((x["open"] > 0) & (x["length"] > 0), F.substr(x["text"], x["open"] + 1, x["length"] - 1))

    def closed(x: Column) -> Column:
        length = F.locate("]", F.substr(x["text"], x["open"] + 1))
        return let(F.struct(x["text"].alias("text"), x["open"].alias("open"), length.alias("length")), contents)

    text = _col(text)
    return let(text, lambda t: let(F.struct(t.alias("text"), F.instr(t, "[").alias("open")), closed))


def parse_float(text) -> Column:
    """Double, or NULL for anything that is not a plain number text."""
    return let(
        strip(_col(text)),
        lambda t: F.when(F.rlike(t, F.lit(FLOAT_PATTERN)), F.replace(t, F.lit("_"), F.lit(""))).try_cast("double"),
    )


def parse_vector(text) -> Column:
    """Exactly eight numbers between the first brackets, empties dropped; NULL otherwise."""
    parts = F.filter(F.transform(F.split(bracketed(text), ","), strip), lambda p: p != "")
    return let(
        F.transform(parts, parse_float),
        lambda v: F.when((F.size(v) == 8) & F.forall(v, lambda x: x.isNotNull()), v),
    )


def parse_sequence(text) -> Column:
    """Non-empty standard sequence between the first brackets; NULL otherwise."""
    return let(strip(bracketed(text)), lambda s: F.when(F.rlike(s, F.lit(f"^[{RESIDUES}]+$")), s))


def parse_solubility(text) -> Column:
    """First comma-separated item between the first brackets as a number."""
    return parse_float(F.substring_index(strip(bracketed(text)), ",", 1))


def answer_status(text) -> Column:
    """'parsed', 'unparseable' (no bracket group) or 'invalid_aa' (group present, not a sequence)."""
    return let(
        bracketed(text),
        lambda b: F.when(b.isNull(), "unparseable")
        .when(F.rlike(strip(b), F.lit(f"^[{RESIDUES}]+$")), "parsed")
        .otherwise("invalid_aa"),
    )


def letters_before_answer(text) -> Column:
    """Letters emitted before the first bracket."""
    return F.length(F.regexp_replace(F.substring_index(text, "[", 1), "[^A-Za-z]", ""))

"""Small documents that exercise edge cases, shared by the tests of the operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns an operator adds; inputs that already have them must not confuse it.
CLASHING = ["n_tokens", "n_words", "kept", "score", "digest", "host", "line", "component_id", "spans", "key", "part", "row", "id", "words"]


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 8))) for _ in range(n))


def odd_rows() -> list[tuple]:
    long = words(9, 30_000)
    return [
        (1, words(1, 80), "en", "a", 1),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \n\t \n", "fr", "b", 5),
        (5, words(1, 80), "en", "a", 1),
        (6, words(6, 3), "en", "b", 1),
        (7, long, "de", "a", len(long)),
        (8, "x" * 50_000, None, "a", 50_000),
        (9, "Ünï çødé — 漢字 😀 \x00\x1c\x85 mixed  blanks\n\nlast", "es", None, 3),
        (9, "Ünï çødé — 漢字 😀 \x00\x1c\x85 mixed  blanks\n\nlast", "es", None, 3),
        (None, words(11, 40), "en", "a", 1),
        (None, None, None, None, None),
        (12, "mail a.b@c.org, 10.0.0.1, 4111 1111 1111 1111, +1 (212) 555-0100 end", "en", "a", 1),
        (13, "a@b.c_x@d.e 1.2.3.4.5.6.7.8 999.1.1.1 +1+22 33 44 55 66 77 4111111111111112", "en", "b", 1),
    ]


def documents(spark: SparkSession, rows: list[tuple], clashing: bool = False) -> DataFrame:
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        for name in CLASHING:
            df = df.selectExpr("*", f"'other' AS {name}")
    return df


def got(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

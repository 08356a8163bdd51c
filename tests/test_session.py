"""What every session sets."""

import pandas as pd
from pyspark.sql import functions as F

from seqloom.session import tune


def test_batches_of_long_texts_end_by_bytes(spark):
    @F.pandas_udf("bigint")
    def batch_letters(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    long = tune(spark).range(0, 1000, 1, 1).select(F.repeat(F.lit("ACDEFGHIKL"), F.lit(2000)).alias("text"))
    most = long.select(batch_letters("text").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert most[0] <= 5 << 20 and most[1] == 1000

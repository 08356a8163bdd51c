"""Small helpers shared by the operators: tables, batches of whole texts, the hash folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqloom.session import stored, tune

#: ASCII white space, which separates words in every contract here.
BLANKS = " \t\n\v\f\r"
#: Characters of the Unicode property White_Space, as a class body for patterns.
WHITE = "\t-\r \x85\xa0  -     　"
#: Text handled at once inside a Python task; one longer text is a slice of its own.
SLICE_CHARS = 1_500_000

__all__ = ["BLANKS", "SLICE_CHARS", "WHITE", "documents", "fold", "map_slices", "runs", "slices", "stored", "table", "tune"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns cannot clash with those an operator adds."""
    return docs.select(*(docs[c] for c in columns))


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id written as text, modulo `folds`; null ids fall in fold 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds, F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about `chars` bytes of text at most, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > chars:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def runs(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[slice]:
    """Places of consecutive texts that hold about `chars` characters at most, or one text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and held + n > chars:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))


def map_slices(df: DataFrame, work: Callable, schema: str, text: str = "text", chars: int = SLICE_CHARS) -> DataFrame:
    """`work` makes a dict of columns from each slice; rows stay with their partition, so nothing is shuffled."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        for piece in slices(batches, text, chars):
            made = work(piece)
            yield pa.RecordBatch.from_arrays([made[n] if isinstance(made[n], pa.Array) else pa.array(made[n]) for n in names], names)

    return df.mapInArrow(run, schema)

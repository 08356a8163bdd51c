"""How a query and its SQL counterpart are put in comparable form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType

from seqloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    """`doubles` names the floating-point columns: sums run in another order in another engine, so
    both sides round them alike."""

    query: Query
    sql: str | None = None
    doubles: list[str] = field(default_factory=list)
    decimals: int = 6

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.query(tune(spark), folder)
        # Adding 0.0 turns a rounded -0.0 into 0.0.
        fixes = {c: F.round(F.col(c), self.decimals) + F.lit(0.0) for c in self.doubles}
        fixes |= {f.name: F.col(f.name).cast("bigint") for f in df.schema if isinstance(f.dataType, IntegerType)}
        return df.withColumns(fixes) if fixes else df

    def oracle(self) -> str | None:
        if self.sql is None or not self.doubles:
            return self.sql
        rounded = ", ".join(f'round("{c}", {self.decimals}) + 0.0 AS "{c}"' for c in self.doubles)
        return f"SELECT * REPLACE ({rounded}) FROM (\n{self.sql}\n)"

"""Run catalog queries against their SQL counterparts. Also usable by hand:
python tests/compare.py sf0.001 [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

DATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(folder: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def normal(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


TIMES = {"spark": 0.0}


def difference(spark, con, entry, folder: Path) -> str | None:
    """None when both sides agree exactly, else a short account of the first difference."""
    df = entry.run(spark, str(folder))
    begun = time.time()
    columns, got = normal(df.columns, [tuple(r) for r in df.collect()])
    TIMES["spark"] = time.time() - begun
    if entry.oracle() is None:
        return None if got else "no rows"
    cursor = con.execute(entry.oracle())
    names, wanted = normal([d[0] for d in cursor.description], cursor.fetchall())
    if columns != names:
        return f"columns {columns} != {names}"
    if len(got) != len(wanted):
        return f"{len(got)} rows != {len(wanted)}"
    bad = [(a, b) for a, b in zip(got, wanted) if a != b]
    types = [(type(a).__name__, type(b).__name__) for a, b in zip(got[0], wanted[0])] if got else []
    odd = [(c, t) for c, t in zip(columns, types) if t[0] != t[1] and "NoneType" not in t]
    if odd:
        return f"types differ {odd}"
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"[:1500] if bad else (None if got else "no rows")


if __name__ == "__main__":
    from seqloom.catalog import entries
    from seqloom.session import local_session

    folder = DATA / sys.argv[1]
    spark, con = local_session(memory="12g"), connection(folder)
    known = entries()
    for name in sys.argv[2:] or known:
        begun = time.time()
        try:
            verdict = difference(spark, con, known[name], folder)
        except Exception as error:
            verdict = f"{type(error).__name__}: {str(error)[:1800]}"
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {time.time() - begun:.1f}s (spark run {TIMES['spark']:.1f}s) {'' if known[name].sql else '(no sql) '}{verdict or ''}", flush=True)

"""Exact search against brute force: ties, copies, hot clusters, odd rows."""

import math
import random

import numpy as np
import pytest

from seqloom.llm import pivot_search
from seqloom.llm.pivot_search import search

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, top=5, step=50):
    usable = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault(i, np.floor(256 * np.array(v, dtype=np.float32).astype(np.float64)))
    out = []
    for q in (i for i in usable if i % step == 0):
        scored = sorted(((-int(usable[q] @ v), i) for i, v in usable.items() if i != q))[:top]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def clustered(n, dims=8, seed=1):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [c + draw.gauss(0, 0.05) for c in draw.choice(centres)], 0) for i in range(n)]


@pytest.mark.parametrize("annulus", [4096, 30])
def test_against_brute_force(spark, monkeypatch, annulus):
    monkeypatch.setattr(pivot_search, "ANNULUS", annulus)
    monkeypatch.setattr(pivot_search, "BLOCK", 4)
    draw = random.Random(3)
    rows = clustered(500) + [(1000 + i, [draw.uniform(-1, 1) for _ in range(8)], 0) for i in range(300)]
    rows += [(2000 + i, rows[7][1], 0) for i in range(120)]
    rows += [(50 * 60, None, 0), (50 * 61, [1.0, None] + [0.0] * 6, 0), (50 * 62, [float("nan")] * 8, 0), (50 * 63, [float("inf")] * 8, 0), (50 * 64, [], 0), (None, [1.0] * 8, 0), (50, rows[50][1], 0), (50 * 65, [0.0] * 8, 0), (50 * 66, [-3.0] * 8, 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS v", "'x' AS pivot", "'x' AS distance", "'x' AS score")
    assert sorted(map(tuple, search(df).select("query_id", "rank", "vec_id", "score").collect())) == brute(rows)


def test_fewer_than_asked_for_and_none(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [0.5, 0.5], 0)]
    assert sorted(map(tuple, search(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
    assert search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert search(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)).count() == 0


def test_clusters_are_ruled_out(spark, monkeypatch):
    """On clustered vectors most of the index is never compared."""
    monkeypatch.setattr(pivot_search, "ANNULUS", 40)
    seen = []
    plain = pivot_search.searched
    monkeypatch.setattr(pivot_search, "searched", lambda routes, index, top: seen.append(routes.count()) or plain(routes, index, top))
    rows = [(i, v, k) for i, v, k in clustered(2000)]
    found = sorted(map(tuple, search(spark.createDataFrame(rows, SCHEMA)).select("query_id", "rank", "vec_id", "score").collect()))
    assert found == brute(rows)
    assert sum(seen) < 0.5 * 40 * (2000 / 40)


def test_odd_lengths_and_large_scores(spark):
    """Vectors of another length than most are left out; scores past 2^53 stay exact."""
    draw = random.Random(3)
    rows = [(i, [draw.uniform(-3e5, 3e5) for _ in range(4)]) for i in range(150)]
    odd = [(1000, [1.0]), (1001, [1e5] * 7), (1050, [0.5] * 3)]
    got = [tuple(r) for r in search(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")).collect()]
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    wanted = []
    for i in whole:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[i], v)), j) for j, v in whole.items() if j != i)[:5]
            wanted += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    assert sorted(got) == sorted(wanted) and max(s for *_, s in got) > 1 << 53
    with pytest.raises(ValueError):
        search(spark.createDataFrame([(1, [1e9, 1e9])], "vec_id bigint, embedding array<double>"))

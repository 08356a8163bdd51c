"""Spelling variants against a comparison of every word with every other one."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

from samples import documents, got, odd_rows, words as made_words

from seqloom.llm.spelling import near_pairs, roots, spelling_variants

RESULT = ("word", "form", "root", "n", "n_near", "form_n")


def one_edit(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows) -> list[tuple]:
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [] for w in count}
    for a, b in combinations(count, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-count[o], o), default=None)
        form[w] = best if best is not None and count[best] >= 2 * count[w] else None
    out = []
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def varied(seed: int, n: int) -> str:
    """Words over few letters, some of them accented or upper case, so that many are near each other."""
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("aabÀéE÷z", k=draw.choice((4, 5, 5, 6, 7)))) for _ in range(n))


def test_equals_brute_force(spark):
    rows = odd_rows() + [(100 + i, varied(i % 40, 300), "en", "a", 1) for i in range(120)]
    wanted = brute(rows)
    assert got(spelling_variants(documents(spark, rows, clashing=True)), *RESULT) == wanted
    assert sum(r[4] for r in wanted) > 500 and any(r[2] != r[0] and r[2] != r[1] for r in wanted)


def test_damaged_runs_and_ties(spark):
    rows = [(i, "wörterbuch", None, None, 1) for i in range(2000)] + [(5000 + i, "mittel " * 3 + "mittal mittul", None, None, 1) for i in range(30)]
    out = got(spelling_variants(documents(spark, rows)), *RESULT)
    assert out == brute(rows) and len(out) > 4


def test_pairs_are_found_once_even_in_one_crowded_key(spark):
    stems = ["beginning" + a + b for a in "abcdefghijklmnopqrst" for b in ("", *"abcdefghijklmnopqrst")]
    ends = [a + b + "tionalised" for a in "abcdefghij" for b in ("", *"abcdefghij")]
    every = stems + ends + ["aaaaa", "aaaaaa", "aaaaaaa", "aabaa", "abaaa"]
    found = got(near_pairs(spark.createDataFrame([(w, i + 3) for i, w in enumerate(every)], "word string, n bigint")), "a", "b")
    assert sorted(tuple(sorted(p)) for p in found) == sorted(tuple(sorted(p)) for p in combinations(every, 2) if one_edit(*p))


def test_long_chains_reach_their_root(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(63)]
    assert {r["root"] for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {"w63"}


def test_nothing_and_long_texts(spark):
    assert spelling_variants(documents(spark, [])).collect() == []
    assert spelling_variants(documents(spark, [(1, None, None, None, None), (2, "", None, None, 0), (3, "ab cd", None, None, 5)])).collect() == []
    text = made_words(3, 200_000)
    assert got(spelling_variants(documents(spark, [(7, text, "en", "a", 1)])), "word", "n") == sorted(((w, n) for w, _, _, n, _, _ in brute_counts(7, text)), key=repr)


def brute_counts(doc_id, text):
    count = Counter()
    for run in re.findall("[a-z]+", text):
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return [(w, None, None, n, None, None) for w, n in count.items() if len(w) >= 5 and n >= 3]


def test_plan_has_no_cross_join(spark):
    plan = near_pairs(spark.createDataFrame([("abcde", 3)], "word string, n bigint"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan

"""What each sequence edit preserves and destroys."""

from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.fixed import CANONICAL_MOTIFS, RESIDUES
from seqloom.functions import draws, edits as ed, hashing

LONG = ("GPGGYGQGGSAAAAAAAAGGAGQGGYGGLGSQGAGRGGQGAGAAAAAAGGVGQ" * 6)[:300]
CASES = [LONG, "GAGAGAAAAAGPGQQ", "A", "", "CCCC"]


@pytest.fixture(scope="module")
def run(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "id bigint, s string")

    def apply(edit, partitions=2):
        rows = df.repartition(partitions).select("id", edit(F.col("s"), F.col("id")).alias("e")).collect()
        return [r["e"] for r in sorted(rows, key=lambda r: r["id"])]

    return apply


def is_subsequence(short, long):
    it = iter(long)
    return all(c in it for c in short)


def test_shuffles_keep_the_composition_and_replay(run):
    for edit in (lambda s, i: ed.shuffle_residues(s, 7, i), lambda s, i: ed.shuffle_blocks(s, 7, i)):
        out = run(edit)
        assert [Counter(a) for a in out] == [Counter(b) for b in CASES]
        assert out[0] != LONG and out == run(edit, partitions=5)
    assert run(lambda s, i: ed.shuffle_residues(s, 8, i)) != run(lambda s, i: ed.shuffle_residues(s, 7, i))


def test_blocks_stay_whole(run):
    blocks = [LONG[i:i + 20] for i in range(0, len(LONG), 20)]
    out = run(lambda s, i: ed.shuffle_blocks(s, 7, i))[0]
    assert all(b in out for b in blocks)


def test_reverse_is_an_involution(run):
    assert run(lambda s, i: ed.reverse_sequence(ed.reverse_sequence(s))) == CASES


def test_knockout(run):
    out = run(lambda s, i: ed.knockout_delete(s, CANONICAL_MOTIFS["polyA"]))
    assert out[1] == "GAGAGGPGQQ" and out[4] == "CCCC"
    assert all(is_subsequence(a, b) for a, b in zip(out, CASES))


@pytest.mark.parametrize("n", [0, 5, 299, 300, 400])
def test_deletions_match_in_length(run, n):
    for edit in (ed.scattered_deletion, ed.block_deletion):
        out = run(lambda s, i: edit(s, F.lit(n), 3, i))
        for a, b in zip(out, CASES):
            assert len(a) == (len(b) - n if 0 < n < len(b) else len(b))
            assert is_subsequence(a, b)
        if edit is ed.block_deletion and 0 < n < len(LONG):
            assert any(out[0] == LONG[:k] + LONG[k + n:] for k in range(len(LONG) - n + 1))


def test_substitution_keeps_length_and_unmatched_residues(run):
    out = run(lambda s, i: ed.knockout_substitute(s, "A{4,}", 3, i))
    assert [len(a) for a in out] == [len(b) for b in CASES]
    assert out[1][:5] == "GAGAG" and out[1][10:] == "GPGQQ" and set(out[0]) <= set(LONG)


def test_termini_and_core_partition(run):
    t, c = run(lambda s, i: ed.keep_termini(s)), run(lambda s, i: ed.keep_core(s))
    assert t[0][:130] + c[0] + t[0][130:] == LONG
    assert t[1:] == CASES[1:] and c[1:] == [""] * 4
    assert run(lambda s, i: ed.truncate_to(s, 3)) == [s[:3] for s in CASES]


def test_random_sequences(run):
    out = run(lambda s, i: ed.random_matched(s, 3, i))
    assert [len(a) for a in out] == [len(b) for b in CASES] and set(out[0]) <= set("ACDEFGHIKLMNPQRSTVWY")


def test_point_mutation_changes_one_residue_within_its_class(run):
    peers = ed.conservative_peers()
    for edited, original in zip(run(lambda s, i: ed.point_mutation(s, 3, i)), CASES):
        i = edited["position"]
        if original == "":
            assert i == -1 and edited["edited"] == ""
            continue
        assert edited["edited"][i] in peers[original[i]]
        assert edited["edited"][:i] + original[i] + edited["edited"][i + 1:] == original


def test_panel_has_only_applicable_edits(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "id bigint, s string")
    names = {}
    for row in ed.edit_panel(df, "s", "id", 3).collect():
        names.setdefault(row["id"], set()).add(row["ablation"])
    assert {"termini_only", "core_only", "knockout_polyA", "block_control_GGX"} <= names[0]
    assert "termini_only" not in names[1] and "knockout_GGX" not in names[1] and 3 not in names


def test_batched_draws_are_those_of_the_expressions(spark):
    """Long prefixes, many digits, several texts to a batch, an empty and a NULL one."""
    rows = [(1, "ACDEFGHIKLMNPQRSTVWY" * 40), (2, ""), (3, None), (4, "GA" * 9000), (10**17, "MK")]
    df = spark.createDataFrame(rows, "id long, s string").coalesce(1)
    letters = F.when(F.length("s") > 0, F.split("s", "")).otherwise(F.array().cast("array<string>"))
    for tag in ("short", "x" * 60):
        parts = (F.lit(7), F.col("id"), F.lit(tag))
        ordered = F.sort_array(F.transform(letters, lambda c, i: F.struct(hashing.draw_hex(*parts, i).alias("h"), i.alias("i"), c.alias("c"))))
        residues = F.transform(letters, lambda _, i: F.substr(F.lit(RESIDUES), (F.pmod(hashing.draw_int(*parts, i), F.lit(20)) + 1).cast("int"), F.lit(1)))
        wanted = df.where("s is not null").select(
            "id", F.array_join(F.transform(ordered, lambda x: x["c"]), "").alias("a"), F.array_join(residues, "").alias("b")).collect()
        got = df.select("id", draws.shuffled(F.col("s"), *parts).alias("a"), draws.randomised(F.col("s"), *parts).alias("b")).collect()
        assert sorted(r for r in got if r["a"] is not None) == sorted(wanted)
        assert [r["b"] for r in got if r["id"] == 3] == [None]


def test_digests_of_many_prefixes_are_those_of_hashlib(monkeypatch):
    """Prefixes of every length up to a block and beyond, hashed together; the decimal text of a position is made once."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(draws, "CHUNK", 400)
    prefixes = ["".join("abcé"[j] for j in rng.integers(0, 4, k)) for k in range(60)]
    places = [np.arange(rng.integers(0, 300)) if k % 3 else np.sort(rng.choice(2 * draws.TABLE, 20, replace=False)) for k in range(60)]
    made = []
    monkeypatch.setattr(draws, "_tail", lambda kept, at, whole=draws._tail: made.append(int(at[-1])) or whole(kept, at))
    draws._tails.cache_clear()
    for prefix, where, (upper, lower) in zip(prefixes, places, draws._halves(prefixes, places)):
        assert [f"{int(a):016x}{int(b):016x}" for a, b in zip(upper, lower)] == [md5(f"{prefix}{i}".encode()).hexdigest() for i in where]
    assert sum(at < draws.TABLE for at in made) == 4


def test_reordered_blocks_and_mutated_letters(spark):
    """Against the definitions, with letters that are no residues, empty and NULL texts."""
    from seqloom.functions.edits import point_mutation, shuffle_blocks

    texts = ["ACDEFGHIKL" * 9, "AC", "", None, "ébAC1", "1é" * 30, "A𝔸C" * 11]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string").repartition(2)
    rows = {r["id"]: r for r in df.select("id", shuffle_blocks("s", 5, F.col("id")).alias("b"), point_mutation("s", 5, F.col("id")).alias("p")).collect()}
    draw = lambda *parts: md5(":".join(map(str, parts)).encode()).hexdigest()
    for i, text in enumerate(texts):
        if text is None:
            assert rows[i]["b"] is None
            continue
        pieces = [text[at:at + 20] for at in range(0, len(text), 20)]
        order = sorted(range(len(pieces)), key=lambda k: (draw(5, i, "blocks", k), k))
        assert rows[i]["b"] == "".join(pieces[k] for k in order)
        where = [k for k, c in enumerate(text) if c in "ACDEFGHIKLMNPQRSTVWY"]
        at = where[int(draw(5, i, "point")[:15], 16) % len(where)] if where else -1
        assert rows[i]["p"]["position"] == at and len(rows[i]["p"]["edited"]) == len(text)
        assert [k for k in range(len(text)) if rows[i]["p"]["edited"][k] != text[k]] == ([at] if where else [])

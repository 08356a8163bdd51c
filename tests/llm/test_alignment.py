"""Alignment of two tokenizers against the libraries on whole texts; the perfect hash against a dictionary."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from samples import documents, got, odd_rows, words
from tokenizers import Tokenizer

from seqloom.llm.alignment import FIRST, SECOND, Lookup, aligned_documents, byte_alphabet, op13_pair_hashing, perfect_hash, shard_of

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    "<|endoftext|> <s> </s> <0x41> a", "  two  blanks  ", "line\n next\n\n  last ", "tab\t x y 　z", "▁ marks ▁▁ here", "ﬁ Ǆ é ½²",
    "\x1c x\x1cy \x85 z", " ", "\n", "   \n   ", "a", "x" * 3000, "漢字 かな 😀😀 👩‍👩‍👧", "don't we'll  I'M", "1234567 89 0", "​ ﻿ x", "\x00 \x7f",
]


def brute(rows) -> list[tuple]:
    a = Tokenizer.from_file(public_tokenizers.path(FIRST))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(SECOND))
    alphabet, back = byte_alphabet(), {i: t for t, i in a.get_vocab().items()}
    found, total = [], Counter()
    for doc_id, text, *_ in rows:
        ends = ([], [])
        ids = ([], [])
        if text:
            whole = (" " + text).encode()
            ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
            parts = ([bytes(alphabet[c] for c in back[i]) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]])
            if all(b"".join(p) == whole for p in parts):
                ends = tuple(np.cumsum([len(x) for x in p]).tolist() for p in parts)
            else:
                ids = ([], [])
        spans = [[(s, e, i) for s, e, i in zip([0, *n[:-1]], n, x)] for n, x in zip(ends, ids)]
        links, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = defaultdict(lambda: ([], []))
        for side in (0, 1):
            for s, e, i in spans[side]:
                groups[cuts[bisect_left(cuts, e)]][side].append(str(i))
        digest = hashlib.sha256(";".join("|".join(",".join(x) for x in groups[c]) for c in cuts).encode()).hexdigest() if cuts else ""
        total.update(links)
        found.append((doc_id, len(spans[0]), len(spans[1]), len(cuts), links, digest))
    best = defaultdict(int)
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    return sorted(((d, x, y, g, len(links), sum(total[p] == best[p[1]] for p in links), sum(total[p] for p in links), h) for d, x, y, g, links, h in found), key=repr)


def rows_of(n: int = 40) -> list[tuple]:
    draw = random.Random(5)
    return odd_rows() + [(100 + i, t, None, None, 1) for i, t in enumerate(ODD)] + [
        (200 + i, words(i % 30, 60) + draw.choice([" ", "\n", "  ", ""]) + draw.choice(ODD), "en", "a", 1) for i in range(n)
    ]


@pytest.mark.parametrize("most_pairs,shard_pairs", [(2_000_000, 65_536), (6_000, 2_000)])
def test_equals_the_libraries(spark, most_pairs, shard_pairs):
    rows = rows_of()
    made = aligned_documents(documents(spark, rows, clashing=True).repartition(35), most_pairs=most_pairs, shard_pairs=shard_pairs)
    wanted = brute(rows)
    assert got(made, *COLUMNS) == wanted
    assert sum(r[1] for r in wanted) > 10_000 and any(r[1] == 0 and r[0] and r[0] >= 100 for r in wanted)


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op13_pair_hashing(spark, folder), *COLUMNS) == brute(rows)


def test_no_documents_and_no_tokens(spark):
    assert aligned_documents(documents(spark, [])).collect() == []
    assert got(aligned_documents(documents(spark, [(1, None, None, None, None), (2, "▁", None, None, 1)])), *COLUMNS) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**62, n))
    shards = 3
    rows = []
    for s in range(shards):
        levels, held = perfect_hash(keys[shard_of(keys, shards) == s])
        rows.append({"shard": s, "keys": held.astype("<i8").tobytes(), "levels": [np.packbits(x).tobytes() for x in levels], "sizes": [len(x) for x in levels]})
    lookup = Lookup(rows, shards)
    at = lookup.index(keys)
    assert sorted(at.tolist()) == list(range(len(keys))) and (lookup.keys[at] == keys).all()
    if n:
        with pytest.raises(RuntimeError):
            lookup.index(np.array([2**62 + 5]))
        part = Lookup(rows[1:], shards)
        assert ((part.index(keys) < 0) == (shard_of(keys, shards) == 0)).all()

"""Token counts, encoding and packing against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from samples import documents, got, odd_rows, words
from tokenizers import Tokenizer

from seqloom.llm.bpe import json_merges, rank_merges, rank_table
from seqloom.llm.packing import best_fit_decreasing, encoded, lower_bound, pack, pack_documents, sequences
from seqloom.llm.token_counts import count_texts, token_counts
from seqloom.llm.word_shuffle import encode_decode

JSON, RANKS, WORDS = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


def scrambled(n: int) -> list[str]:
    bits = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "1", "é", "ß", "\x1c", "\x85", "　", "😀", "́", "<|endoftext|>", "!!", "the", " the", "\xa0", "²", "​", "Σ", "İ"]
    draw = random.Random(3)
    return ["".join(draw.choices(bits, k=draw.randint(0, 40))) for _ in range(n)] + ["", "a" * 3000, "ab" * 900, "".join(draw.choices("abcdef", k=2000))]


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_table(RANKS), special_tokens={})


def test_counts_are_the_library_s():
    texts = scrambled(2000)
    library = Tokenizer.from_file(JSON)
    assert count_texts(texts, JSON) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("merges", [json_merges(JSON), rank_merges(RANKS)])
def test_long_sequences_merge_alike_in_both_ways(merges):
    word = "".join(random.Random(5).choices("abcdefgh", k=500)).encode()
    assert merges.merged([word])[0].tolist() == merges._by_heap(word)


@pytest.mark.parametrize("clashing", [False, True])
def test_token_counts_of_odd_rows(spark, clashing):
    rows = odd_rows()
    library = Tokenizer.from_file(JSON)
    want = [(r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in rows]
    df = token_counts(documents(spark, rows, clashing))
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert got(df, *df.columns) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [1, 3000, 10**9])
def test_encoding_round_trip(spark, tik, block):
    rows = odd_rows() + [(100 + i, t, None, None, None) for i, t in enumerate(scrambled(200))]
    want = []
    for r in rows:
        ids = tik.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    df = encode_decode(documents(spark, rows, True), block_bytes=block)
    assert got(df, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_encoding_keeps_ids_and_bytes(spark, tik):
    row = encode_decode(documents(spark, [(1, "hello  world\n", None, None, None)]), keep=True).first()
    assert row["ids"] == tik.encode_ordinary("hello  world\n") and bytes(row["decoded"]) == b"hello  world\n"


def test_empty_tables(spark):
    nothing = documents(spark, [])
    assert token_counts(nothing).count() == 0
    assert encode_decode(nothing).count() == 0
    assert pack_documents(nothing).count() == 0


def test_chunks_encode_as_whole_texts():
    texts = [t.replace("<|endoftext|>", "<|EndOfText|>") for t in scrambled(1500)] + scrambled(500)
    library = Tokenizer.from_file(WORDS)
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(texts, WORDS) == want


def test_packing_of_odd_rows(spark):
    rows = odd_rows()
    library = Tokenizer.from_file(WORDS)
    want = []
    for r in rows:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(r[0], k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    packed = pack_documents(documents(spark, rows, True))
    assert got(packed, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    check_places(packed, 4096)


def check_places(packed, capacity):
    held = {}
    for r in packed.collect():
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_sequences_hold_the_ids(spark):
    packed = pack_documents(documents(spark, odd_rows()), keep_ids=True, capacity=256)
    whole = {r["sequence_id"]: r["ids"] for r in sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


def test_rounds_of_exchange_reach_the_bound(spark):
    draw = random.Random(8)
    lengths = [draw.choice((draw.randint(1, 100), draw.randint(30, 70))) for _ in range(4000)] + [100] * 20
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "key bigint, length bigint")
    packed = pack(pieces, capacity=100, items=400)
    assert packed.count() == len(lengths)
    alone = int(best_fit_decreasing(np.array(sorted(lengths, reverse=True)), 100)[0].max()) + 1
    assert lower_bound(np.array(lengths), 100) <= check_places(packed, 100) <= alone * 1.01 + 2
    assert packed.where("bins < bound").count() == 0
    row = packed.first()
    assert row["sequences"] == check_places(packed, 100) and row["least"] == lower_bound(np.array(lengths), 100)


def test_dealing_gives_every_partition_the_same_mix(spark):
    lengths = [51] * 700 + [49] * 700 + [100] * 50 + [30] * 600
    packed = pack(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "key bigint, length bigint").repartition(5), capacity=100, items=150)
    row = packed.first()
    assert check_places(packed, 100) == row["sequences"] == row["least"] == 950
    assert pack(spark.createDataFrame([], "key bigint, length bigint"), capacity=100).count() == 0


def test_bounds_against_exhaustive_packing():
    draw = random.Random(2)

    def fits(items, bins, capacity):
        free = [capacity] * bins

        def place(i):
            if i == len(items):
                return True
            return any(free[b] >= items[i] and (free.__setitem__(b, free[b] - items[i]) or place(i + 1) or free.__setitem__(b, free[b] + items[i])) for b in range(bins))

        return place(0)

    for _ in range(60):
        items = sorted((draw.randint(1, 20) for _ in range(draw.randint(1, 8))), reverse=True)
        least = next(b for b in range(1, 9) if fits(items, b, 20))
        bins, offsets = best_fit_decreasing(np.array(items), 20)
        assert lower_bound(np.array(items), 20) <= least <= bins.max() + 1


def test_lower_bound_sees_halves():
    assert lower_bound(np.array([51] * 10), 100) == 10
    assert lower_bound(np.array([34] * 9), 100) == 5
    assert words(1, 2)

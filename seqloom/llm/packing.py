"""Best-fit packing with bound-certified repacking.

Documents become token ids; only those longer than a sequence are cut. Items (pieces) are dealt to
partitions by their rank in order of length, so that every partition has the same mix of lengths, and each
partition packs its own by best-fit decreasing. Dual feasible functions give a lower bound on the sequences
that a partition's items need, and one for the whole table: the packing is certified when it meets that.
Until then, partitions above their bound put the items of their sequences that are not full into an
exchange, and every other one its emptiest sequence; the exchanged items are dealt anew to fewer
partitions, which pack and certify again. An exchange that needs no fewer sequences than the places its
items had before is not taken, and ends the rounds. Only lengths take part in this; token ids stay in the
table of pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from seqloom.llm.bpe import json_merges
from seqloom.llm.common import WHITE, documents, map_slices, stored, table
from seqloom.operators.splitters import global_ranks

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
#: Items that one partition packs. Its rows are seven numbers each.
ITEMS = 50_000
#: Chunk encodings that a Python worker keeps, then starts anew.
REMEMBERED = 700_000

CHUNK = re.compile(f"[^{WHITE}]+")
SEPARATOR = re.compile("[\x1c-\x1f]")
#: Simple chunks are Latin letters with marks behind them: no normal form changes them, lower case is
#: letter by letter, and the letters and the marks are one pre-token each.
LATIN, MARKS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+"), ".,;:!?"
_seen: dict[str, bytes] = {}
# A task has one core: threads of the library would only compete.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@lru_cache(1)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def chunk_ids(chunks: list[str], path: str) -> dict[str, bytes]:
    """Ids of each chunk. Simple ones are merged together on arrays; the library takes the others."""
    made, number = {}, {}
    simple, of_word, of_marks, other = [], [], [], []
    for chunk in chunks:
        word = chunk.rstrip(MARKS)
        if LATIN.fullmatch(word) is None:
            other.append(chunk)
            continue
        simple.append(chunk)
        of_word.append(number.setdefault(word.lower(), len(number)))
        of_marks.append(number.setdefault(chunk[len(word) :], len(number)) if len(word) < len(chunk) else -1)
    if number:
        symbols, counts = json_merges(path).merged([w.encode() for w in number])
        flat, ends = symbols.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        ids = [flat[a:b] for a, b in zip([0, *ends], ends)]
        ids.append(b"")
        made.update({c: ids[w] + ids[m] for c, w, m in zip(simple, of_word, of_marks)})
    for start in range(0, len(other), 20_000):
        some = other[start : start + 20_000]
        made.update({c: array("I", e.ids).tobytes() for c, e in zip(some, tokenizer(path).encode_batch_fast(some, add_special_tokens=False))})
    return made


def encoded(texts: list[str], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text. The vocabulary drops white space and no token spans it, so
    each distinct chunk between white space is encoded once and the chunks' ids joined."""
    # split() takes the separators \x1c to \x1f for white space, too; the vocabulary does not.
    parts = [CHUNK.findall(t) if SEPARATOR.search(t) else t.split() for t in texts]
    if len(_seen) > REMEMBERED:
        _seen.clear()
    found = [list(map(_seen.get, p)) for p in parts]
    fresh = chunk_ids(list({c for p, ids in zip(parts, found) if None in ids for c, i in zip(p, ids) if i is None}), path)
    _seen.update(fresh)
    return [b"".join([fresh[c] if i is None else i for c, i in zip(p, ids)] if None in ids else ids) for p, ids in zip(parts, found)]


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, a key that no other piece has
    (within this reading of the input), and with `keep_ids` the ids themselves."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["piece int", "start bigint", "length bigint", "ids_crc32 bigint", "key bigint"] + ["ids array<int>"] * keep_ids
    path, end = public_tokenizers.path(vocabulary), np.array([end_id], dtype="<u4").tobytes()
    counts: dict[tuple, int] = {}

    def work(batch):
        context = TaskContext.get()
        task = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        at, out = [], {f.split()[0]: [] for f in fields}
        for row, ids in enumerate(encoded([t or "" for t in batch.column("text").to_pylist()], path)):
            ids += end
            for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[start : start + 4 * capacity]
                at.append(row)
                out["piece"].append(piece)
                out["start"].append(start // 4)
                out["length"].append(len(part) // 4)
                out["ids_crc32"].append(zlib.crc32(part))
                out["key"].append((task[0] << 36) + counts.setdefault(task, 0))
                counts[task] += 1
                if keep_ids:
                    out["ids"].append(np.frombuffer(part, dtype="<u4").astype(np.int32))
        kinds = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
        return {"doc_id": batch.column("doc_id").take(pa.array(at, pa.int64()))} | {n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()}

    return map_slices(documents(docs, "doc_id", "text"), work, ", ".join([f"doc_id {kind}", *fields]))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; `lengths` fall. A bit set of the free spaces there are finds the tightest."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, count = 0, 0
    for i, n in enumerate(lengths.tolist()):
        fits = spaces >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            chosen = free[space].pop()
            if not free[space]:
                spaces ^= 1 << space
        else:
            chosen, space = count, capacity
            count += 1
        bins[i], offsets[i] = chosen, capacity - space
        left = space - n
        if left:
            free[left].append(chosen)
            spaces |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return lower_bound_of(lengths, np.ones(len(lengths), dtype=np.int64), capacity)


def lower_bound_of(lengths: np.ndarray, times: np.ndarray, capacity: int) -> int:
    """Sequences that so many items of these lengths need at least: the largest sum over dual feasible functions.

    Two families: items above capacity - t count as whole sequences and items below t as nothing, for
    every t up to half; and sizes rounded to the k-th part of a sequence, kept where they are exact.
    """
    if not len(lengths):
        return 0
    number = np.zeros(capacity + 1, dtype=np.int64)
    np.add.at(number, lengths, times)
    size = np.arange(capacity + 1)
    count, volume = np.cumsum(number), np.cumsum(number * size)
    t = np.arange(capacity // 2 + 1)
    large = count[-1] - count[capacity - t]
    middle = volume[capacity - t] - np.where(t > 0, volume[np.maximum(t - 1, 0)], 0)
    best = int(np.max(large + -(-middle // capacity)))
    for k in range(1, 101):
        exact = (k + 1) * size % capacity == 0
        # Units of 1 / (k * capacity), so that sums stay whole numbers.
        value = np.where(exact, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((number * value).sum()) // (k * capacity)))
    return best


ITEM = "part bigint, round int, bin bigint, offset bigint, settled boolean, bins bigint, bound bigint"


def packed_round(items: DataFrame, parts: int, number: int, capacity: int) -> DataFrame:
    """One round: deal, pack, certify. Items that are not `settled` may go into an exchange."""

    def pack(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, sort_keys=[("length", "descending"), ("key", "ascending")])
        group = group.take(order)
        lengths = group.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        count, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        kept = fill == capacity
        if count == bound:
            kept |= np.arange(count) != int(np.argmin(fill))
        n = len(bins)
        made = {"round": pa.array(np.full(n, number, dtype=np.int32)), "bin": pa.array(bins), "offset": pa.array(offsets), "settled": pa.array(kept[bins]), "bins": pa.array(np.full(n, count)), "bound": pa.array(np.full(n, bound))}
        for name, column in made.items():
            group = group.append_column(name, column)
        return group.select(names)

    plain = items.select(*(c for c in items.columns if c not in {"part", "round", "bin", "offset", "settled", "bins", "bound", "rank"}))
    names = [*plain.columns, *(f.split()[0] for f in ITEM.split(", "))]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", " + ITEM
    if parts == 1:
        dealt = plain.withColumn("part", F.lit(0).cast("bigint"))
    else:
        dealt = global_ranks(plain, ["length", "key"]).withColumn("part", F.col("rank") % parts).drop("rank")
    return stored(dealt.groupBy("part").applyInArrow(pack, schema))


def pack(pieces: DataFrame, capacity: int = CAPACITY, items: int = ITEMS) -> DataFrame:
    """The pieces (columns key and length at least) with sequence_id and offset; for the round that placed them the
    partition's sequences (`bins`) and lower bound (`bound`); and for the whole table `sequences` and `least`, its
    lower bound: the packing is certified where both are equal, else `sequences - least` is the gap left open.

    Lengths run from 1 to `capacity`. An empty table gives an empty result. Every exchange taken saves at least
    one sequence, so rounds end by themselves.
    """
    # At most `capacity` rows.
    by_length = pieces.groupBy("length").count().collect()
    least = lower_bound_of(np.array([r["length"] for r in by_length], dtype=np.int64), np.array([r["count"] for r in by_length], dtype=np.int64), capacity)
    parts, number, done = max(1, -(-sum(r["count"] for r in by_length) // items)), 0, []
    placed = packed_round(pieces, parts, number, capacity)
    total = sequence_count(placed)
    while total > least and parts > 1:
        waiting = placed.where("not settled")
        parts = max(1, -(-waiting.count() // items))
        number += 1
        again = packed_round(waiting, parts, number, capacity)
        saved = sequence_count(waiting) - sequence_count(again)
        if saved <= 0:
            break
        done.append(placed.where("settled"))
        placed, total = again, total - saved
    for other in done:
        placed = placed.unionByName(other)
    sequence = (F.col("round").cast("bigint") * F.lit(2**58) + F.col("part") * F.lit(2**26) + F.col("bin")).alias("sequence_id")
    both = [F.lit(total).cast("bigint").alias("sequences"), F.lit(least).cast("bigint").alias("least")]
    return placed.select(*pieces.columns, sequence, "offset", "round", "part", "bins", "bound", *both)


def sequence_count(placed: DataFrame) -> int:
    # Every sequence has one item at its start.
    return placed.where("offset = 0").count()


def pack_documents(docs: DataFrame, keep_ids: bool = False, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    A null text counts as empty: one piece that holds the end id only. Repeated rows are packed as
    often as they come. With `keep_ids` the pieces' ids are joined to their places.
    """
    pieces = stored(token_pieces(docs, vocabulary, capacity, keep_ids=keep_ids))
    placed = pack(pieces.drop("ids"), capacity)
    return placed.join(pieces.select("key", "ids"), "key") if keep_ids else placed


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of the whole sequence; `packed` comes from pack_documents(keep_ids=True).
    A group holds at most `capacity` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op5_certified_packing(spark, folder):
    packed = pack_documents(table(spark, folder, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""Alignment of two tokenizers, with corpus-wide counts of linked pairs of ids.

Both tokenizers cut the same bytes. Where a token of each ends, a group ends; tokens whose bytes overlap are
linked. Texts are encoded once, and their ids stored. A text is encoded in segments (a space that follows no
white space starts one): neither tokenizer has tokens across such a place, so a segment's ids are the same
wherever it stands, and tasks encode distinct segments only.

The first pass over the ids collects the distinct linked pairs. They are dealt to shards by hash, and each
shard gets a minimal perfect hash: levels of bits, where a key is placed at the first level at which no
other key left has its bit. Pairs then are numbers from 0 without gaps, and each task of the counting pass
keeps one dense vector; vectors are added up in a tree, FAN at a time. The second pass aligns the documents
again and looks the counts up. Every lookup compares the key kept at its index. Tables are sent to the tasks
for ROUND pairs at most; with more pairs both passes run in as many rounds, and a document's sums are
added up.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from seqloom.llm.common import WHITE, documents, slices, stored, table

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of texts encoded, and bytes of ids aligned, at once; one longer text is a slice of its own.
CHARS, ID_BYTES = 3_000_000, 800_000
#: Encoded segments that a Python worker keeps (those of at most REMEMBERED_CHARS), then starts anew.
REMEMBERED, REMEMBERED_CHARS = 300_000, 48
#: Pairs of a shard, on average; of the tables sent to tasks at once (some 25 bytes each); vectors added at once.
SHARD, ROUND, FAN = 65_536, 2_000_000, 32
#: Bits for each key left at a level, and levels at most: one places about three in five of its keys.
BITS, LEVELS = 2, 64

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class Pair:
    """Both tokenizers, the bytes of their tokens, and the segments encoded so far."""

    def __init__(self, first: str, second: str):
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in piece.lstrip("▁") for piece in pieces):
            raise ValueError("a piece goes across words: segments would not be encoded as whole texts are")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = np.array([len(t) for t in self.bytes_a]), np.array([len(t) for t in self.bytes_b])
        self.space = self.b.piece_to_id("▁")
        #: Kind of array and numpy type that holds any id.
        self.kind, self.type = ("H", np.uint16) if max(len(self.bytes_a), len(pieces)) <= 1 << 16 else ("I", np.uint32)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def encode(self, segments: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both for each segment; None where the bytes of either are not the segment's."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        got = [self.known.get(s, 0) for s in segments]
        fresh = [s for s, g in zip(segments, got) if g == 0]
        made = []
        todo = iter(fresh)
        while part := list(islice(todo, 10_000)):
            one = self.a.encode_batch(part, add_special_tokens=False)
            # The library adds a space to every text but an empty one: a space alone is its own piece.
            two = [y or [self.space] for y in self.b.encode([s[1:] for s in part], num_threads=1)]
            for s, x, y in zip(part, one, two):
                ids, plain = x.ids, s.encode()
                same = b"".join([self.bytes_a[i] for i in ids]) == plain and b"".join([self.bytes_b[i] for i in y]) == plain
                made.append((array(self.kind, ids).tobytes(), array(self.kind, y).tobytes()) if same else None)
                if len(s) <= REMEMBERED_CHARS:
                    self.known[s] = made[-1]
        new = iter(made)
        return [next(new) if g == 0 else g for g in got]


def byte_alphabet() -> dict[str, int]:
    """The public byte alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(1)
def pair(first: str, second: str) -> Pair:
    return Pair(first, second)


SEGMENT = re.compile(f" [^ ]*(?:(?<=[{WHITE}]) [^ ]*)*")


def encoded(docs: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id, and the ids of both tokenizers for each text; none where either changes the text's bytes."""

    def run(batches):
        of = pair(first, second)
        for piece in slices(batches, "text", CHARS):
            number: dict[str, int] = {}
            cut = []
            for text in piece.column("text").to_pylist():
                cut.append([number.setdefault(s, len(number)) for s in SEGMENT.findall(" " + text)] if text else [])
            ids = of.encode(list(number))
            made = []
            for segments in cut:
                found = [ids[s] for s in segments]
                made.append((b"", b"") if None in found else (b"".join([x for x, _ in found]), b"".join([y for _, y in found])))
            columns = [piece.column("doc_id"), pa.array([x for x, _ in made], pa.binary()), pa.array([y for _, y in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a", "b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = documents(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, a binary, b binary")
    # The row tells rows with one id apart.
    return stored(made.withColumn("row", F.monotonically_increasing_id()))


class Aligned:
    """The ids of some documents, aligned: links in order of documents, and where groups end."""

    def __init__(self, piece: pa.RecordBatch, of: Pair):
        one, two = piece.column("a").to_pylist(), piece.column("b").to_pylist()
        self.a = np.frombuffer(b"".join(one), dtype=of.type).astype(np.int64)
        self.b = np.frombuffer(b"".join(two), dtype=of.type).astype(np.int64)
        width = np.dtype(of.type).itemsize
        self.n_a, self.n_b = (np.array([len(x) for x in ids], dtype=np.int64) // width for ids in (one, two))
        size_a = of.size_a[self.a]
        end_a, end_b = np.cumsum(size_a), np.cumsum(of.size_b[self.b])
        low = np.searchsorted(end_b, end_a - size_a, side="right")
        high = np.searchsorted(end_b, end_a, side="left")
        self.cut_a = end_b[high] == end_a if len(end_a) else np.zeros(0, dtype=bool)
        self.cut_b = end_a[np.searchsorted(end_a, end_b, side="left")] == end_b if len(end_b) else np.zeros(0, dtype=bool)
        many = high - low + 1
        before = np.cumsum(many) - many
        left = np.repeat(np.arange(len(many)), many)
        right = np.arange(len(left)) - before[left] + low[left]
        #: Links as one number for each pair of ids, and how many each document has.
        self.keys = self.a[left] << 32 | self.b[right]
        self.n_links = self.by_document(many, self.n_a)

    def by_document(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums of `values`, of which each document has so many."""
        return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[np.cumsum(sizes)], prepend=0)

    def digests(self) -> list[str]:
        """sha256 of each document's groups; empty without tokens."""
        names = label_tables(int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1)
        opens_a = np.concatenate([[True], self.cut_a[:-1]]) if len(self.a) else self.cut_a
        opens_b = np.concatenate([[True], self.cut_b[:-1]]) if len(self.b) else self.cut_b
        group_a, group_b = np.cumsum(opens_a), np.cumsum(opens_b)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        labels = np.concatenate([np.where(opens_a, names[";"][self.a], names[","][self.a]), np.where(opens_b, names["|"][self.b], names[","][self.b])])[order].tolist()
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [hashlib.sha256("".join(labels[s:e])[1:].encode()).hexdigest() if e > s else "" for s, e in zip([0, *ends[:-1]], ends)]


@lru_cache(2)
def label_tables(size: int) -> dict[str, np.ndarray]:
    return {mark: np.array([f"{mark}{i}" for i in range(size)], dtype=object) for mark in ";,|"}


def scattered(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key, other ones for every seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (scattered(keys, LEVELS) % np.uint64(shards)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bits of each level for distinct keys, and the keys in the order of their indices."""
    levels, placed, left = [], [], keys
    while len(left):
        if len(levels) == LEVELS:
            raise RuntimeError("keys are not distinct")
        size = BITS * len(left)
        at = (scattered(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        single = alone[at]
        placed.append(left[single][np.argsort(at[single])])
        left = left[~single]
    return levels, np.concatenate(placed) if placed else keys


class Lookup:
    """Perfect hashes of some shards together: an index from 0 on for each of their keys."""

    def __init__(self, rows: list[dict], shards: int):
        self.shards = shards
        self.keys = np.concatenate([np.frombuffer(r["keys"], dtype="<i8") for r in rows] or [np.zeros(0, dtype=np.int64)])
        #: First index of each shard here, or -1.
        self.first = np.full(shards, -1, dtype=np.int64)
        self.ends: list[int] = []
        depth = max((len(r["levels"]) for r in rows), default=0)
        self.size = np.zeros((depth, shards), dtype=np.int64)
        self.base = np.zeros((depth, shards), dtype=np.int64)
        held, at = [[] for _ in range(depth)], 0
        total = [0] * depth
        for r in rows:
            self.first[r["shard"]] = at
            for level, (packed, size) in enumerate(zip(r["levels"], r["sizes"])):
                bits = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=size).astype(bool)
                slot = np.where(bits, at + np.cumsum(bits) - 1, -1).astype(np.int32)
                at += int(bits.sum())
                self.size[level, r["shard"]], self.base[level, r["shard"]] = size, total[level]
                total[level] += size
                held[level].append(slot)
            self.ends.append(at)
        self.slots = [np.concatenate(h) for h in held]

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 for keys of other shards. A key that its shard does not hold is an error."""
        shard = shard_of(keys, self.shards)
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.flatnonzero(self.first[shard] >= 0)
        for level, slots in enumerate(self.slots):
            if not len(open_):
                break
            size = self.size[level][shard[open_]]
            at = (scattered(keys[open_], level) % np.maximum(size, 1).astype(np.uint64)).astype(np.int64) + self.base[level][shard[open_]]
            out[open_] = np.where(size > 0, slots[np.minimum(at, len(slots) - 1)], -1)
            open_ = open_[out[open_] < 0]
        found = out >= 0
        if len(open_) or (self.keys[out[found]] != keys[found]).any():
            raise RuntimeError("a pair that the first pass did not see")
        return out


_tables: dict[str, tuple] = {}


def worker_table(name: str, rows, shards: int) -> Lookup:
    """The lookup of a broadcast, built once in each Python worker; the one before it is dropped."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = (Lookup(rows(), shards),)
    return _tables[name][0]


def mapped(ids: DataFrame, work, schema: str, first: str, second: str) -> DataFrame:
    """`work` turns each slice's alignment and columns into columns; called with None at the end of a task."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        task = work()
        for piece in slices(batches, "a", ID_BYTES):
            made = task(Aligned(piece, pair(first, second)), piece)
            if made is not None:
                yield pa.RecordBatch.from_arrays([pa.array(made[n]) if not isinstance(made[n], pa.Array) else made[n] for n in names], names)
        last = task(None, None)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(last[n]) for n in names], names)

    return ids.mapInArrow(run, schema)


def distinct_pairs(ids: DataFrame, first: str, second: str) -> DataFrame:
    def work():
        return lambda aligned, piece: {"key": np.unique(aligned.keys)} if aligned else None

    return mapped(ids, work, "key bigint", first, second).distinct()


def hashed(pairs: DataFrame, shards: int) -> DataFrame:
    """shard, keys in order of their index, levels (bits) and their sizes: a perfect hash for each shard."""
    shard = F.pandas_udf(lambda keys: pd.Series(shard_of(keys.to_numpy(), shards)), "bigint")

    def build(group: pa.Table) -> pa.Table:
        levels, keys = perfect_hash(np.sort(group.column("key").to_numpy()))
        return pa.table({
            "shard": pa.array([group.column("shard")[0].as_py()], pa.int64()),
            "keys": pa.array([keys.astype("<i8").tobytes()], pa.binary()),
            "levels": pa.array([[np.packbits(bits).tobytes() for bits in levels]], pa.list_(pa.binary())),
            "sizes": pa.array([[len(bits) for bits in levels]], pa.list_(pa.int32())),
        })

    return pairs.select(shard("key").alias("shard"), "key").groupBy("shard").applyInArrow(build, "shard bigint, keys binary, levels array<binary>, sizes array<int>")


def dense_counts(ids: DataFrame, rows, shards: int, name: str, first: str, second: str) -> DataFrame:
    """shard, part (of the corpus) and counts (64 bits each, by index) of the shards of one round."""

    def work():
        lookup = worker_table(name, lambda: rows.value, shards)
        sums = np.zeros(len(lookup.keys), dtype=np.int64)

        def task(aligned, piece):
            if aligned is not None:
                keys, links = np.unique(aligned.keys, return_counts=True)
                at = lookup.index(keys)
                sums[at[at >= 0]] += links[at >= 0]
                return None
            part = TaskContext.get().partitionId()
            held = [r["shard"] for r in rows.value]
            parts = [sums[s:e] for s, e in zip([0, *lookup.ends[:-1]], lookup.ends)]
            some = [i for i, v in enumerate(parts) if v.any()]
            return {"shard": [held[i] for i in some], "part": [part] * len(some), "counts": [parts[i].tobytes() for i in some]} if some else None

        return task

    return mapped(ids, work, "shard bigint, part bigint, counts binary", first, second)


def tree_summed(vectors: DataFrame, parts: int) -> DataFrame:
    """The sum of each shard's vectors, FAN of them at a time."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py(), dtype=np.int64) for v in group.column("counts"))
        return pa.table({"shard": group.column("shard")[:1], "part": group.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    layout = "shard bigint, part bigint, counts binary"
    while parts > FAN:
        parts = -(-parts // FAN)
        vectors = vectors.withColumn("part", F.floor(F.col("part") / FAN).cast("bigint")).groupBy("shard", "part").applyInArrow(add, layout)
    return vectors.groupBy("shard").applyInArrow(add, layout).select("shard", "counts")


def most_of_second(counts: DataFrame) -> DataFrame:
    """b, most: the highest count of any pair with each id of the second tokenizer."""

    def run(batches):
        for batch in batches:
            keys = np.concatenate([np.frombuffer(k.as_py(), dtype="<i8") for k in batch.column("keys")] or [np.zeros(0, np.int64)]) & 0xFFFFFFFF
            sums = np.concatenate([np.frombuffer(c.as_py(), dtype=np.int64) for c in batch.column("counts")] or [np.zeros(0, np.int64)])
            ids, place = np.unique(keys, return_inverse=True)
            most = np.zeros(len(ids), dtype=np.int64)
            np.maximum.at(most, place, sums)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(most)], ["b", "most"])

    return counts.select("keys", "counts").mapInArrow(run, "b bigint, most bigint").groupBy("b").agg(F.max("most").alias("most"))


RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def looked_up(ids: DataFrame, rows, best, shards: int, name: str, first: str, second: str, digests: bool) -> DataFrame:
    """row, doc_id and the columns of RESULT; n_best and count_sum over the links of this round's pairs."""
    kind = ids.schema["doc_id"].dataType.simpleString()

    def work():
        lookup = worker_table(name, lambda: rows.value, shards)
        counts = np.concatenate([np.frombuffer(r["counts"], dtype=np.int64) for r in rows.value] or [np.zeros(0, np.int64)])
        most = best.value

        def task(aligned, piece):
            if aligned is None:
                return None
            keys, place = np.unique(aligned.keys, return_inverse=True)
            at = lookup.index(keys)
            held = np.where(at >= 0, counts[np.maximum(at, 0)] if len(counts) else 0, 0)
            top = (at >= 0) & (held == most[keys & 0xFFFFFFFF])
            return {
                "row": piece.column("row"), "doc_id": piece.column("doc_id"), "n_a": aligned.n_a, "n_b": aligned.n_b,
                "n_groups": aligned.by_document(aligned.cut_a, aligned.n_a), "n_links": aligned.n_links,
                "n_best": aligned.by_document(top[place], aligned.n_links),
                "count_sum": aligned.by_document(held[place], aligned.n_links),
                "groups_sha256": aligned.digests() if digests else pa.nulls(piece.num_rows, pa.string()),
            }

        return task

    return mapped(ids, work, f"row bigint, doc_id {kind}, {RESULT}", first, second)


def aligned_documents(docs: DataFrame, first: str = FIRST, second: str = SECOND, most_pairs: int = ROUND, shard_pairs: int = SHARD) -> DataFrame:
    """doc_id and the columns of RESULT for every row of `docs`.

    Null and empty texts, and those whose bytes a tokenizer changes, have no tokens: zeros and an empty
    digest. Repeated rows give repeated results and count as often in the corpus; a null id stays null. Texts are
    read whole; one longer than CHARS is a slice of its own. Without documents the result is empty; columns of
    other names are left out.
    """
    spark = docs.sparkSession
    first, second = public_tokenizers.path(first), public_tokenizers.path(second)
    ids = encoded(docs, first, second)
    pairs = stored(distinct_pairs(ids, first, second))
    n = pairs.count()
    shards = max(1, -(-n // shard_pairs))
    functions = stored(hashed(pairs, shards))
    # Shards in rounds of at most `most_pairs` pairs (or one shard), by their sizes.
    sizes = sorted((r["shard"], r["n"]) for r in functions.select("shard", (F.length("keys") / 8).cast("bigint").alias("n")).collect())
    rounds: list[list[int]] = [[]]
    held = 0
    for shard, size in sizes:
        if rounds[-1] and held + size > most_pairs:
            rounds.append([])
            held = 0
        rounds[-1].append(shard)
        held += size
    parts = (ids.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0] or 0) + 1
    counted = []
    for k, members in enumerate(rounds):
        rows = spark.sparkContext.broadcast([r.asDict() for r in functions.where(F.col("shard").isin(members)).orderBy("shard").collect()])
        vectors = dense_counts(ids, rows, shards, f"{id(rows)}-count-{k}", first, second)
        counted.append(stored(tree_summed(vectors, parts)))
        rows.unpersist()
    sums = counted[0]
    for other in counted[1:]:
        sums = sums.unionByName(other)
    counts = stored(functions.join(sums, "shard"))
    # At most as many rows as the second tokenizer has ids.
    most = np.zeros(sentencepiece.SentencePieceProcessor(model_file=second).get_piece_size(), dtype=np.int64)
    for r in most_of_second(counts).collect():
        most[r["b"]] = r["most"]
    best = spark.sparkContext.broadcast(most)
    results = []
    for k, members in enumerate(rounds):
        rows = spark.sparkContext.broadcast([r.asDict() for r in counts.where(F.col("shard").isin(members)).orderBy("shard").collect()])
        results.append(looked_up(ids, rows, best, shards, f"{id(rows)}-look-{k}", first, second, digests=k == 0))
        if len(rounds) > 1:
            results[-1] = stored(results[-1])
            rows.unpersist()
    names = [c.split()[0] for c in RESULT.split(", ")]
    if len(rounds) == 1:
        return results[0].select("doc_id", *names)
    both = results[0].select("row", "n_best", "count_sum")
    for other in results[1:]:
        both = both.unionAll(other.select("row", "n_best", "count_sum"))
    added = both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return results[0].drop("n_best", "count_sum").join(added, "row").select("doc_id", *names)


def op13_pair_hashing(spark, folder):
    return aligned_documents(table(spark, folder, "documents"))

"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

1. Documents fall into blocks. A block's pre-tokens are exploded into its distinct words and, per document,
   the positions they stand at (as numbers of the block's words).
2. Distinct words travel to hash buckets, as one packed row for each block and bucket. A word sits in each
   block at most once and in one bucket only, so a frequent word adds no more rows than a rare one. Each
   bucket encodes each of its distinct words once.
3. Ids travel back to their block and are put together by position; decoding looks each id up in the
   token-byte table (one row per token of the vocabulary, so its size is fixed).

The first step runs once for words and once for positions, from the same partitions of the input; a block's
name holds its partition and a digest of its documents, and step 3 raises if words and positions of a
block do not meet (an input that changes its order between reads must be written first).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from seqloom.llm.bpe import CHUNK, Merges, pretokens, rank_merges, rank_table, utf8
from seqloom.llm.common import documents, slices, table

RANKS = "byte_bpe_50k.tiktoken"
#: Text of one block, in bytes; a longer document is a block of its own.
BLOCK_BYTES = 24_000_000


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def packed_words(words: list[bytes]) -> bytes:
    lengths = packed(np.array([len(w) for w in words]))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def unpacked_words(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:4], "little")
    ends = np.cumsum(unpacked(blob[4 : 4 + n])).tolist()
    flat = zstandard.ZstdDecompressor().decompress(blob[4 + n :])
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start .. start + length - 1 of all rows, on end."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


class Block:
    """Documents of one block: chunk numbers of each, and the chunks' numbering."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.codes, self.bytes = [], [], 0
        self.digest = xxhash.xxh64()

    def add(self, doc_id, text: str) -> None:
        number = self.number
        found = CHUNK.findall(text)
        self.codes.append(np.fromiter((number.setdefault(c, len(number)) for c in found), dtype=np.int32, count=len(found)))
        self.ids.append(doc_id)
        self.bytes += len(text)
        self.digest.update(f"{doc_id}:{len(text)};".encode())

    def words(self, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words by bucket and bytes; the bucket of each; and each chunk's words, as starts in a flat list and that list."""
        split = [pretokens(c) for c in self.number]
        number: dict[str, int] = {}
        flat = np.array([number.setdefault(w, len(number)) for ws in split for w in ws], dtype=np.int64)
        sizes = np.array([len(ws) for ws in split], dtype=np.int64)
        words = [utf8(w) for w in number]
        bucket = np.array([xxhash.xxh32_intdigest(w) % buckets for w in words], dtype=np.int64)
        order = np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        place = np.empty(len(words), dtype=np.int64)
        place[order] = np.arange(len(words))
        return [words[i] for i in order], bucket[order], np.r_[0, np.cumsum(sizes)], place[flat] if len(flat) else flat


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, Block]]:
    context, block, count = TaskContext.get(), Block(), 0

    def name() -> int:
        key = f"{context.partitionId() if context else 0}:{count}:{block.digest.intdigest()}"
        return xxhash.xxh64_intdigest(key) - 2**63

    for piece in slices(batches, chars=4_000_000):
        for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
            text = text or ""
            if block.ids and block.bytes + len(text) > size:
                yield name(), block
                block, count = Block(), count + 1
            block.add(doc_id, text)
    if block.ids:
        yield name(), block


FIELDS = "block bigint, bucket int, content binary, ids binary"


def rows(of: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in of], k) for i, k in enumerate(kinds)], ["block", "bucket", "content", "ids"])


def word_rows(docs: DataFrame, buckets: int, size: int) -> DataFrame:
    """A row for each block and bucket: the distinct words."""

    def run(batches):
        for name, block in blocks(batches, size):
            words, bucket, _, _ = block.words(buckets)
            ends = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
            yield rows([(name, b, packed_words(words[i:j]), None) for b, (i, j) in enumerate(zip(ends, ends[1:])) if j > i])

    return docs.mapInArrow(run, FIELDS)


def position_rows(docs: DataFrame, buckets: int, size: int) -> DataFrame:
    """A row for each block: which word stands at each position of its documents. Words are renumbered
    by frequency, which packs better; the row holds that order, too."""

    def run(batches):
        for name, block in blocks(batches, size):
            words, _, starts, flat = block.words(buckets)
            code = np.concatenate(block.codes)
            lengths = np.diff(starts)[code]
            at = flat[ragged(starts[code], lengths)]
            by_count = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), dtype=np.int64)
            rank[by_count] = np.arange(len(words))
            of_doc = np.array([len(c) for c in block.codes])
            sums = np.r_[0, np.cumsum(lengths)]
            ends = np.cumsum(of_doc)
            per_doc = sums[ends] - sums[ends - of_doc]
            parts = [packed(rank[at]), packed(by_count), packed(per_doc)]
            content = b"".join(len(p).to_bytes(8, "little") + p for p in parts)
            # Bucket -1 sorts in front: a block's positions come before its ids.
            yield rows([(name, -1, content, _ids(block.ids))])

    return docs.mapInArrow(run, FIELDS)


def _ids(ids: list) -> bytes:
    """Document ids (null allowed) as one Arrow column in a stream."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(ids)], ["doc_id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def encoded_rows(words: DataFrame, buckets: int, ranks: str) -> DataFrame:
    """Each bucket in one task: every distinct word is encoded when it is first seen there."""

    def run(batches):
        merges: Merges = rank_merges(public_tokenizers.path(ranks))
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for row in batch.to_pylist():
                words = unpacked_words(row["content"])
                if fresh := [w for w in words if w not in known]:
                    symbols, counts = merges.merged(fresh)
                    flat, ends = symbols.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
                    known.update({w: flat[a:b] for w, a, b in zip(fresh, [0, *ends], ends)})
                coded = list(map(known.__getitem__, words))
                counts, flat = packed(np.array([len(c) // 4 for c in coded])), packed(np.frombuffer(b"".join(coded), dtype="<u4"))
                yield rows([(row["block"], row["bucket"], counts, flat)])

    return words.repartition(buckets, "bucket").mapInArrow(run, FIELDS)


def assembled(parts: list[dict]) -> Iterator[tuple]:
    """Documents of one block from its rows, positions first: id and token ids."""
    head, coded = parts[0], parts[1:]
    if head["bucket"] != -1:
        raise ValueError("words without their documents: the input changed its order between two reads; write it first")
    content, sections = head["content"], []
    while content:
        n = int.from_bytes(content[:8], "little")
        sections.append(unpacked(content[8 : 8 + n]).astype(np.int64))
        content = content[8 + n :]
    at, by_count, per_doc = sections
    counts = np.concatenate([unpacked(r["content"]) for r in coded]).astype(np.int64) if coded else np.zeros(0, dtype=np.int64)
    if len(counts) != len(by_count):
        raise ValueError("documents without their words: the input changed its order between two reads; write it first")
    tokens = np.concatenate([unpacked(r["ids"]) for r in coded]) if coded else np.zeros(0, dtype="<u4")
    starts = np.cumsum(counts) - counts
    ids = pa.ipc.open_stream(head["ids"]).read_all().column(0).to_pylist()
    ends = np.cumsum(per_doc)
    for doc_id, a, b in zip(ids, (ends - per_doc).tolist(), ends.tolist()):
        words = by_count[at[a:b]]
        yield doc_id, tokens[ragged(starts[words], counts[words])]


def encode_decode(docs: DataFrame, ranks: str = RANKS, block_bytes: int = BLOCK_BYTES, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; with `keep` also ids and decoded.

    A null text counts as empty: no tokens, digests of nothing. Repeated rows give repeated results.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = documents(docs, "doc_id", "text")
    every = position_rows(docs, buckets, block_bytes).unionAll(encoded_rows(word_rows(docs, buckets, block_bytes), buckets, ranks))
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded binary" * keep

    def run(batches):
        spelled = {i: t for t, i in rank_table(public_tokenizers.path(ranks)).items()}
        names = [f.split()[0] for f in schema.split(", ")]
        into = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())

        def finish(parts):
            out = []
            for doc_id, ids in assembled(parts):
                decoded = b"".join(map(spelled.__getitem__, ids.tolist()))
                out.append((doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest(), *((ids.tolist(), decoded) if keep else ())))
            kinds = [into, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))], names)

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["block"] != row["block"]:
                    yield finish(held)
                    held = []
                held.append(row)
        if held:
            yield finish(held)

    return every.repartition(buckets, "block").sortWithinPartitions("block", "bucket").mapInArrow(run, schema)


def op10_word_shuffle_bpe(spark, folder):
    return encode_decode(table(spark, folder, "documents"))

"""Token counts: rank-synchronous array merging.

Pre-tokens of a batch are held as ragged numpy arrays; each sequence applies its lowest-rank pair in the
same step as all others, and the symbols that survive are counted. Nothing is shuffled, and each text is
counted in the partition that read it.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.bpe import CHUNK, json_merges, pretokens, utf8
from seqloom.llm.common import documents, map_slices, table

VOCABULARY = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
LIMIT = 512
#: Counts of chunks seen before stay with the Python worker up to this many, then start anew.
REMEMBERED = 600_000

_seen: dict[tuple, dict[str, int]] = {}


def chunk_counts(chunks: set[str], path: str) -> dict[str, int]:
    """Tokens of each chunk: its pre-tokens are merged together with those of all others."""
    merges = json_merges(path)
    split = [(c, pretokens(c)) for c in chunks]
    number: dict[str, int] = {}
    for _, words in split:
        for w in words:
            number.setdefault(w, len(number))
    if not number:
        return {c: 0 for c in chunks}
    counts = merges.merged([utf8(w) for w in number])[1].tolist()
    return {c: sum(counts[number[w]] for w in words) for c, words in split}


def count_texts(texts: list[str], path: str, special: str = SPECIAL) -> list[int]:
    """Tokens of each text; a special string inside a text is one token, as the library has it by default."""
    seen = _seen.setdefault((path, special), {})
    cut = re.compile(f"({re.escape(special)})")
    parts = [[[p] if p == special else CHUNK.findall(p) for p in cut.split(t)] if special in t else [CHUNK.findall(t)] for t in texts]
    if len(seen) > REMEMBERED:
        seen.clear()
    seen[special] = 1
    fresh = set().union(*(p for text in parts for p in text)) - seen.keys()
    if fresh:
        seen.update(chunk_counts(fresh, path))
    return [sum(sum(map(seen.__getitem__, p)) for p in text) for text in parts]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every text.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated results.
    """

    def work(batch):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        counts = np.array(count_texts(texts, public_tokenizers.path(vocabulary)), dtype=np.int64)
        return {"doc_id": batch.column("doc_id"), "n_bytes": np.array([len(utf8(t)) for t in texts], dtype=np.int64), "n_tokens": counts}

    ids = docs.schema["doc_id"].dataType.simpleString()
    counted = map_slices(documents(docs, "doc_id", "text"), work, f"doc_id {ids}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, folder):
    return token_counts(table(spark, folder, "documents"))

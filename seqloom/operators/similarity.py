"""K-mer similarity of query sequences to a reference set: exact maxima and nearest neighbours.

Both sides are dealt by a hash of the id to parts of bounded letters, and each part is packed into one row. A task
takes a part of the queries and a run of parts of the references, one after the other, counts the k-mers of all pairs
of each two and gives out the few best references of each query. No pair and no list of k-mers leaves a task, and no
sequence is shuffled more than once: the parts meet in a product of packed rows, which a task reads again for every
part of the queries. What it writes are a few rows for each query and run, and the runs are at most RUNS where a run of
MOST parts reaches.

1. K-mers that many texts on both sides hold are counted first, by a product of 0/1 matrices.
2. The others are counted text by text from their lists.

Both are the same for every size of either side. All documents against all documents remain quadratic in
time; a task's memory is bounded by its two parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from seqloom.functions.hashing import digest
from seqloom.session import stored

#: Share of a part's texts, on both sides, from which a k-mer is counted by the matrix product.
FIRST_SHARE = 0.04
#: Sequences and letters of a part.
PER_PART = 4096
LETTERS_PER_PART = 4_000_000
#: Runs of the references' parts, tasks that a product has at least where parts allow it, and parts of a run at most.
RUNS, TASKS, MOST = 16, 64, 16
#: K-mers of one matrix product, pairs counted from lists at a time, and queries ranked at a time.
COLUMNS = 1024
PAIRS = 2_000_000
ROWS = 256
#: Codes are numbered afresh where they would pass this.
CODES = 1 << 40


def distinct_sequences(df: DataFrame, row_id: str, seq: str) -> DataFrame:
    """Every distinct sequence once, under its first row id: (first_id, digest, sequence)."""
    return df.groupBy(digest(seq).alias("digest")).agg(
        F.min(row_id).alias("first_id"), F.any_value(seq).alias("sequence")
    ).select("first_id", "digest", "sequence")


def flag_novel(df: DataFrame, known: DataFrame, seq: str = "sequence", known_seq: str = "sequence") -> DataFrame:
    """Append `novel_exact`: the sequence is not byte-identical to any known one."""
    keys = known.select(digest(known_seq).alias("_digest")).distinct().withColumn("_known", F.lit(True))
    return (
        df.withColumn("_digest", digest(seq))
        .join(keys, "_digest", "left")
        .withColumn("novel_exact", F.col("_known").isNull())
        .drop("_digest", "_known")
    )


def novel_only(df: DataFrame, known: DataFrame, seq: str = "sequence", known_seq: str = "sequence") -> DataFrame:
    keys = known.select(digest(known_seq).alias("_digest"))
    return df.withColumn("_digest", digest(seq)).join(keys, "_digest", "left_anti").drop("_digest")


def known_only(df: DataFrame, known: DataFrame, seq: str = "sequence", known_seq: str = "sequence") -> DataFrame:
    keys = known.select(digest(known_seq).alias("_digest"))
    return df.withColumn("_digest", digest(seq)).join(keys, "_digest", "left_semi").drop("_digest")


def _distinct_kmers(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, number of its text) of every distinct k-mer of every text, by code; texts hold at least k letters."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    number = np.zeros(int(points.max()) + 1, np.int32)
    number[points] = 1
    size = int(number.sum())
    letters = (np.cumsum(number, dtype=np.int32) - 1)[points]
    n, space = len(letters) - k + 1, 1
    code = np.zeros(n, np.int64)
    for at in range(k):
        if space * size > CODES:
            known, code = np.unique(code, return_inverse=True)
            space = len(known)
        code, space = code * size + letters[at:at + n], space * size
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    inside = owner[:n] == owner[k - 1:]
    held = np.sort(code[inside] * len(texts) + owner[:n][inside])
    return np.divmod(held[np.r_[True, held[1:] != held[:-1]]], len(texts))


def _shared_kmers(code: np.ndarray, owner: np.ndarray, n_query: int, n_ref: int, share: float) -> np.ndarray:
    """Matrix of the k-mers that each of the first n_query texts shares with each of the others."""
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    sizes = np.diff(np.r_[first, len(code)])
    asking = np.add.reduceat(owner < n_query, first, dtype=np.int64)
    holding = sizes - asking
    common = asking * holding >= max(1, share * share * n_query * n_ref)
    shared = np.zeros((n_query, n_ref), np.float32)

    column = np.repeat(np.where(common, np.cumsum(common) - 1, -1), sizes)
    texts, column = owner[column >= 0], column[column >= 0]
    for low in range(0, int(common.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        held = np.zeros((n_query + n_ref, COLUMNS), np.float32)
        held[texts[a:b], column[a:b] - low] = 1
        shared += held[:n_query] @ held[n_query:].T

    # A k-mer's queries stand before its references; every query meets the list of each of its k-mers.
    rare = np.repeat((asking > 0) & (holding > 0) & ~common, sizes) & (owner < n_query)
    asked = np.flatnonzero(rare)
    asked = asked[np.argsort(owner[asked], kind="stable")]
    group = np.searchsorted(first, asked, side="right") - 1
    length, start = holding[group], (first + asking)[group]
    upto = np.cumsum(length)
    cells, at = shared.reshape(-1), 0
    while at < len(asked):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        many = length[at:end]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        refs = owner[np.repeat(start[at:end], many) + inside] - n_query
        np.add.at(cells, np.repeat(owner[asked[at:end]] * n_ref, many) + refs, np.float32(1))
        at = end
    return shared


def _best_references(k: int, n: int, exclude_identical: bool, share: float):
    def best(queries: pa.Table, references: pa.Table) -> pa.Table:
        if not queries.num_rows or not references.num_rows:
            queries, references = queries.slice(0, 0), references.slice(0, 0)
            rows = refs = counts = n_of = np.zeros(0, np.int64)
            return _rows(queries, references, rows, refs, counts, n_of, n_of)
        references = references.sort_by("ref_id")
        asking, known = queries["sequence"].to_pylist(), references["sequence"].to_pylist()
        code, owner = _distinct_kmers(asking + known, k)
        sizes = np.bincount(owner, minlength=len(asking) + len(known))
        shared = _shared_kmers(code, owner, len(asking), len(known), share)
        if exclude_identical:
            place = {text: i for i, text in enumerate(known)}
            for i, text in enumerate(asking):
                if text in place:
                    shared[i, place[text]] = 0
        found = []
        for low in range(0, len(asking), ROWS):
            count = shared[low:low + ROWS]
            row = np.arange(len(count))
            n_query = sizes[low:low + len(count), None]
            picked = [(count / (n_query + sizes[len(asking):] - count)).argmax(1)]
            count = count.copy()
            # The first of equal counts is the smallest id.
            for _ in range(min(n, len(known))):
                picked.append(count.argmax(1))
                count[row, picked[-1]] = -1
            found.append(np.unique(np.concatenate([(row + low) * len(known) + p for p in picked])))
        cells = np.concatenate(found)
        cells = cells[shared.reshape(-1)[cells] > 0]
        rows, refs = np.divmod(cells, len(known))
        return _rows(queries, references, rows, refs, shared.reshape(-1)[cells], sizes[rows], sizes[len(asking) + refs])

    def _rows(queries, references, rows, refs, shared, n_query, n_ref) -> pa.Table:
        return pa.table({
            "query_id": queries["query_id"].take(pa.array(rows)), "ref_id": references["ref_id"].take(pa.array(refs)),
            "n_query": pa.array(n_query.astype(np.int32)), "n_ref": pa.array(n_ref.astype(np.int32)),
            "shared": pa.array(shared.astype(np.int64)),
        })

    return best


def _dealt(distinct: DataFrame, name: str, k: int) -> tuple[DataFrame, int]:
    """(id, sequence, part) of the sequences that have k-mers, and the number of parts."""
    held = stored(distinct.where(F.length("sequence") >= k).select(F.col("first_id").alias(f"{name}_id"), "sequence"))
    size = held.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("letters")).first()
    parts = max(1, -(-size["n"] // PER_PART), -(-size["letters"] // LETTERS_PER_PART))
    return held.withColumn(f"{name}_part", F.pmod(F.xxhash64(f"{name}_id"), F.lit(parts)).cast("int")), parts


def _packed(dealt: DataFrame, name: str, runs: int) -> DataFrame:
    """(run, part, ids, texts), a row for each part, dealt to its run by number, so that no two runs meet in one task."""
    run, part = f"{name}_run", f"{name}_part"
    numbered = dealt.withColumn(run, F.pmod(F.col(part), F.lit(runs))).repartitionById(runs, F.col(run))
    packs = numbered.groupBy(run, part).agg(F.collect_list(F.struct(f"{name}_id", "sequence")).alias("_rows"))
    return packs.select(run, part, F.col(f"_rows.{name}_id").alias(f"{name}_ids"), F.col("_rows.sequence").alias(f"{name}_texts"))


def _runs(q_parts: int, r_parts: int) -> int:
    """How many runs the references' parts are dealt to."""
    return min(r_parts, max(RUNS, -(-TASKS // q_parts), -(-r_parts // MOST)))


def _met(q: DataFrame, q_parts: int, r: DataFrame, r_parts: int, k: int, n: int, exclude_identical: bool) -> DataFrame:
    """(query_id, ref_id, n_query, n_ref, shared) of the n best references by count and the best by Jaccard that each
    query meets in each run of the references' parts."""
    asking, known = _packed(q, "query", q_parts), _packed(r, "ref", _runs(q_parts, r_parts))
    schema = StructType([
        StructField("query_id", q.schema["query_id"].dataType), StructField("ref_id", r.schema["ref_id"].dataType),
        StructField("n_query", IntegerType()), StructField("n_ref", IntegerType()), StructField("shared", LongType()),
    ])
    best = _best_references(k, n, exclude_identical, FIRST_SHARE)

    def run(batches):
        part, found = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                queries, references = (
                    pa.table({f"{name}_id": batch.column(f"{name}_ids")[i].values, "sequence": batch.column(f"{name}_texts")[i].values})
                    for name in ("query", "ref")
                )
                now = batch.column("query_part")[i].as_py()
                if found is not None and now != part:
                    yield from found.to_batches()
                    found = None
                rows = best(queries, references)
                part, found = now, rows if found is None else _kept(pa.concat_tables([found, rows]), n)
        if found is not None:
            yield from found.to_batches()

    # A product of partitions, which are read again as often as they are met, not shuffled.
    return asking.crossJoin(known.hint("shuffle_replicate_nl")).mapInArrow(run, schema)


def _kept(rows: pa.Table, n: int) -> pa.Table:
    """The n best references by count, the smallest ids of equal ones, and the best by Jaccard of each query."""
    if not rows.num_rows:
        return rows
    rows = rows.sort_by([("query_id", "ascending"), ("shared", "descending"), ("ref_id", "ascending")]).combine_chunks()
    of = rows.column("query_id").dictionary_encode(null_encoding="encode").combine_chunks().indices.to_numpy()
    shared, n_query, n_ref = (rows.column(name).to_numpy().astype(float) for name in ("shared", "n_query", "n_ref"))
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    place = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
    jaccard = shared / (n_query + n_ref - shared)
    order = np.lexsort((place, -jaccard, of))
    keep = place < n
    keep[order[np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])]] = True
    return rows.take(pa.array(np.flatnonzero(keep)))


def overlaps(
    queries: DataFrame, references: DataFrame, k: int, n: int = 1, exclude_identical: bool = False,
) -> DataFrame:
    """(query_id, ref_id, n_query, n_ref, shared) over distinct sequences (first_id, digest, sequence).

    Holds, for every query, the n references that share most k-mers with it, the smallest ids of equal ones,
    and its best one by Jaccard; further pairs are present, always with their exact overlap. Sequences shorter
    than k and pairs without a common k-mer are not in it.
    """
    q, q_parts = _dealt(queries, "query", k)
    r, r_parts = _dealt(references, "ref", k)
    return _met(q, q_parts, r, r_parts, k, n, exclude_identical)


def max_similarity(
    df: DataFrame, known: DataFrame, row_id: str, seq: str = "sequence", known_id: str = "known_id",
    known_seq: str = "sequence", k: int = 6,
) -> DataFrame:
    """(row id, length, max_containment, max_jaccard) against the closest known sequence by each
    measure; 0 without any common k-mer, NULL for a sequence shorter than k."""
    queries = distinct_sequences(df, row_id, seq)
    pairs = overlaps(queries, distinct_sequences(known, known_id, known_seq), k)
    shared = F.col("shared")
    best = pairs.groupBy("query_id").agg(
        F.max(shared / F.col("n_query")).alias("_containment"),
        F.max(shared / (F.col("n_query") + F.col("n_ref") - shared)).alias("_jaccard"),
    )
    scored = queries.select(F.col("first_id").alias("query_id"), F.col("digest").alias("_digest")).join(
        best, "query_id", "left"
    )
    has_kmers = F.col("length") >= k
    return (
        df.select(row_id, F.length(seq).alias("length"), digest(seq).alias("_digest"))
        .join(scored.drop("query_id"), "_digest")
        .select(
            row_id,
            "length",
            F.when(has_kmers, F.coalesce("_containment", F.lit(0.0))).alias("max_containment"),
            F.when(has_kmers, F.coalesce("_jaccard", F.lit(0.0))).alias("max_jaccard"),
        )
    )


def nearest_neighbours(
    df: DataFrame, known: DataFrame, row_id: str, seq: str = "sequence", known_id: str = "known_id",
    known_seq: str = "sequence", k: int = 6, n: int = 2,
) -> DataFrame:
    """(row id, neighbour, ref_id, containment): the n distinct known sequences with the largest
    containment, other than the sequence itself; ties keep the known set's order."""
    queries = distinct_sequences(df, row_id, seq)
    references = distinct_sequences(known, known_id, known_seq)
    pairs = overlaps(queries, references, k, n=n, exclude_identical=True)
    order = Window.partitionBy("query_id").orderBy(F.desc("shared"), "ref_id")
    ranked = pairs.withColumn("neighbour", F.row_number().over(order)).where(F.col("neighbour") <= n)
    keys = queries.select(F.col("first_id").alias("query_id"), F.col("digest").alias("_digest"))
    return (
        df.select(row_id, digest(seq).alias("_digest"))
        .join(keys, "_digest")
        .join(ranked, "query_id")
        .select(row_id, "neighbour", "ref_id", (F.col("shared") / F.col("n_query")).alias("containment"))
    )


def novelty_report(
    df: DataFrame, known: DataFrame, row_id: str, seq: str = "sequence", known_id: str = "known_id",
    known_seq: str = "sequence", k: int = 6,
) -> DataFrame:
    """Length, exact novelty and both k-mer maxima per row."""
    flags = flag_novel(df.select(row_id, seq), known, seq, known_seq).select(row_id, "novel_exact")
    scores = max_similarity(df, known, row_id, seq, known_id, known_seq, k)
    return flags.join(scores, row_id).select(
        row_id, "length", "novel_exact",
        F.col("max_jaccard").alias(f"max_jaccard_k{k}"), F.col("max_containment").alias(f"max_containment_k{k}"),
    )

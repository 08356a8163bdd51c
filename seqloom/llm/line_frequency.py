"""Quality rules: cross-document line frequency.

Every line is normalised (A-Z to lower case, digits to 0, white space to single blanks) and hashed. For each host (`source`) and
line the distinct documents that hold it are counted; lines above the host's limit are removed, and a
document that keeps too few of its words is rejected. The limit is a share of the host's documents, so
it means the same at every size. Texts and lines travel as 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.common import BLANKS, map_slices, runs, stored, table

#: A line is removed when more distinct documents of its host hold it than this share of them, and than this number.
SHARE, LEAST = 0.10, 5
#: A line in more documents of a host than this is above the limit however large the host is.
CEILING = 1000
#: A document is depleted when fewer words than this are left, or a smaller share of its words.
WORDS_LEFT, SHARE_LEFT = 10, 0.3
#: Limits of the base rules.
BASE_WORDS, BASE_REPEATS, WINDOW = 10, 20, 5

SYMBOLS = "#*$%&|<>"
FOLDED = bytes(c + 32 if 65 <= c <= 90 else 48 if 49 <= c <= 57 else c for c in range(256))


def signed(n: int) -> int:
    return n - 2**64 if n >= 2**63 else n


def normal(line: bytes) -> bytes:
    return b" ".join(line.split()).translate(FOLDED)


def line_hash(line: str) -> int | None:
    """Hash of a normalised line; None for one without a word, which is never removed."""
    key = normal(line.encode("utf-8", "surrogatepass"))
    return signed(xxhash.xxh64_intdigest(key)) if key else None


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """For each text, its words inside 5-word windows that the text holds twice or more."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    total = int(sizes.sum())
    if total < WINDOW:
        return np.zeros(len(words), dtype=np.int64)
    code = np.fromiter((hash(w) for text in words for w in text), dtype=np.int64, count=total).view(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    with np.errstate(over="ignore"):
        key = np.zeros(total - WINDOW + 1, dtype=np.uint64)
        for k in range(WINDOW):
            key = (key ^ code[k : total - WINDOW + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        key = (key ^ owner[: len(key)].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    whole = np.flatnonzero(owner[: len(key)] == owner[WINDOW - 1 :])
    order = whole[np.argsort(key[whole])]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, order[twice], 1)
    np.add.at(edge, order[twice] + WINDOW, -1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=len(words))


def measured_texts(texts: list[str | None]) -> dict[str, list]:
    """Base measures of each text, its distinct normalised lines as hashes and the words each takes up."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hashes", "line_words"]
    out: dict[str, list] = {n: [] for n in names}
    words = []
    for text in texts:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        own = raw.split()
        words.append(own)
        filled = [line for line in raw.split(b"\n") if line and not line.isspace()]
        sizes: dict[bytes, int] = {}
        for line in filled:
            key = normal(line)
            sizes[key] = sizes.get(key, 0) + key.count(b" ") + 1
        out["n_words"].append(len(own))
        out["word_chars"].append(len(text) - sum(map(text.count, BLANKS)))
        out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        out["n_dup_lines"].append(len(filled) - len(set(filled)))
        out["line_hashes"].append([signed(xxhash.xxh64_intdigest(k)) for k in sizes])
        out["line_words"].append(list(sizes.values()))
    out["n_repeat_words"] = repeated_words(words).tolist()
    return out


def keys(docs: DataFrame) -> list:
    """Hashes of a document's host (null is a host of its own) and text (null reads as empty)."""
    return [F.xxhash64(docs["source"].isNull(), docs["source"]).alias("host"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("digest")]


def measured(docs: DataFrame) -> DataFrame:
    """Base measures of each document, the hashes of its text and host, and its distinct normalised lines
    as hashes with the words each takes up."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, host bigint, digest bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, line_hashes array<bigint>, line_words array<int>"

    def work(batch):
        out = measured_texts(batch.column("text").to_pylist())
        kinds = {"line_hashes": pa.list_(pa.int64()), "line_words": pa.list_(pa.int32())}
        return {n: batch.column(n) for n in ("doc_id", "host", "digest")} | {n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()}

    return map_slices(docs.select(docs["doc_id"], docs["text"], *keys(docs)), work, schema)


def frequent_lines(measures: DataFrame, share: float = SHARE, least: int = LEAST, ceiling: int = CEILING) -> DataFrame:
    """host, line: the lines above their host's limit. Documents with the same text count once."""
    lines = measures.select("host", "digest", F.explode("line_hashes").alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count_distinct("digest").alias("n")).where(F.col("n") > least)
    hosts = measures.groupBy("host").agg(F.count_distinct("digest").alias("host_docs"))
    return counts.join(hosts, "host").where((F.col("n") > share * F.col("host_docs")) | (F.col("n") > ceiling)).select("host", "line")


@dataclass(frozen=True)
class Limits:
    share: float = SHARE
    least: int = LEAST
    ceiling: int = CEILING
    words_left: int = WORDS_LEFT
    share_left: float = SHARE_LEFT


def removals(measures: DataFrame, limits: Limits) -> DataFrame:
    """doc_id, digest, host, removed_words, for documents that lose lines."""
    lines = measures.select("doc_id", "digest", "host", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("l"))
    lines = lines.select("doc_id", "digest", "host", F.col("l.line_hashes").alias("line"), F.col("l.line_words").alias("words"))
    # Few lines of a host can be in more than a share of its documents. Stored, their number is known, and
    # Spark sends them to the documents' lines where they are few.
    hit = lines.join(stored(frequent_lines(measures, limits.share, limits.least, limits.ceiling)), ["host", "line"], "left_semi")
    # Repeated rows lose the same lines: once per line, then one row per id and text.
    once = hit.groupBy("doc_id", "digest", "host", "line").agg(F.max("words").alias("words"))
    return once.groupBy("doc_id", "digest", "host").agg(F.sum("words").alias("removed_words"))


def judged(measures: DataFrame, removed: DataFrame, limits: Limits) -> DataFrame:
    m, r = measures.drop("line_hashes", "line_words").alias("m"), removed.alias("r")
    on = F.col("m.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("m.digest") == F.col("r.digest")) & (F.col("m.host") == F.col("r.host"))
    joined = m.join(r, on, "left").select("m.*", F.coalesce("r.removed_words", F.lit(0)).alias("removed_words"))
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATS * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < limits.words_left) | (left < limits.share_left * F.col("n_words"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def line_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Measures and verdict of every document: base_failed, removed_words, kept.

    Null and empty texts have no words and fail the base rules. Repeated rows give repeated results and
    count as one document. A null host is a host of its own.
    """
    measures = stored(measured(docs))
    return judged(measures, removals(measures, limits), limits).select(*RESULT)


def ruled_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents kept, all columns, without their lines above the limits (n_chars, where there is one, follows).

    Each document meets the lines of its host that are above the limit: at most lines per document / share
    of them on average. Texts are judged and cut where they are read; only line hashes are shuffled.
    """
    hashes = stored(measured(docs).select("host", "digest", "line_hashes"))
    lines = frequent_lines(hashes, limits.share, limits.least, limits.ceiling)
    of_host = stored(lines.groupBy("host").agg(F.collect_list("line").alias("lines"))).alias("h")
    # All columns travel as one struct, so that none clashes with the keys.
    whole = docs.select(F.struct("*").alias("row"), docs["text"].alias("text"), keys(docs)[0]).alias("d")
    joined = whole.join(of_host, F.col("d.host") == F.col("h.host"), "left")

    @F.pandas_udf("text string, kept boolean")
    def ruled(texts: pd.Series, lines: pd.Series) -> pd.DataFrame:
        texts, lines = list(texts), list(lines)
        parts = [judge(texts[run], lines[run]) for run in runs(texts)]
        return pd.DataFrame({"text": pd.Series([t for cut, _ in parts for t in cut], dtype=object), "kept": [k for _, kept in parts for k in kept]})

    def judge(texts: list, lines: list) -> tuple[list, list]:
        made = measured_texts(texts)
        kept, cut = [], []
        for text, held, n, repeats, hashes, sizes in zip(texts, lines, made["n_words"], made["n_repeat_words"], made["line_hashes"], made["line_words"]):
            gone = set() if held is None else set(held).intersection(hashes)
            left = n - sum(w for h, w in zip(hashes, sizes) if h in gone)
            failed = n < BASE_WORDS or 100 * repeats > BASE_REPEATS * n
            kept.append(not failed and left >= limits.words_left and left >= limits.share_left * n)
            cut.append("\n".join(x for x in text.split("\n") if line_hash(x) not in gone) if gone and kept[-1] else text)
        return cut, kept

    # Not deterministic for the planner: it runs once for each row, for both the verdict and the text.
    done = joined.select("row", ruled.asNondeterministic()(F.col("d.text"), F.col("h.lines")).alias("r")).where("r.kept")
    made = {"text": F.col("r.text")} | ({"n_chars": F.length("r.text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.select(*((made[c] if c in made else F.col("row").getField(c)).alias(c) for c in docs.columns))


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]


def op2_line_frequency(spark, folder):
    return line_rules(table(spark, folder, "documents"))


BLANK = r"[ \t\n\x0B\f\r]"
OP2_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source FROM documents),
words AS (
  SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT rid, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM docs)),
windows AS (
  SELECT rid, pos, word || chr(10) || lead(word, 1) OVER o || chr(10) || lead(word, 2) OVER o || chr(10) || lead(word, 3) OVER o || chr(10) || lead(word, 4) OVER o AS gram
  FROM words WINDOW o AS (PARTITION BY rid ORDER BY pos)),
twice AS (
  SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, gram) AS n FROM windows WHERE gram IS NOT NULL) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT pos + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY rid),
lines AS (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM docs),
filled AS (
  SELECT rid, source, text, line, trim(regexp_replace(regexp_replace(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[1-9]', '0', 'g'), '{BLANK}+', ' ', 'g')) AS normal,
    len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS n
  FROM lines WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
per_text AS (SELECT rid, count(*) - count(DISTINCT line) AS dups FROM filled GROUP BY rid),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM docs GROUP BY source),
counts AS (SELECT source, normal, count(DISTINCT text) AS n FROM filled GROUP BY source, normal),
frequent AS (
  SELECT c.source, c.normal FROM counts c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE c.n > {LEAST} AND (c.n > {SHARE} * h.docs OR c.n > {CEILING})),
removed AS (
  SELECT rid, sum(n) AS n FROM filled f JOIN frequent q ON f.source IS NOT DISTINCT FROM q.source AND f.normal = q.normal GROUP BY rid),
measured AS (
  SELECT d.doc_id, len(regexp_extract_all(d.text, '[^ \t\n\x0B\f\r]+'))::BIGINT AS n_words,
    length(regexp_replace(d.text, '{BLANK}', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(p.dups, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(r.n, 0)::BIGINT AS removed_words
  FROM docs d LEFT JOIN per_text p USING (rid) LEFT JOIN covered c USING (rid) LEFT JOIN removed r USING (rid)),
judged AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEATS} * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  NOT base_failed AND n_words - removed_words >= {WORDS_LEFT} AND n_words - removed_words >= {SHARE_LEFT} * n_words AS kept
FROM judged
"""

"""Record, line and cut operators over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog.base import Entry
from seqloom.catalog.bindings import passages, sequences, table
from seqloom.catalog.oracle import SEQS, residues, with_
from seqloom.fixed import AMBIGUOUS, RESIDUES
from seqloom.sources import fasta, glyphs

CHUNK = 100
#: Glyphs that one task puts in lines.
GLYPHS = 2_000_000


def fasta_texts(spark, folder):
    docs = sequences(spark, folder)
    return docs.select("doc_id", F.md5(fasta.fasta_text(F.col("doc_id").cast("string"), "sequence")).alias("record"))


def fasta_round_trip(spark, folder):
    """Eight-field records written as text and parsed back."""
    docs = sequences(spark, folder)
    header = F.concat_ws(
        "|", "doc_id", "idv_id", "lang", "source", "lang", "type", F.lit(""), F.when(F.col("doc_id") % 2 == 0, "NTD").otherwise("CTD")
    )
    records = docs.select(fasta.fasta_text(header, "sequence").alias("value"))
    return fasta.parse_records(records).select("seq_id", "idv_id", "family", "genus", "type", "subtype", "region", "sequence")


def _tasks(docs) -> int:
    """Tasks that hold about GLYPHS letters each, and at least one for every shuffle partition."""
    letters = docs.agg(F.sum(F.length("sequence")).alias("n")).first()["n"] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-letters // GLYPHS))


def printed_lines(spark, folder):
    """Glyphs of every sequence printed sixty to a line, slightly off the baseline, put back in lines."""
    # Dealt before they become glyphs: all glyphs of a document then stand in one task and need no shuffle of their own.
    docs = sequences(spark, folder).select("doc_id", "sequence")
    dealt = docs.repartition(_tasks(docs), "doc_id")
    characters = dealt.select("doc_id", F.posexplode(F.split("sequence", "")).alias("i", "text"))
    placed = characters.where(F.col("text") != "").select(
        "doc_id", "text", ((F.col("i") % 60) * 7 + 136).cast("double").alias("x0"),
        (F.floor(F.col("i") / 60) * 12 + F.when(F.col("i") % 2 == 0, 0.25).otherwise(-0.25)).alias("top"),
    )
    lines = glyphs.glyph_lines(placed, ["doc_id"], (136.0, 600.0))
    return lines.select("doc_id", F.col("line").cast("bigint").alias("line"), "text")


def residue_only_lines(spark, folder):
    """Lines of the raw texts that consist of residue letters."""
    lines = table(spark, folder, "documents").select("doc_id", F.explode(F.split("text", r"[\n .,]+")).alias("text"))
    return glyphs.residue_lines(lines).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_letters"))


def cut_sequences(spark, folder):
    """Every document's lines of sixty cut again at published lengths of a hundred."""
    docs = sequences(spark, folder).where(F.length("sequence") > 0)
    numbered = F.posexplode(F.regexp_extract_all("sequence", F.lit(".{1,60}"), F.lit(0)))
    lines = docs.select("doc_id", numbered.alias("line", "text"))
    n_chunks = F.ceil(F.length("sequence") / CHUNK)
    expected = docs.select("doc_id", F.length("sequence").alias("n"), F.explode(F.sequence(F.lit(1).cast("bigint"), n_chunks)).alias("position"))
    expected = expected.select(
        "doc_id", "position", F.col("position").alias("id"),
        F.least(F.lit(CHUNK), F.col("n") - (F.col("position") - 1) * CHUNK).alias("length"),
    )
    return glyphs.cut_lines(lines, expected, "doc_id", ["line"]).select("doc_id", "id", "sequence", "complete")


def combined_rows(spark, folder):
    """Documents and passages as one table; the passages lack the documents' columns."""
    docs = sequences(spark, folder).select("doc_id", "lang", F.md5("sequence").alias("digest"))
    items = passages(spark, folder).select(F.col("known_id").alias("item_id"), F.md5("sequence").alias("digest"))
    return docs.unionByName(items, allowMissingColumns=True)


_LINE = f"[{RESIDUES}{AMBIGUOUS}]+"

ENTRIES = {
    "fasta_texts": Entry(fasta_texts, with_(SEQS, """
SELECT doc_id, md5('>' || doc_id || CASE WHEN sequence = '' THEN '' ELSE chr(10) || array_to_string(regexp_extract_all(sequence, '.{1,60}'), chr(10)) END) AS record FROM seqs""")),
    "fasta_round_trip": Entry(fasta_round_trip, with_(SEQS, """
SELECT doc_id::VARCHAR AS seq_id, idv_id, lang AS family, source AS genus, type, '' AS subtype,
       CASE WHEN doc_id % 2 = 0 THEN 'NTD' ELSE 'CTD' END AS region, sequence FROM seqs""")),
    "printed_lines": Entry(printed_lines, with_(SEQS, """
SELECT doc_id, i * 12 AS line, sequence[i * 60 + 1 : i * 60 + 60] AS text FROM (
  SELECT doc_id, sequence, unnest(range((length(sequence) + 59) // 60)) AS i FROM seqs)""")),
    "residue_only_lines": Entry(residue_only_lines, f"""
SELECT doc_id, count(*) AS n_lines, sum(length(t))::BIGINT AS n_letters FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\\n .,]+')) AS t FROM documents)
WHERE regexp_full_match(t, '{_LINE}') GROUP BY doc_id"""),
    "cut_sequences": Entry(cut_sequences, with_(SEQS, """
SELECT doc_id, i AS id, sequence[(i - 1) * 100 + 1 : i * 100] AS sequence, true AS complete FROM (
  SELECT doc_id, sequence, unnest(range(1, (length(sequence) + 99) // 100 + 1)) AS i FROM seqs)""")),
    "combined_rows": Entry(combined_rows, with_(SEQS, f"""
SELECT doc_id, lang, md5(sequence) AS digest, NULL::BIGINT AS item_id FROM seqs
UNION ALL SELECT NULL, NULL, md5({residues('text')}), item_id FROM benchmark""")),
}

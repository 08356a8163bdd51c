"""Given tables written as the files that the loaders read, and read back; joins and orders over them.

Every query writes into a fresh place in the shared folder, so the loaders meet files as Spark writes
them: several parts, headers in each, whole columns.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from seqloom.catalog.base import Entry
from seqloom.catalog.bindings import known, measurements, pairs, passages, pool, sequences
from seqloom.catalog.oracle import MEAS, PAIRS, POOL, SEQS, residues, with_
from seqloom.fixed import MEASUREMENT_COLUMNS, PROPERTIES, TARGETS
from seqloom.operators.agreement import published_join
from seqloom.operators.curation import normalisation_bounds
from seqloom.operators.motif_sets import literal_matches
from seqloom.session import checkpoint_dir
from seqloom.sources import fasta, results, tables

#: Letters of the motifs that motif_files makes.
MOTIF_LETTERS = 4


def _place(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid4().hex}/{name}"


def fasta_files(spark, folder):
    """Every document's sequence written as FASTA files and read again."""
    header = F.concat_ws("|", "doc_id", "idv_id", "lang", "source", "lang", "type", F.lit(""), F.lit("NTD"))
    path = _place(spark, "sequences.fasta")
    fasta.write_fasta(sequences(spark, folder).withColumn("header", header), "header", "sequence", path)
    return fasta.read_fasta(spark, path).select("seq_id", "idv_id", "family", "type", "region", "sequence")


def pairs_files(spark, folder):
    """Curated pairs through CSV."""
    path = _place(spark, "pairs.csv")
    columns = ["sequence", *PROPERTIES, "idv_id", "type"]
    results.write_table(pairs(spark, folder).select(*columns), path, csv=True)
    return tables.read_pairs(spark, path).select(*columns)


def measurement_files(spark, folder):
    """Measurements through CSV, columns in another order than the schema's."""
    path = _place(spark, "measurements.csv")
    columns = [*reversed(MEASUREMENT_COLUMNS), "idv_id"]
    results.write_table(measurements(spark, folder).select(*[F.col(f"`{c}`") for c in columns]), path, csv=True)
    return tables.read_measurements(spark, path).select("idv_id", *[F.col(f"`{c}`").alias(p) for c, p in zip(MEASUREMENT_COLUMNS, PROPERTIES)])


def known_files(spark, folder):
    """Known sequences through CSV: copies of each, and whether every row has an id of its own."""
    path = _place(spark, "known.csv")
    results.write_table(known(spark, folder).select(F.col("sequence").alias("Sequence")).where("Sequence <> ''"), path, csv=True)
    rows = tables.read_known(spark, path)
    return rows.groupBy("sequence").agg(F.count("*").alias("n_rows"), F.count_distinct("known_id").alias("n_ids"))


def bounds_files(spark, folder):
    """Normalisation bounds through a JSON object; derived where no file is."""
    path = _place(spark, "bounds.json")
    derived = normalisation_bounds(pairs(spark, folder))
    entries = F.map_from_arrays(F.array(*map(F.lit, PROPERTIES)), F.arrays_zip("lows", "highs"))
    text = derived.select(F.to_json(F.transform_values(entries, lambda _, e: F.array(e["lows"], e["highs"]))).alias("value"))
    text.coalesce(1).write.text(path)
    found, label = tables.bounds_or_derived(spark, f"{path}/part-*", pairs(spark, folder))
    absent, other = tables.bounds_or_derived(spark, f"{path}/none", pairs(spark, folder))
    both = found.withColumn("label", F.lit(label)).unionByName(absent.withColumn("label", F.lit(other)))
    slots = F.posexplode(F.arrays_zip("lows", "highs")).alias("slot", "b")
    return both.select("label", slots).select("label", "slot", F.col("b.lows").alias("low"), F.col("b.highs").alias("high"))


def pool_files(spark, folder):
    """The scored pool as one CSV per set, columns in another order, read in one go."""
    place, rows = _place(spark, "pools"), pool(spark, folder)
    fields = [f.split()[0] for f in tables.POOL_SCHEMA.split(", ")]
    answers = {f"pred_{p}": F.col("prediction")[i] for i, p in enumerate(PROPERTIES)}
    held = rows.select(*[answers.get(c, F.col(c)).alias(c) for c in fields])
    for name in TARGETS:
        part = held.where(F.col("set") == name).select(*reversed(fields))
        results.write_table(part, f"{place}/pool_{name}.csv", csv=True)
    return tables.read_pools(spark, place).select("set", "candidate_index", "length", "novel_exact", "r2")


def result_files(spark, folder):
    """Row counts of the inputs as a run's record holds them, after a write and a read."""
    inputs = {name: f"{folder}/{name}.parquet" for name in ("documents", "labels", "orders")}
    place = _place(spark, "results")
    summary = sequences(spark, folder).groupBy("lang").agg(F.count("*").alias("n"))
    results.write_result(place, "summary", {"by_lang": summary}, results.run_record(spark, inputs, {"n": 3}))
    record = results.load_result(spark, place, "summary", "run").select(F.explode("inputs").alias("i"))
    langs = results.load_result(spark, place, "summary", "by_lang")
    return record.select(F.col("i.name").alias("name"), F.col("i.rows").alias("n")).unionByName(langs.select(F.col("lang").alias("name"), "n"))


def published_columns(spark, folder):
    """Lengths and weights computed per document against those published for it; only columns that both sides have get a suffix."""
    computed = sequences(spark, folder).select("doc_id", F.length("sequence").alias("length"), "lang")
    published = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.col("n_chars").alias("length"), "source")
    return published_join(computed, published, "doc_id")


def named_individuals(spark, folder):
    """The id column renamed to the name column of the other side, then a left join that keeps all."""
    people = spark.read.parquet(f"{folder}/customer.parquet").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    docs = sequences(spark, folder).select("doc_id", F.col("idv_id").alias("name"))
    return docs.join(people.withColumnRenamed("id", "name"), "name", "left").select("doc_id", "name", "c_mktsegment")


def motif_files(spark, folder):
    """A table of literal motifs (the first letters of every passage) written as CSV, read back, and found in all documents."""
    path = _place(spark, "motifs.csv")
    chosen = passages(spark, folder).where(F.length("sequence") >= MOTIF_LETTERS).select(
        F.concat(F.lit("m"), "known_id").alias("motif_id"), F.substring("sequence", 1, MOTIF_LETTERS).alias("pattern"),
        F.lit("any").alias("property"), F.lit("+").alias("direction"))
    chosen.write.option("header", True).csv(path)
    found = literal_matches(sequences(spark, folder), "doc_id", "sequence", tables.read_motifs(spark, path))
    return found.select("doc_id", "motif_id", F.size("starts").cast("bigint").alias("n"), F.array_min("starts").alias("first"), F.array_max("starts").alias("last"))


def ordered_rows(spark, folder):
    """Rows in the order of two keys, with their place in it so that the order itself is compared."""
    from seqloom.operators.ranking import cumulative_counts

    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    keyed = lines.withColumn("place_key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    upto = cumulative_counts(keyed.select("l_returnflag", F.col("place_key").cast("double").alias("place_key")), ["l_returnflag"], "place_key", {})
    return upto.select("l_returnflag", F.col("place_key").cast("bigint").alias("place_key"), F.col("upto").cast("bigint").alias("upto")).orderBy("l_returnflag", "place_key")


_BOUNDS = ", ".join(f"('{p}', {i}, (SELECT min(\"{p}\") FROM pairs), (SELECT max(\"{p}\") FROM pairs))" for i, p in enumerate(PROPERTIES))

ENTRIES = {
    "fasta_files": Entry(fasta_files, with_(SEQS, """
SELECT doc_id::VARCHAR AS seq_id, idv_id, lang AS family, type, 'NTD' AS region, sequence FROM seqs""")),
    "pairs_files": Entry(pairs_files, with_(PAIRS, "SELECT nullif(sequence, '') AS sequence, " + ", ".join(f'"{p}"' for p in PROPERTIES) + ", idv_id, type FROM pairs"), PROPERTIES),
    "measurement_files": Entry(measurement_files, with_(MEAS, "SELECT * FROM meas"), PROPERTIES),
    "known_files": Entry(known_files, with_(SEQS, "SELECT sequence, count(*) AS n_rows, count(*) AS n_ids FROM seqs WHERE sequence <> '' GROUP BY sequence")),
    "bounds_files": Entry(bounds_files, with_(PAIRS, f"""
SELECT label, slot::BIGINT AS slot, low, high FROM (VALUES {_BOUNDS}) AS b(p, slot, low, high), (VALUES ('published'), ('derived')) AS l(label)"""), ["low", "high"]),
    "pool_files": Entry(pool_files, with_(POOL, 'SELECT "set", candidate_index, length, novel_exact, r2 FROM pool'), ["r2"]),
    "result_files": Entry(result_files, """
SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT lang, count(*) FROM documents GROUP BY lang"""),
    "published_columns": Entry(published_columns, with_(SEQS, """
SELECT doc_id, length(s.sequence) AS length, s.lang, d.n_chars AS length_pub, d.source FROM seqs s JOIN documents d USING (doc_id)""")),
    "named_individuals": Entry(named_individuals, with_(SEQS, """
SELECT doc_id, idv_id AS name, c_mktsegment FROM seqs LEFT JOIN customer ON c_custkey = idv_id""")),
    "motif_files": Entry(motif_files, with_(SEQS, f"""
SELECT doc_id, motif_id, count(*) AS n, min(i) AS first, max(i) AS last FROM (
  SELECT doc_id, i, sequence[i + 1 : i + {MOTIF_LETTERS}] AS piece FROM (SELECT doc_id, sequence, unnest(range(length(sequence))) AS i FROM seqs))
JOIN (SELECT 'm' || item_id AS motif_id, p[1 : {MOTIF_LETTERS}] AS pattern FROM (SELECT item_id, {residues('text')} AS p FROM benchmark) WHERE length(p) >= {MOTIF_LETTERS})
  ON piece = pattern GROUP BY doc_id, motif_id""")),
    "ordered_rows": Entry(ordered_rows, """
SELECT l_returnflag, place_key, max(upto) AS upto FROM (
  SELECT l_returnflag, l_orderkey * 8 + l_linenumber AS place_key,
         count(*) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 8 + l_linenumber) AS upto FROM lineitem) GROUP BY ALL"""),
}

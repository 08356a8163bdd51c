"""Readers, writers, the resumable pool and its stream."""

import json

import pytest
from pyspark.sql import functions as F

from seqloom.fixed import MEASUREMENT_COLUMNS, PROPERTIES, TARGETS
from seqloom.operators.pools import targets_table
from seqloom.plans import dataset
from seqloom.plans.inference import composition_model, design_attempts, design_rows
from seqloom.sources import commits, fasta, glyphs, results, tables
from seqloom.streaming.pool import read_attempts, run_pool_stream

FASTA = """>s1|7|Araneidae|Araneus|diadematus|MaSp1||NTD
GAGA
GQ
>s2|8|f|g|s|MiSp|x|CTD
  AAAA
>s3|7|f|g|s|MaSp2|x|CTD
GPG
"""


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(FASTA)
    rows = {r["seq_id"]: r for r in fasta.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert [(k, r["idv_id"], r["sequence"]) for k, r in sorted(rows.items())] == [("s1", 7, "GAGAGQ"), ("s2", 8, "AAAA"), ("s3", 7, "GPG")]
    assert rows["s1"]["subtype"] == "" and rows["s1"]["region"] == "NTD"
    (tmp_path / "bad.fasta").write_text(">only|two\nGA\n")
    with pytest.raises(Exception, match="only.two"):
        fasta.read_fasta(spark, str(tmp_path / "bad.fasta")).collect()


def test_write_fasta(spark, tmp_path):
    df = spark.createDataFrame([("x", "G" * 125)], "name string, sequence string")
    fasta.write_fasta(df, "name", "sequence", str(tmp_path / "out"))
    written = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert written == ">x\n" + "G" * 60 + "\n" + "G" * 60 + "\n" + "G" * 5 + "\n"


def test_csv_checks(spark, tmp_path):
    with pytest.raises(tables.MissingInput):
        tables.read_pairs(spark, str(tmp_path / "none.csv"))
    (tmp_path / "short.csv").write_text("sequence,toughness\nGA,1\n")
    with pytest.raises(ValueError, match="strain_sd"):
        tables.read_pairs(spark, str(tmp_path / "short.csv"))
    (tmp_path / "ids.csv").write_text("id,set,role,sequence,length,mw,n_ambiguous,protparam_safe\n1.10,1,generated,GA,2,,0,True\n")
    row = tables.read_csv(spark, str(tmp_path / "ids.csv"), tables.SPECIMENS_SCHEMA).first()
    assert (row["id"], row["mw"], row["protparam_safe"]) == ("1.10", None, True)
    (tmp_path / "known.csv").write_text("Sequence\nGA\nGA\n")
    assert tables.read_known(spark, str(tmp_path / "known.csv")).count() == 2


def test_bounds(spark, tmp_path):
    path = tmp_path / "bounds.json"
    path.write_text(json.dumps({p: [i, i + 1.5] for i, p in enumerate(PROPERTIES)}, indent=1))
    row = tables.read_bounds(spark, str(path)).first()
    assert row["lows"][2] == 2.0 and row["highs"][7] == 8.5
    path.write_text(json.dumps({p: [0, 1] for p in PROPERTIES[1:]}))
    with pytest.raises(Exception, match="no entry for toughness"):
        tables.read_bounds(spark, str(path)).collect()


def test_pool_folder(spark, tmp_path):
    header = tables.POOL_SCHEMA.replace(" string", "").replace(" int", "").replace(" boolean", "").replace(" double", "").replace(", ", ",")
    line = ",".join(["S1", "0", "GA", "2", "true", "true", *["0.1"] * 8, "0.5", "0.1", "0.2"])
    for name in ("S1", "F2", "unknown"):
        (tmp_path / f"pool_{name}.csv").write_text(f"{header}\n{line}\n")
    assert sorted(r["set"] for r in tables.read_pools(spark, str(tmp_path)).collect()) == ["F2", "S1"]


def test_dataset_build(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(FASTA)
    lines = ["7,f,g,s," + ",".join(str(i + 1) for i in range(8)), "8,f,g,s," + ",".join(str(2 * i + 3) for i in range(8)), "9,f,g,s,1,,1,1,1,1,1,1"]
    (tmp_path / "m.csv").write_text("idv_id,family,genus,species," + ",".join(MEASUREMENT_COLUMNS) + "\n" + "\n".join(lines) + "\n")
    sequences = fasta.read_fasta(spark, str(tmp_path / "a.fasta"))
    measured = tables.read_measurements(spark, str(tmp_path / "m.csv"))
    expected = spark.createDataFrame([("GPG", [0.0] * 8)], "sequence string, expected array<double>")
    pairs, bounds = dataset.build_dataset(sequences, measured, "MaSp", expected)
    assert sorted(r["seq_id"] for r in pairs.collect()) == ["s1", "s3"] and "mech_family" in pairs.columns
    assert bounds.first()["highs"] == [float(2 * i + 3) for i in range(8)]
    wrong = spark.createDataFrame([("GPG", [0.5] * 8)], "sequence string, expected array<double>")
    with pytest.raises(ValueError, match="nothing written"):
        dataset.build_dataset(sequences, measured, "MaSp", wrong)
    dataset.write_dataset(pairs, bounds, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/pairs")).count() == 2


def test_result_document(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    record = results.run_record(spark, {"numbers": str(tmp_path / "in")}, {"seed": 1})
    place = results.write_result(str(tmp_path), "r", {"table": spark.range(2)}, record)
    assert place.endswith("/r")
    assert sorted(x["id"] for x in results.load_result(spark, str(tmp_path), "r", "table").collect()) == [0, 1]
    row = results.load_result(spark, str(tmp_path), "r", "run").first()
    assert row["parameters"]["seed"] == "1" and row["version"] == spark.version
    assert [(i["name"], i["rows"]) for i in row["inputs"]] == [("numbers", 5)]


def test_pools_are_read_by_column_name(spark, tmp_path):
    names = [f.split()[0] for f in tables.POOL_SCHEMA.split(", ")]
    values = {n: str(i) for i, n in enumerate(names)} | {"set": "S1", "sequence": "GA", "novel_exact": "true", "forward_parsed": "false"}
    mixed = names[::-1]
    (tmp_path / "pool_S1.csv").write_text(",".join(mixed) + "\n" + ",".join(values[n] for n in mixed) + "\n")
    row = tables.read_pools(spark, str(tmp_path)).first()
    assert row["sequence"] == "GA" and row["set"] == "S1"
    assert all(row[n] == float(values[n]) for n in ("r2", "mae", "rmse", "pred_toughness"))
    (tmp_path / "pool_S2.csv").write_text("set,sequence\nS2,GA\n")
    with pytest.raises(ValueError, match="r2"):
        tables.read_pools(spark, str(tmp_path))


def test_known_sequences_keep_file_order(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"known_{part}.csv").write_text("Sequence\n" + "\n".join(f"G{part}A{i}" for i in range(500)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = tables.read_known(spark, str(tmp_path / "known_*.csv")).orderBy("known_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["sequence"] for r in rows] == [f"G{part}A{i}" for part in range(3) for i in range(500)]
    assert len({r["known_id"] for r in rows}) == 1500


def test_cut_checks_totals_and_keeps_every_id(spark):
    lines = spark.createDataFrame([("d", 0, "GAGA"), ("d", 1, "GG")], "doc string, line int, text string")
    ids = spark.createDataFrame([("d", 0, "a", 3), ("d", 1, "none", 0), ("d", 2, "b", 3)], "doc string, position int, id string, length int")
    assert {r["id"]: r["sequence"] for r in glyphs.cut_lines(lines, ids, "doc", ["line"]).collect()} == {"a": "GAG", "none": "", "b": "AGG"}
    for wrong in (2, 4):
        bad = ids.withColumn("length", F.when(F.col("id") == "b", wrong).otherwise(F.col("length")))
        with pytest.raises(Exception, match="document d holds 6"):
            glyphs.cut_lines(lines, bad, "doc", ["line"]).collect()


def test_pool_resumes_on_attempts(spark, tmp_path):
    path, targets = str(tmp_path / "pool"), targets_table(spark)
    first = results.remaining_attempts(spark, targets, path, 3)
    assert first.count() == 3 * len(TARGETS)
    rows = first.select("set", "attempt", F.when(F.col("attempt") == 0, "no answer").otherwise("[GAGA]").alias("text"))
    results.append_attempts(design_rows(rows), path)
    counts = results.attempts_made(spark, path).collect()
    assert {(r["attempts"], r["parsed"], r["next_attempt"]) for r in counts} == {(3, 2, 3)}
    assert results.remaining_attempts(spark, targets, path, 3).count() == 0
    assert {r["attempt"] for r in results.remaining_attempts(spark, targets, path, 5).collect()} == {3, 4}
    # Appending again changes nothing, and gaps are found.
    results.append_attempts(design_rows(rows), path)
    assert {r["attempts"] for r in results.attempts_made(spark, path).collect()} == {3}
    later = rows.where("attempt = 0").withColumn("attempt", F.lit(6))
    results.append_attempts(design_rows(later), path)
    assert {r["attempt"] for r in results.remaining_attempts(spark, targets, path, 8).collect()} == {3, 4, 5, 7}


def test_a_batch_is_published_once_and_whole(spark, tmp_path):
    path = str(tmp_path / "pool")
    rows = spark.createDataFrame([("S1", 0, "parsed"), ("S2", 0, "junk")], "set string, attempt int, status string")
    # Killed between the two phases: no reader sees anything, and all of it is still to be done.
    commits.stage(rows, path, ["set"])
    assert results.attempts_made(spark, path).count() == 0
    assert commits.append_batch(rows, path, "7", ["set"]) and not commits.append_batch(rows, path, "7", ["set"])
    assert sorted(tuple(r) for r in results.attempts_made(spark, path).collect()) == [("S1", 1, 1, 1), ("S2", 1, 0, 1)]
    # A second writer of the same batch that got past its first phase adds nothing.
    assert not commits.publish(spark, commits.stage(rows, path, ["set"]), path, "7")
    assert spark.read.parquet(path).count() == 2
    results.append_attempts(rows.where("attempt > 5"), path)
    results.append_attempts(rows, path)
    assert spark.read.parquet(path).count() == 2 and {r["set"] for r in spark.read.parquet(path).where("set = 'S1'").collect()} == {"S1"}


def test_designs_replay_and_do_not_repeat(spark):
    targets = targets_table(spark)
    model = composition_model("inverse")
    four = {(r["set"], r["attempt"]): r["text"] for r in design_attempts(spark, targets, 4, model).collect()}
    later = {(r["set"], r["attempt"]): r["text"] for r in design_attempts(spark, targets, 2, model, first_attempt=2).collect()}
    assert len(set(four.values())) == 32 and all(four[k] == v for k, v in later.items())


def test_stream(spark, tmp_path):
    source, pool, mark = (str(tmp_path / n) for n in ("attempts", "pool", "mark"))
    rows = [("S1", 0, "[GA]"), ("S1", 1, "junk"), ("S2", 0, "[GA1]")]
    write = lambda r: spark.createDataFrame(r, "set string, attempt int, text string").write.mode("append").parquet(source)
    write(rows)
    run_pool_stream(read_attempts(spark, source), pool, mark).awaitTermination(120)
    write([("S2", 1, "[GG]")])
    run_pool_stream(read_attempts(spark, source), pool, mark).awaitTermination(120)
    got = sorted((r["set"], r["attempt"], r["status"]) for r in spark.read.parquet(pool).collect())
    assert got == [("S1", 0, "parsed"), ("S1", 1, "unparseable"), ("S2", 0, "invalid_aa"), ("S2", 1, "parsed")]

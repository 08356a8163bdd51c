"""The pipeline stage by stage on planted documents, each stage against what it must do to its own input."""

import public_tokenizers
import pytest
from samples import SCHEMA, words
from tokenizers import Tokenizer

import corpus_pipeline
from seqloom.llm.line_frequency import line_rules


def junk(seed):
    return "\n".join(" ".join(f"{w}%%%" for w in words(seed * 50 + k, 12).split()) for k in range(5))


def clean(seed):
    return "\n".join(words(9000 + seed * 50 + k, 14).capitalize() + "." for k in range(5))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(i, clean(i) if i % 3 else junk(i), "en", f"s{i % 2}", 1) for i in range(90)]
    rows += [(200 + k, clean(1), "en", "s0", 1) for k in range(4)]
    rows += [(210, clean(2) + " extra", "en", "s1", 1)]
    rows += [(220, clean(500) + " Write to a.b@c.org now", "en", "s0", 1), (221, "too short", "en", "s0", 1), (222, None, None, None, None), (223, "", "en", "s0", 0)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(90)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_stages(spark, corpus, tmp_path):
    folder, rows = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "pii", "packing"]
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
        if name == "quality_rules":
            assert set(seen[name]) == {r["doc_id"] for r in line_rules(before).where("kept").collect()}
    first = seen["quality_classifier"]
    assert not any(i % 3 == 0 and i < 90 for i in first if i is not None)
    assert all(i in first for i in range(90) if i % 3)
    assert {221, 222, 223}.isdisjoint(seen["quality_rules"])
    kept = seen["near_dedup"]
    assert 1 in kept and 2 in kept and {200, 201, 202, 203, 210}.isdisjoint(kept)
    assert "[EMAIL]" in seen["pii"][220]["text"] and "a.b@c.org" not in seen["pii"][220]["text"]
    assert seen["pii"][1]["text"] == clean(1)
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = list(map(tuple, docs.select("doc_id", "length").collect()))
    want = [(i, len(tokens.encode(r["text"], add_special_tokens=False).ids) + 1) for i, r in seen["pii"].items()]
    assert sorted(packed) == sorted(want)


def test_run_gives_the_last_stage(spark, corpus):
    folder, _ = corpus
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() >= 50

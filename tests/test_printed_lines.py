"""Glyphs of a document are put in lines where the document was dealt to."""

from seqloom.catalog import entries


def test_sequences_are_shuffled_and_glyphs_are_not(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = entries()["printed_lines"].query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    above, _, below = plan.partition("Generate")
    assert "Exchange" not in above and below.count("Exchange hashpartitioning") == 1

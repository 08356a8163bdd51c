"""Prompt texts, answer parsing and its accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog.base import Entry
from seqloom.catalog.bindings import attempts, predicted_pairs, sequences, table, vectors
from seqloom.catalog.oracle import ATTEMPTS, PREDICTED, SEQS, VECTORS, fraction, prediction, with_
from seqloom.fixed import DECODING_BUDGETS, PROPERTIES
from seqloom.functions import prompts as pr
from seqloom.operators import pools
from seqloom.plans import design, inference


def formatted_vectors(spark, folder):
    return vectors(spark, folder).select("vec_id", pr.format_vector("target").alias("text"))


def prompt_texts(spark, folder):
    docs = sequences(spark, folder)
    return docs.select(
        "doc_id", F.md5(pr.forward_prompt("sequence")).alias("forward"), F.md5(pr.solubility_prompt("sequence")).alias("solubility"),
        pr.task_of(pr.forward_prompt("sequence")).alias("task"), pr.task_of("sequence").alias("no_task"),
    )


def inverse_prompts(spark, folder):
    rows = vectors(spark, folder).select("vec_id", pr.inverse_prompt("target").alias("prompt"))
    return rows.select("vec_id", "prompt", pr.task_of("prompt").alias("task"))


def _answers(spark, folder):
    """Bracketed answers of eight values built from events; some cut short, some with extra items."""
    e = table(spark, folder, "events")
    v = F.col("value").cast("string")
    cells = [F.concat(v, F.lit(" ")), F.get_json_object("props", "$.k"), v, F.lit("1e-3"), F.lit("-.5"), v, v]
    eighth = (
        F.when(F.col("event_type") == "error", "oops").when(F.col("event_type") == "view", "1,2")
        .when(F.col("event_type") == "signup", " ").otherwise("7.")
    )
    body = F.concat(F.lit("pre fix ["), F.concat_ws(",", *cells), F.lit(","), eighth)
    return e.select("event_id", "event_type", F.when(F.col("value") < 5, body).otherwise(F.concat(body, F.lit("] [tail]"))).alias("text"))


def parsed_vectors(spark, folder):
    rows = _answers(spark, folder).select("event_id", pr.parse_vector("text").alias("v"))
    return rows.select("event_id", *[F.get("v", F.lit(i)).alias(p) for i, p in enumerate(PROPERTIES)])


def parsed_numbers(spark, folder):
    rows = _answers(spark, folder)
    return rows.select(
        "event_id", pr.parse_solubility("text").alias("first_value"), pr.letters_before_answer("text").alias("extra_letters"),
        pr.bracketed("text").alias("body"),
    )


def parsed_sequences(spark, folder):
    rows = inference.design_rows(attempts(spark, folder))
    return rows.select("set", "attempt", "status", "sequence")


def parse_accounting(spark, folder):
    return pools.parse_accounting(inference.design_rows(attempts(spark, folder)), ["set"])


def predictions(spark, folder):
    rows = inference.predict_properties(sequences(spark, folder), "sequence")
    return rows.select("doc_id", *[F.col("prediction")[i].alias(f"pred_{p}") for i, p in enumerate(PROPERTIES)])


def solubility_predictions(spark, folder):
    return inference.predict_solubility(sequences(spark, folder), "sequence").select("doc_id", "solubility")


def decoding_budgets(spark, folder):
    docs = sequences(spark, folder).select("doc_id", "sequence")
    answered = inference.decoding_budgets(
        docs, "sequence", DECODING_BUDGETS, lambda budget: inference.composition_model(max_new_tokens=budget)
    )
    return design.budget_summary(answered)


def decoding_agreement(spark, folder):
    docs = inference.predict_properties(sequences(spark, folder), "sequence", name="greedy")
    both = inference.predict_properties(docs, "sequence", inference.composition_model("forward_sampled"), F.col("doc_id"), "sampled")
    return design.decoding_agreement(both, "greedy", "sampled")


def batch_invariance(spark, folder):
    docs = inference.predict_properties(sequences(spark, folder), "sequence", name="one", batch_size=1)
    both = inference.predict_properties(docs, "sequence", name="eight", batch_size=8)
    return design.batch_mismatches(both, "one", "eight")


def repeatability(spark, folder):
    """Five sampled draws per document."""
    draws = sequences(spark, folder).select("doc_id", "sequence", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("repeat"))
    sampled = inference.predict_properties(
        draws, "sequence", inference.composition_model("forward_sampled"), F.col("doc_id") * 1000 + F.col("repeat")
    )
    return design.repeatability(sampled, ["doc_id"])


def property_columns(spark, folder):
    """True and predicted values unpacked into named columns."""
    df = predicted_pairs(spark, folder)
    return df.select(
        "doc_id", *[F.col("target")[i].alias(f"true_{p}") for i, p in enumerate(PROPERTIES)],
        *[F.col("prediction")[i].alias(f"pred_{p}") for i, p in enumerate(PROPERTIES)],
    )


_ANSWERS = """answers AS MATERIALIZED (
  SELECT event_id, event_type, 'pre fix [' || concat_ws(',', value::VARCHAR || ' ', props->>'$.k', value::VARCHAR, '1e-3', '-.5', value::VARCHAR, value::VARCHAR)
    || ',' || CASE event_type WHEN 'error' THEN 'oops' WHEN 'view' THEN '1,2' WHEN 'signup' THEN ' ' ELSE '7.' END
    || CASE WHEN value < 5 THEN '' ELSE '] [tail]' END AS text FROM events),
bodies AS MATERIALIZED (
  SELECT *, CASE WHEN contains(text, ']') THEN split_part(split_part(text, '[', 2), ']', 1) END AS body FROM answers),
cells AS MATERIALIZED (SELECT *, [trim(c) for c in string_split(body, ',') if trim(c) <> ''] AS parts FROM bodies),
numbers AS MATERIALIZED (SELECT *, [TRY_CAST(c AS DOUBLE) for c in parts] AS v FROM cells)"""

_OK = "len(v) = 8 AND len([x for x in v if x IS NULL]) = 0"
_CELLS = ", ".join(f"printf('%.3f', target[{i}])" for i in range(1, 9))
_SHORT = "'[' || array_to_string([" + ", ".join(f"printf('%.3f', x[{i}])" for i in range(1, 9)) + "], ',') || ']'"
_NOISE = "(('0x' || substr(md5(concat_ws(':', {key}, sequence)), 1, 15))::BIGINT % 3) / 1000"
_FIRST = fraction("sequence", "GA")


def _budget_sql(budget: int) -> str:
    return f"""
SELECT {budget}::BIGINT AS budget, count(*) AS n, count(*) FILTER (WHERE length(answer) <= {budget}) AS n_parsed,
       avg((length(answer) <= {budget})::INT) AS parse_rate, 0::BIGINT AS max_extra_letters,
       CASE WHEN count(*) FILTER (WHERE length(answer) <= {budget}) > 0 THEN 0.0::DOUBLE END AS median_extra_letters FROM full_answers"""


ENTRIES = {
    "formatted_vectors": Entry(formatted_vectors, with_(VECTORS, f"SELECT vec_id, concat_ws(',', {_CELLS}) AS text FROM vecs")),
    "prompt_texts": Entry(prompt_texts, with_(SEQS, """
SELECT doc_id, md5('CalculateSilkContent<' || sequence || '>') AS forward, md5('CalculateSolubility<' || sequence || '>') AS solubility,
       'CalculateSilkContent' AS task, NULL::VARCHAR AS no_task FROM seqs""")),
    "inverse_prompts": Entry(inverse_prompts, with_(VECTORS, f"""
SELECT vec_id, 'GenerateSilkContent<' || concat_ws(',', {_CELLS}) || '>' AS prompt, 'GenerateSilkContent' AS task FROM vecs""")),
    "parsed_vectors": Entry(parsed_vectors, with_(_ANSWERS, "SELECT event_id, " + ", ".join(
        f'CASE WHEN {_OK} THEN v[{i + 1}] END AS "{p}"' for i, p in enumerate(PROPERTIES)
    ) + " FROM numbers")),
    "parsed_numbers": Entry(parsed_numbers, with_(_ANSWERS, """
SELECT event_id, TRY_CAST(trim(split_part(trim(body), ',', 1)) AS DOUBLE) AS first_value, 6::BIGINT AS extra_letters, body FROM bodies""")),
    "parsed_sequences": Entry(parsed_sequences, with_(ATTEMPTS, 'SELECT "set", attempt, status, sequence FROM parsed')),
    "parse_accounting": Entry(parse_accounting, with_(ATTEMPTS, """
SELECT "set", count(*) AS attempted, count(*) FILTER (WHERE status = 'parsed') AS parsed,
       count(*) FILTER (WHERE status = 'unparseable') AS rejected_unparseable,
       count(*) FILTER (WHERE status = 'invalid_aa') AS rejected_invalid_aa,
       count(*) FILTER (WHERE status = 'parsed') / count(*) AS parse_rate FROM parsed GROUP BY "set\"""")),
    "predictions": Entry(predictions, with_(f"{SEQS}, p AS (SELECT doc_id, {prediction('sequence')} AS prediction FROM seqs)",
        "SELECT doc_id, " + ", ".join(f'prediction[{i + 1}] AS "pred_{p}"' for i, p in enumerate(PROPERTIES)) + " FROM p")),
    "solubility_predictions": Entry(solubility_predictions, with_(SEQS, f"""
SELECT doc_id, printf('%.3f', {fraction('sequence', 'DEKRH')})::DOUBLE AS solubility FROM seqs""")),
    "decoding_budgets": Entry(decoding_budgets, with_(f"""{SEQS},
full_answers AS MATERIALIZED (SELECT {_SHORT} AS answer FROM (SELECT {prediction('sequence')} AS x FROM seqs))""",
        "\nUNION ALL ".join(_budget_sql(b) for b in DECODING_BUDGETS))),
    "decoding_agreement": Entry(decoding_agreement, with_(f"""{SEQS},
ab AS (SELECT printf('%.3f', {_FIRST})::DOUBLE AS a, printf('%.3f', {_FIRST} + {_NOISE.format(key='doc_id')})::DOUBLE AS b FROM seqs)""", """
SELECT count(*) AS n, count(*) FILTER (WHERE abs(a - b) <= 1e-9) AS identical, count(*) FILTER (WHERE abs(a - b) > 1e-9) AS differing,
       0::BIGINT AS only_one_parsed, 0::BIGINT AS neither_parsed, max(abs(a - b)) AS max_abs_difference FROM ab"""), ["max_abs_difference"]),
    "batch_invariance": Entry(batch_invariance, "SELECT count(*) AS n, 0::BIGINT AS mismatches FROM documents"),
    "repeatability": Entry(repeatability, with_(f"""{SEQS},
d AS (SELECT doc_id, printf('%.3f', {_FIRST} + {_NOISE.format(key='doc_id * 1000 + r')}) AS first FROM seqs, range(5) t(r))""", """
SELECT doc_id, count(*) AS n_draws, count(DISTINCT first) AS n_distinct FROM d GROUP BY doc_id""")),
    "property_columns": Entry(property_columns, with_(PREDICTED, "SELECT doc_id, " + ", ".join(
        f'target[{i + 1}] AS "true_{p}", prediction[{i + 1}] AS "pred_{p}"' for i, p in enumerate(PROPERTIES)
    ) + " FROM pred"), [f"true_{p}" for p in PROPERTIES]),
}

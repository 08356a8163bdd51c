"""Personal data against Python's own patterns; disclosing terms on a planted corpus."""

import re

from pyspark.sql import functions as F
from samples import documents, odd_rows, words

from seqloom.llm.sanitise import KINDS, contexts, disclosing_terms, identified, base_spans, listed, personal_data, replaced, sanitised

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def passes(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def brute(text: str) -> str:
    spans = [(m.start(), k, m.end(), kind) for k, kind in enumerate(KINDS) for m in re.finditer(PLAIN[kind], text) if passes(kind, m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))


TRICKY = [
    "a@b.c_x@d.e", "a@b.c@d.e.f", "a@b", "x" * 3000 + "@", "..@a.b-c.d.", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.255", "1.2.3", "9" * 3000,
    "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111  1111 1111 1111", "4111111111111111", "+1 (212) 555-0100", "+12", "+1+2 345 678 9012", "+1 " + "(" * 500 + "23456789012",
    "😀 a@b.co é 10.0.0.1 ü +49 170 1234567", "378282246310005 6011111111111117 30569309025904", "+4111111111111111 x", "0 0 0 0 0 0 0 0 0 0 0 0 0 0",
    "a.b@c.d " * 300, "1 " * 4000, "%+-._@x.y", "ip=10.1.1.1:80,", "line\n4111 1111\n1111 1111",
]


def test_base_spans(spark):
    rows = odd_rows() + [(100 + i, t, None, None, None) for i, t in enumerate(TRICKY)]
    found = {r["doc_id"]: r["b"] for r in personal_data(documents(spark, rows, True)).select("doc_id", listed("base").alias("b")).collect()}
    for r in rows:
        if r[0] is not None:
            assert found[r[0]] == brute(r[1] or ""), r[1][:60]
    assert personal_data(documents(spark, rows)).count() == len(rows)


def test_empty(spark):
    assert personal_data(documents(spark, [])).count() == 0
    assert sanitised(documents(spark, [])).count() == 0


def corpus():
    rows = []
    for i in range(6):
        rows.append((i, f"{words(i, 30)}\n{words(40 + i, 3)} Zaphodius {words(50 + i, 2)} boss@hq.org {words(60 + i, 4)} common end", None, None, None))
    # `common` also stands far from the entity; a copied line is one context, whatever its copies.
    rows += [(20 + i, f"{words(80 + i, 20)} common words here", None, None, None) for i in range(30)]
    rows += [(60 + i, "copied quixotry near copy@hq.org line", None, None, None) for i in range(9)]
    rows.append((90, "Only ZAPHODIUS, and zaphodiusx", None, None, None))
    return rows


def test_terms_that_disclose(spark):
    rows = corpus()
    texts = identified(documents(spark, rows))
    found = texts.select("text", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)
    terms = {r["term"]: r["disclosure"] for r in disclosing_terms(texts, found).collect()}
    assert "zaphodius" in terms and 0.9 <= terms["zaphodius"] <= 1
    assert not {"common", "copied", "quixotry", "near"} & terms.keys()
    spans = {r["doc_id"]: [s["match"] for s in r["spans"]] for r in personal_data(documents(spark, rows)).collect()}
    assert spans[90] == ["ZAPHODIUS"]
    assert "Zaphodius" in spans[0] and "boss@hq.org" in spans[0]
    assert spans[20] == []


def test_a_name_among_four_entities(spark):
    # The name stands once a line, but in the contexts of all four: it is counted by its places, not by contexts.
    rows = [(i, f"{words(200 + i, 30)}\n{words(300 + i, 2)} boss@hq.org +1 (212) 555-0100 Zaphodius 10.1.2.3 {words(400 + i, 2)} 4111 1111 1111 1111", None, None, None) for i in range(16)]
    texts = identified(documents(spark, rows))
    found = texts.select("text", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)
    assert {s["kind"] for s in found.first()["spans"]} == set(KINDS)
    terms = {r["term"]: r["disclosure"] for r in disclosing_terms(texts, found).collect()}
    assert abs(terms["zaphodius"] - 1) < 1e-9
    assert all("Zaphodius" not in r["text"] for r in sanitised(documents(spark, rows)).collect())


def test_replacement(spark):
    rows = corpus() + [(91, "card 4111 1111 1111 1111, +1 (212) 555-0100.", "en", "s", 9), (92, None, None, None, None), (None, "null id a@b.co", None, None, None)]
    out = {r["doc_id"]: r for r in sanitised(documents(spark, rows, True)).collect()}
    assert len(out) == len(rows)
    assert out[91]["text"] == "card [CARD], [PHONE]." and out[91]["n_chars"] == len("card [CARD], [PHONE].") and out[91]["kept"] == "other"
    assert out[92]["text"] is None
    assert out[None]["text"] == "null id [EMAIL]"
    assert out[20]["text"] == next(r[1] for r in rows if r[0] == 20)
    assert "boss@hq.org" not in out[3]["text"] and "aphodius" not in out[3]["text"]


def test_very_many_spans_in_one_text(spark):
    text = "".join(f"mail u{i}@host{i % 7}.org or 10.0.{i % 256}.1; " for i in range(32_000))
    rows = [(1, text, "en", "s", 0)]
    docs = documents(spark, rows)
    spans = identified(docs).select("text", base_spans(F.col("text")).alias("spans"))
    row = spans.select(listed("spans").alias("listed"), replaced(F.col("text"), F.col("spans")).alias("out")).first()
    assert row["listed"] == brute(text)
    assert row["out"] == "mail [EMAIL] or [IP]; " * 32_000


def test_overlapping_spans_across_runs(spark):
    """The first of overlapping spans names them, also where a span reaches over many later ones."""
    spans = [(0, 3, "email"), (5, 40, "card")] + [(i, i + 2, "ip") for i in range(6, 60, 3)] + [(70, 75, "removed"), (74, 78, "phone")]
    text = "".join(chr(97 + i % 26) for i in range(90)) + "\U0001F600z"
    at, out = 0, ""
    for a, b, kind in spans:
        if a >= at:
            out += text[at:a] + ("" if kind == "removed" else f"[{kind.upper()}]")
        at = max(at, b)
    df = spark.createDataFrame([(text, spans), (text, []), ("", [])], "t string, s array<struct<start:int,end:int,kind:string>>")
    assert [r["o"] for r in df.select(replaced(F.col("t"), F.col("s")).alias("o")).collect()] == [out + text[at:], text, ""]


def test_contexts_are_bounded(spark):
    text = " ".join(["word"] * 5000) + " a@b.co " + " ".join(["other"] * 5000)
    df = spark.createDataFrame([(text,)], "text string").select("text", base_spans(F.col("text")).alias("spans"))
    assert [r["terms"] for r in contexts(df).collect()] == [["word", "other"]]


def test_no_python_on_the_main_path(spark):
    plan = personal_data(documents(spark, odd_rows()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

"""Chat windows: digests against a direct computation, the budget, the mask, and forged control strings."""

import hashlib
import random
import re

from pyspark.sql import functions as F
from samples import words

from seqloom.llm.chat_windows import BUDGET, END, FORGED, HISTORY, MARKUP, OPEN, SHUT, chat_windows, digests, escaped, read_back, unescaped

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tokens(text: str) -> int:
    return len(re.findall(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+", text)) + MARKUP


def conversations():
    draw = random.Random(4)
    rows = [(-7, 0, "user", FORGED), (-7, 1, "assistant", FORGED)]
    for c in range(25):
        turn = 0
        if c % 2:
            rows.append((c, turn, "system", words(1000 + c, draw.randint(1, 60))))
            turn = 1
        for k in range(draw.choice([1, 2, 7, 60])):
            rows.append((c, turn + k, "user" if k % 2 == 0 else "assistant", words(c * 100 + k, draw.randint(0, 150))))
    return rows


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        loss = "".join(t for _, role, t in own if role == "assistant")
        out[c] = (len(own), sha("".join(f"{role}\n{t}\n" for _, role, t in own)), len(loss), sha(loss))
    return out


def results(spark, rows, clashing=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        df = df.selectExpr("*", "'x' AS pos", "'x' AS tokens", "'x' AS window", "'x' AS parts")
    read = digests(read_back(chat_windows(df)))
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in read.collect()}


def test_read_back(spark):
    rows = conversations()
    assert results(spark, rows, clashing=True) == expected(rows)


def test_odd_rows(spark):
    rows = [
        (1, 0, None, None), (1, 1, "assistant", ""), (2, None, "user", "no turn"), (2, 1, "assistant", "x\\l<s>[a]\\b\n]"),
        (3, 0, "system", "only"), (4, 0, "a]b[c<d\\", "role with marks"), (None, 0, "user", "no id"), (None, 1, "assistant", "still"),
        (5, 0, "user", "twice"), (5, 0, "user", "twice"), (6, 0, "user", "tie b"), (6, 0, "assistant", "tie a"), (7, 0, "user", "y" * 200_000), (7, 1, "assistant", "z " * 5000),
    ]
    assert results(spark, rows) == expected(rows)


def test_empty(spark):
    assert results(spark, []) == {}


def test_windows_keep_budget_system_and_history(spark):
    rows = conversations()
    sizes = {}
    for r in rows:
        sizes.setdefault(r[0], []).append((r[1], tokens(r[3]), r[2]))
    seen = {}
    for w in chat_windows(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "window").collect():
        own = sorted(sizes[w["conv_id"]])
        places = [p["pos"] for p in w["parts"]]
        fresh = [p["pos"] for p in w["parts"] if p["fresh"]]
        total = sum(own[p - 1][1] for p in places)
        assert total <= BUDGET or len(fresh) == 1 or (len(fresh) == 2 and own[0][2] == "system")
        if own[0][2] == "system":
            assert places[0] == 1
        repeated = [p for p in places if p not in fresh and not (p == 1 and own[0][2] == "system")]
        assert sum(own[p - 1][1] for p in repeated) <= HISTORY
        assert all(not p["loss"] for p in w["parts"] if p["pos"] in repeated)
        assert w["text"].count(OPEN) == w["text"].count(END) == len(places)
        seen.setdefault(w["conv_id"], []).extend(fresh)
    assert all(f == list(range(1, len(sizes[c]) + 1)) for c, f in seen.items())


def test_escapes_are_reversible(spark):
    texts = [FORGED, "\\l\\o\\b\\c", "<[\\]>", OPEN + SHUT + END, "", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r["u"] == r["t"]
        assert not set("<[]") & set(r["e"])


def test_no_python_on_the_main_path(spark):
    plan = digests(read_back(chat_windows(spark.createDataFrame(conversations(), SCHEMA))))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

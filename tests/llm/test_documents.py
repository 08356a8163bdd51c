"""Line rules, language, quality and near duplicates against brute force, with odd rows and hot groups."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from samples import documents, got, odd_rows, words

from seqloom.llm import language_id, line_quality, near_duplicates as near
from seqloom.llm.components import components
from seqloom.llm.crf import forward_backward
from seqloom.llm.line_frequency import LEAST, OP2_SQL, RESULT, Limits, line_rules, ruled_documents

BLANK = r"[^\x20\x09-\x0D]+"


def rules_by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [(r[0], r[1].replace("\0", "?") if r[1] else r[1], *r[2:]) for r in rows])
    out = con.execute(OP2_SQL)
    names = [d[0] for d in out.description]
    return sorted((tuple(dict(zip(names, r))[c] for c in RESULT) for r in out.fetchall()), key=repr)


def boilerplate_rows():
    rows = []
    for i in range(40):
        own = words(i, 12 if i % 3 else 60)
        rows.append((200 + i, f"Cookie  Notice {i} for all\n{own}\n" + words(500, 25), "en", "hot", 1))
    rows += [(300 + i, f"{words(500, 25)}\n{words(700 + i, 40)}", "en", "cold", 1) for i in range(LEAST)]
    return rows


def test_line_rules_match_sql(spark):
    rows = odd_rows() + boilerplate_rows() + [(400, "a b c d e f\na b c d e f\n\na b c d e", "en", "hot", 1)]
    mine = got(line_rules(documents(spark, [(r[0], r[1].replace("\0", "?") if r[1] else r[1], *r[2:]) for r in rows], True)), *RESULT)
    assert mine == rules_by_sql(rows)
    kept = {r[0]: r[-1] for r in mine}
    assert not kept[201] and kept[203] and kept[300]


def test_ruled_documents_lose_their_frequent_lines(spark):
    out = {r["doc_id"]: r for r in ruled_documents(documents(spark, boilerplate_rows(), True)).collect()}
    assert 201 not in out
    assert out[203]["text"] == words(3, 60) and out[203]["n_chars"] == len(out[203]["text"]) and out[203]["kept"] == "other"
    assert out[300]["text"].startswith(words(500, 25))


def test_copies_count_once(spark):
    rows = [(i, words(1, 40), "en", "s", 1) for i in range(50)]
    assert all(r[0] for r in got(line_rules(documents(spark, rows)), "kept"))
    assert line_rules(documents(spark, []), Limits()).count() == 0


def test_a_line_in_many_documents_goes_from_a_host_of_any_size(spark):
    rows = [(i, f"{words(500, 25)}\n{words(900 + i, 30)}" if i < 40 else words(2000 + i, 20), "en", "large", 1) for i in range(600)]
    docs = documents(spark, rows)
    assert line_rules(docs).where("removed_words > 0").count() == 0
    assert line_rules(docs, Limits(ceiling=30)).where("removed_words > 0").count() == 40


def brute_chain(emission, sizes, transition):
    out, at = [], 0
    k = emission.shape[1]
    for n in sizes:
        e = emission[at : at + n]
        at += n
        weight = np.zeros((n, k))
        for path in np.ndindex(*[k] * n):
            w = np.exp(sum(e[i, s] for i, s in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
            for i, s in enumerate(path):
                weight[i, s] += w
        out.append(weight / weight.sum(axis=1, keepdims=True) if n else weight)
    return np.concatenate(out)


def test_forward_backward_against_all_paths():
    draw = np.random.default_rng(1)
    sizes = np.array([3, 0, 1, 5, 2, 0])
    emission, transition = draw.normal(size=(int(sizes.sum()), 3)) * 3, draw.normal(size=(3, 3))
    marginal, expected, _ = forward_backward(emission, sizes, transition)
    assert np.allclose(marginal, brute_chain(emission, sizes, transition))
    assert np.isclose(expected.sum(), sum(max(n - 1, 0) for n in sizes))


def test_shared_features_are_hashed_once(monkeypatch):
    hashed = []
    monkeypatch.setattr(language_id, "_shared", language_id.Buckets())
    monkeypatch.setattr(language_id, "_bucket", lambda f, whole=language_id._bucket: hashed.append(f) or whole(f))
    first, again = language_id.features("kartol"), language_id.features("kartol")
    assert sorted(first) == sorted(again) and hashed.count("<ka") == 1 and hashed.count("wkartol") == 2
    edged = "<kartol>"
    named = {"wkartol"} | {f"p{'kartol'[:k]}" for k in (1, 2, 3, 4)} | {f"s{'kartol'[-k:]}" for k in (1, 2, 3, 4)}
    named |= {edged[i : i + k] for k in (2, 3) for i in range(len(edged) - k + 1)}
    assert set(hashed) == named and len(first) == len(named)
    assert all(len(language_id.features(w)) for w in ("é", "ab", "pp", "\ud800"))


TONGUES = {"xx": "kar tol mek", "yy": "ssie aouä eié", "zz": "pqu zvr wxj"}


def tongue_rows(n=60):
    draw = random.Random(2)
    rows = []
    for i in range(n):
        lang = draw.choice(sorted(TONGUES))
        parts = TONGUES[lang].split()
        rows.append((i, " ".join("".join(draw.choices(parts, k=2)) for _ in range(30)), lang, "s", 1))
    return rows


def test_language_of_held_out_and_odd_rows(spark):
    docs = documents(spark, tongue_rows() + [(900, None, "xx", None, 0), (901, "123 ... !", "yy", None, 0), (None, "kartol mektol", None, None, 0), (902, "", None, None, 0), (903, "kartol " * 50_000, None, None, 0)], True)
    model = language_id.learned(language_id.training_sample(docs))
    out = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(out[r[0]]["lang_pred"] == r[2] for r in tongue_rows())
    assert out[900]["lang_pred"] == out[901]["lang_pred"] == out[902]["lang_pred"] == "und" and out[900]["score"] == 0
    assert out[None]["lang_pred"] == out[903]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in out.values()) and {r["held_out"] for r in out.values()} == {True, False}


def test_language_labels_code_switched_words(spark):
    model = language_id.learned([(r[1], r[2]) for r in tongue_rows()])
    share = model.shares([("kartol mekkar tolmek " * 5 + "ssieaouä eiéssie " * 5).split()])[0]
    assert share[model.languages.index("xx")] > 0.3 and share[model.languages.index("yy")] > 0.3


def test_digits_and_signs_are_no_letters(spark):
    rows = [(i, words(i % 7, 30), "en", "a", 1) for i in range(40)] + [(100, "² ½ ٣ ① 12 _", "en", "a", 1), (101, "ñ", None, "a", 1)]
    docs = documents(spark, rows)
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, language_id.learned(language_id.training_sample(docs))).collect()}
    assert out[100] == "und" and out[101] == "en"


def test_training_draws_from_the_whole_text(spark):
    texts = ["alpha " * 5000 + "omega " * 5000, "beta gamma"]
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    long, short = (t for t, _ in language_id.training_sample(docs))
    assert short == "beta gamma" and 250 < len(long.split()) < 600 and 0.3 < long.count("omega") / len(long.split()) < 0.7
    lines = documents(spark, [(1, "\n".join(f"line {i}" for i in range(20_000)), "en", "a", 1)])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    drawn = [int(x.split()[1]) for x in line_quality.training_sample(lines, labels)[0][0].split("\n")]
    assert 80 < len(drawn) < 400 and max(drawn) > 15_000 and drawn == sorted(drawn) and all(d % 10 == 9 or d + 1 in drawn for d in drawn)


def test_language_without_labels(spark):
    docs = documents(spark, [(1, "kar", None, None, 0)])
    assert language_id.training_sample(docs) == []
    assert [r["lang_pred"] for r in language_id.identify(docs, None).collect()] == ["und"]
    assert language_id.identify(documents(spark, []), None).count() == 0


def quality_rows():
    rows = []
    for i in range(120):
        good = i % 3 > 0
        lines = [" ".join(w + ("" if good else "$$$") for w in words(i * 10 + k, 12).split()).capitalize() + ("." if good else "") for k in range(4)]
        rows.append((i, "\n".join(lines), None, None, 1))
    return rows


def test_quality_of_held_out_and_odd_rows(spark):
    docs = documents(spark, quality_rows() + odd_rows(), True)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)] + [(5000, 1, 0), (None, 0, 0), (1, None, 1)], "doc_id bigint, quality int, toxic int")
    # Ids of odd rows are labelled, too; one text each for training keeps them apart from the model's rows.
    model = line_quality.model_from(documents(spark, quality_rows()), labels)
    out = line_quality.scored(docs, model).collect()
    assert len(out) == 120 + len(odd_rows()) and all(0 <= r["score"] <= 1 for r in out)
    plain = {r["doc_id"]: r for r in line_quality.scored(documents(spark, quality_rows()), model).collect()}
    assert all(plain[i]["predicted"] == int(i % 3 > 0) for i in range(120))
    assert line_quality.good_documents(documents(spark, quality_rows(), True), model).count() == 80
    assert line_quality.model_from(docs, labels.limit(0)) is None
    assert line_quality.scored(documents(spark, []), model).count() == 0


def shingles(text):
    w = re.findall(BLANK, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].add(i)
    for i, s in enumerate(sets):
        for j in set().union(*(holders[x] for x in s)) if s else ():
            if j < i and 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                parent[root(i)] = root(j)
    first = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            first[root(i)] = min(first.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), first.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def edited(text, seed, share):
    draw = random.Random(seed)
    return " ".join("zz" + str(draw.randint(0, 999)) if draw.random() < share else w for w in text.split())


def test_near_duplicates_against_brute_force(spark):
    rows = odd_rows() + [(20, "One  two", None, None, 0), (21, "one\ttwo\n", None, None, 0), (22, words(1, 80).upper(), None, None, 0)]
    for g in range(12):
        base = words(3000 + g, 150)
        rows += [(1000 + 50 * g + k, edited(base, 70 * g + k, (0.004, 0.012, 0.03)[k % 3]), None, None, 0) for k in range(12)]
    found = near.near_duplicates(documents(spark, rows, True))
    assert got(found, "doc_id", "n_shingles", "component_id") == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())


def test_hot_groups_of_copies_and_of_a_common_passage(spark, monkeypatch):
    # With a low limit the large buckets over several components are divided.
    monkeypatch.setattr(near, "ACROSS", 2)
    monkeypatch.setattr(near, "PART", 16)
    base, passage = words(5000, 200), words(5001, 120)
    rows = [(k, base, None, None, 0) for k in range(150)] + [(200 + k, edited(base, k, 0.008), None, None, 0) for k in range(150)]
    rows += [(400 + k, passage + " " + words(6000 + k, 60), None, None, 0) for k in range(150)]
    rows += [(600 + k, passage + " " + words(6000 + k // 2, 58 + k % 2), None, None, 0) for k in range(40)]
    assert got(near.near_duplicates(documents(spark, rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def swapped(text, seed, count):
    """The text with `count` words apart from each other replaced: each takes SHINGLE shingles with it."""
    draw, parts = random.Random(seed), text.split()
    for at in draw.sample(range(5, len(parts) - 5, 6), count):
        parts[at] = f"zz{seed}x{at}"
    return " ".join(parts)


@pytest.mark.parametrize("block", [1024, 32])
def test_links_just_above_the_limit_inside_a_hot_group(spark, monkeypatch, block):
    # All share a template (about 0.6 of each other); every third has one partner at 0.75 to 0.78.
    monkeypatch.setattr(near, "ACROSS", 2)
    monkeypatch.setattr(near, "BLOCK_SETS", block)
    template = words(8000, 204)
    rows = [(k, f"{template} {words(8100 + k, 66)}", None, None, 0) for k in range(300)]
    rows += [(1000 + k, swapped(rows[k][1], k, 7), None, None, 0) for k in range(0, 300, 3)]
    sets = [shingles(r[1]) for r in rows]
    between = [len(sets[0] & s) / len(sets[0] | s) for s in sets[1:300]]
    linked = [len(sets[k] & sets[300 + k // 3]) / len(sets[k] | sets[300 + k // 3]) for k in range(0, 300, 3)]
    assert max(between) < 0.66 and 0.75 <= min(linked) and max(linked) < 0.79
    assert got(near.near_duplicates(documents(spark, rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_one_document_of_each_group_stays(spark):
    rows = odd_rows() + [(50, words(1, 80) + " more", None, None, 0), (50, words(1, 80) + " more", None, None, 0), (51, words(77, 20), None, None, 0), (51, words(77, 20), None, None, 0)]
    kept = near.first_of_each(documents(spark, rows, True))
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[5] == 0 and ids[50] == 0 and ids[51] == 1 and ids[9] == 1 and ids[2] == ids[3] == 1
    assert near.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(40)] + [(100, 101), (101, 100)], [(i, (7 * i) % 97) for i in range(97)]])
def test_components(spark, edges):
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = sorted((n, root(n)) for n in parent if any(root(m) == root(n) and m != n for m in parent))
    assert sorted(map(tuple, components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())) == want

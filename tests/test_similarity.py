"""K-mer similarity against brute force, whatever the first step reads and however common k-mers are spread."""

import random

import pytest

from seqloom.operators import similarity


def kmers(s, k):
    return {s[i:i + k] for i in range(len(s) - k + 1)}


def brute_max(query, known, k):
    q = kmers(query, k)
    if not q:
        return None, None
    both = [(len(q & kmers(r, k)), len(q | kmers(r, k))) for r in known]
    return max(i / len(q) for i, _ in both), max(i / u for i, u in both)


def brute_nearest(query, known, k, n):
    q, seen, scored = kmers(query, k), set(), []
    for i, r in enumerate(known):
        if r in seen or r == query:
            continue
        seen.add(r)
        shared = len(q & kmers(r, k))
        if shared:
            scored.append((-shared, i))
    return [(i, -s / len(q)) for s, i in sorted(scored)[:n]]


@pytest.fixture(scope="module")
def texts():
    """A third of the references are near copies of one text; some are exact copies; some are short."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ACDE") for _ in range(n))
    base = word(60)
    near = []
    for _ in range(20):
        i = rng.randrange(60)
        near.append(base[:i] + rng.choice("ACDE") + base[i + 1:])
    known = near + [word(rng.randrange(5, 50)) for _ in range(35)] + [base, base, "AC", ""]
    rng.shuffle(known)
    queries = [near[0], near[3], base] + [word(rng.randrange(1, 60)) for _ in range(25)] + [known[7][:30], "ACDE"]
    return queries, known


def frames(spark, texts):
    queries, known = texts
    q = spark.createDataFrame([(i, s) for i, s in enumerate(queries)], "doc_id bigint, sequence string")
    r = spark.createDataFrame([(i, s) for i, s in enumerate(known)], "known_id bigint, sequence string")
    return q, r


@pytest.mark.parametrize("share, part", [(0.01, 2), (0.25, 4096), (1.0, 5)])
def test_max_similarity_matches_brute_force(spark, texts, share, part, monkeypatch):
    monkeypatch.setattr(similarity, "FIRST_SHARE", share)
    monkeypatch.setattr(similarity, "PER_PART", part)
    q, r = frames(spark, texts)
    got = {row["doc_id"]: row for row in similarity.max_similarity(q, r, "doc_id", k=4).collect()}
    assert len(got) == len(texts[0])
    for i, query in enumerate(texts[0]):
        containment, jaccard = brute_max(query, texts[1], 4)
        assert got[i]["max_containment"] == pytest.approx(containment), query
        assert got[i]["max_jaccard"] == pytest.approx(jaccard), query


@pytest.mark.parametrize("share, part", [(0.01, 2), (0.25, 4096), (1.0, 5)])
@pytest.mark.parametrize("n", [1, 3])
def test_nearest_neighbours_match_brute_force(spark, texts, share, part, n, monkeypatch):
    monkeypatch.setattr(similarity, "FIRST_SHARE", share)
    monkeypatch.setattr(similarity, "PER_PART", part)
    q, r = frames(spark, texts)
    rows = similarity.nearest_neighbours(q, r, "doc_id", k=4, n=n).collect()
    for i, query in enumerate(texts[0]):
        found = sorted((row["neighbour"], row["ref_id"], row["containment"]) for row in rows if row["doc_id"] == i)
        wanted = brute_nearest(query, texts[1], 4, n)
        assert [(ref, c) for _, ref, c in found] == [(ref, pytest.approx(c)) for ref, c in wanted]


def test_novelty_report(spark, texts):
    q, r = frames(spark, texts)
    rows = {row["doc_id"]: row for row in similarity.novelty_report(q, r, "doc_id", k=4).collect()}
    for i, query in enumerate(texts[0]):
        assert rows[i]["novel_exact"] == (query not in texts[1])
        assert rows[i]["length"] == len(query)


def test_semi_and_anti_split_the_rows(spark, texts):
    q, r = frames(spark, texts)
    old = {row["doc_id"] for row in similarity.known_only(q, r).collect()}
    new = {row["doc_id"] for row in similarity.novel_only(q, r).collect()}
    assert old | new == set(range(len(texts[0]))) and not old & new
    assert old == {i for i, s in enumerate(texts[0]) if s in texts[1]}


def test_common_kmers_of_near_copies_are_not_looked_up(spark, monkeypatch):
    """Queries close to a reference leave their commonest k-mers unread, though all references hold them."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ACDEFGHIKL") for _ in range(n))
    common = word(30)
    known = [word(40) + common for _ in range(300)]
    queries = [s[:20] + "M" + s[21:] for s in known[:50]]
    q, r = frames(spark, (queries, known))
    read = []
    met = similarity._met

    def watched(*args):
        rows = met(*args)
        read.append(rows.count())
        return rows

    monkeypatch.setattr(similarity, "_met", watched)
    got = {row["doc_id"]: row for row in similarity.max_similarity(q, r, "doc_id", k=5).collect()}
    assert sum(read) < 50 * 300 / 10
    for i, query in enumerate(queries):
        containment, jaccard = brute_max(query, known, 5)
        assert (got[i]["max_containment"], got[i]["max_jaccard"]) == (pytest.approx(containment), pytest.approx(jaccard))


def test_tied_references_are_not_all_given_out(spark):
    """Every reference shares the same k-mers with every query: a query gives out a few of them, the smallest ids."""
    rng = random.Random(3)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    common = word(30, "ACDE")
    queries = [word(20, "FGH") + common for _ in range(40)]
    known = [common + word(20, "KLM") for _ in range(200)]
    q, r = frames(spark, (queries, known))
    pairs = similarity.overlaps(
        similarity.distinct_sequences(q, "doc_id", "sequence"), similarity.distinct_sequences(r, "known_id", "sequence"), 5, 2
    ).collect()
    assert len(pairs) <= 40 * 3
    rows = similarity.nearest_neighbours(q, r, "doc_id", k=5, n=2).collect()
    assert {(row["doc_id"], row["neighbour"], row["ref_id"]) for row in rows} == {(i, n, n - 1) for i in range(40) for n in (1, 2)}


def test_many_letters_and_long_kmers(spark):
    """More different k-mers than codes hold are numbered afresh on the way; any letters do."""
    rng = random.Random(4)
    letters = [chr(c) for c in (*range(0x41, 0x7F), *range(0x400, 0x500), *range(0x1F600, 0x1F640))]
    known = ["".join(rng.choice(letters) for _ in range(80)) for _ in range(20)]
    queries = [s[10:50] + known[0][:15] for s in known] + ["ab"]
    q, r = frames(spark, (queries, known))
    got = {row["doc_id"]: row for row in similarity.max_similarity(q, r, "doc_id", k=11).collect()}
    for i, query in enumerate(queries):
        containment, jaccard = brute_max(query, known, 11)
        assert (got[i]["max_containment"], got[i]["max_jaccard"]) == (pytest.approx(containment), pytest.approx(jaccard))


def test_no_sequence_is_shuffled_for_every_part(spark, texts, monkeypatch):
    """Parts meet in a product of packed rows; what a task gives out does not grow with the parts it has met."""
    monkeypatch.setattr(similarity, "PER_PART", 4)
    monkeypatch.setattr(similarity, "RUNS", 2)
    monkeypatch.setattr(similarity, "TASKS", 2)
    q, r = frames(spark, texts)
    pairs = similarity.overlaps(similarity.distinct_sequences(q, "doc_id", "sequence"), similarity.distinct_sequences(r, "known_id", "sequence"), 4, 1)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan and plan.count("Exchange") == 2
    rows = pairs.collect()
    assert len(set(rows)) == len(rows)
    assert max(sum(row["query_id"] == i for row in rows) for i in range(len(texts[0]))) <= 2 * 2
    for i, query in enumerate(texts[0]):
        found = [row["shared"] / (row["n_query"] + row["n_ref"] - row["shared"]) for row in rows if row["query_id"] == i]
        if len(query) >= 4 and texts[0].index(query) == i:
            assert max(found, default=0) == pytest.approx(brute_max(query, texts[1], 4)[1])


def test_runs_of_parts():
    assert [similarity._runs(q, r) for q, r in ((1, 1), (150, 1), (1, 150), (28, 28), (900, 900))] == [1, 1, 64, 16, 57]


def test_rows_kept_of_a_run():
    import pyarrow as pa

    rng = random.Random(8)
    rows = [(q, r, 20, rng.randrange(20, 90), rng.randrange(1, 20)) for q in (3, None, 1) for r in range(30)]
    rng.shuffle(rows)
    names = ["query_id", "ref_id", "n_query", "n_ref", "shared"]
    kept = similarity._kept(pa.table([pa.array(c) for c in zip(*rows)], names), 2).to_pylist()
    for q in (3, None, 1):
        own, mine = [tuple(row.values()) for row in kept if row["query_id"] == q], [row for row in rows if row[0] == q]
        wanted = set(sorted(mine, key=lambda row: (-row[4], row[1]))[:2])
        best = max(row[4] / (row[2] + row[3] - row[4]) for row in mine)
        assert wanted <= set(own) and len(own) <= 3 and max(row[4] / (row[2] + row[3] - row[4]) for row in own) == best
    assert similarity._kept(pa.table([pa.array(c) for c in zip(*rows)], names).slice(0, 0), 2).num_rows == 0

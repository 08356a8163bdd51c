"""Spelling variants by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Of a pair the
longer word (of equally long ones the smaller) is cut into two disjoint chunks; the other gives positional
grams. The one edit falls into one chunk only, so the other chunk stands among the grams, at its own place
or, behind the edit, at most one place further left: how far, the two lengths tell. Grams at other places or
of other lengths can meet no chunk and are not made. The part that holds the edit is cut in two once more by
the same rule, so that a join key is a whole chunk and half of the other one: a beginning or an ending that
many words share is not a key by itself. Pairs that share a key are verified while they are joined; only
near ones become rows.

Forms are then followed to their roots by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.llm.common import documents, stored, table

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in DAMAGED (by a hash of document and run) loses a code point.
DAMAGED = 97
#: A form must be so many times as frequent as the word.
TIMES = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Maximal runs of at least LEAST_LENGTH; shorter ones give no word.
RUN = f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"
#: Pointer doublings that settle any chain: n at least doubles with every step of it, and n has 63 bits.
DOUBLINGS = 6


def words(docs: DataFrame) -> DataFrame:
    """word, n: the words of all documents with their occurrences."""
    runs = documents(docs, "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    # A null id hashes to null and damages nothing.
    hashed = low.select("run", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    at = F.expr("cast(h % length(run) AS int)")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def keys(length: Column, shorter: Column) -> Column:
    """The four join keys of `word` in pairs whose longer word has `length` code points; `shorter` is 1 where
    `word` is the shorter one of unlike lengths, else 0. A key says which chunk and which half are kept."""
    half = F.ceil(length / 2)
    rest, first = F.ceil((length - half) / 2), F.ceil(half / 2)

    def upto(place: Column) -> Column:
        return F.substring(F.col("word"), F.lit(1), place.cast("int"))

    def behind(place: Column) -> Column:
        return F.substring(F.col("word"), (place - shorter + 1).cast("int"), F.length("word"))

    return F.array(
        F.concat(F.lit("1:"), upto(half + rest)),
        F.concat(F.lit("2:"), upto(half), F.lit("|"), behind(half + rest)),
        F.concat(F.lit("3:"), upto(first), F.lit("|"), behind(half)),
        F.concat(F.lit("4:"), behind(first)),
    )


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """a, an, b, bn: every pair of near words with their counts, once."""
    length = F.length("word")
    chunks = vocabulary.select(F.col("word").alias("a"), F.col("n").alias("an"), length.alias("size"), F.explode(keys(length, F.lit(0))).alias("key"))
    alike = vocabulary.select("word", "n", length.alias("size"), F.explode(keys(length, F.lit(0))).alias("key"))
    longer = vocabulary.select("word", "n", (length + 1).alias("size"), F.explode(keys(length + 1, F.lit(1))).alias("key"))
    grams = alike.unionAll(longer).select(F.col("word").alias("b"), F.col("n").alias("bn"), "size", "key")
    apart = (F.length("b") < F.col("size")) | (F.col("a") < F.col("b"))
    met = chunks.join(grams, ["size", "key"]).where(apart & (F.levenshtein("a", "b", 1) == 1))
    # A pair can share more than one key where a letter repeats at a cut.
    return met.select("a", "an", "b", "bn").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root for every word that has a form (word, form)."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    for _ in range(DOUBLINGS):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            break
    return now.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of `docs`.

    Null and empty texts have no words; texts are read whole, whatever their length. Repeated rows count as often
    as they stand there; a row without an id is never damaged. Ties between forms go to the word smaller in code-point
    order. Without documents the result is empty; columns of other names are left out.
    """
    vocabulary = stored(words(docs))
    pairs = stored(near_pairs(vocabulary))
    both = pairs.unionAll(pairs.select("b", "bn", "a", "an").toDF("a", "an", "b", "bn"))
    # The least (-n, word) is the most frequent near word, of equal ones the smallest.
    best = both.groupBy("a", "an").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("bn"), "b")).alias("best")).select("*", (-F.col("best.col1")).alias("best_n"))
    enough = F.col("best_n") >= TIMES * F.col("an")
    formed = stored(best.select(F.col("a").alias("word"), "n_near", F.when(enough, F.col("best.b")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")))
    ends = roots(formed.where("form IS NOT NULL").select("word", "form"))
    joined = vocabulary.join(formed, "word", "left").join(ends, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


#: crc32 step by step over the bytes of `<doc_id>:<run>`; near words share what is left without one code point.
OP12_SQL = f"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
runs AS (SELECT doc_id, translate(r, '{UPPER}', '{LOWER}') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]{{{LEAST_LENGTH},}}')) AS r FROM documents) GROUP BY ALL),
hashed AS (SELECT run, k, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))),
    lambda s, b: xor(s >> 8, step[(xor(s, b) & 255) + 1])), 4294967295) AS h FROM runs, steps),
cut AS (SELECT k, CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
without AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near),
formed AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN other_n >= {TIMES} * w.n THEN other END AS form, CASE WHEN other_n >= {TIMES} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND place = 1),
chain AS (SELECT word, word AS root FROM formed UNION SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.root AND e.form IS NULL
"""


def op12_asymmetric_chunks(spark, folder):
    return spelling_variants(table(spark, folder, "documents"))

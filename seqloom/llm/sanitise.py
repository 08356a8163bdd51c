"""Personal data and the terms that give it away, with DataFrame functions only.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Their values are the protected
entities. Around each occurrence the NEAR words before and after are its context; corpus counts tell how
much a term says about an entity: IC(e) = log2(N / n(e)) is what there is to learn, PMI(e, t) =
log2(n(e, t) N / (n(e) n(t))) what the term tells, and their ratio, at most 1, is the disclosure. Terms that reach
DISCLOSED in enough different contexts are generalised wherever they stand; those that reach REMOVED are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.functions.hashing import let
from seqloom.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Possessive repeats do the same here and cannot overflow the stack on long
#: texts; a match begins where a run of its first characters begins or the last match ended, which is
#: where it would anyway, and spares trying every character of a long run.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before its pattern is worth running.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

NEAR, TERM_LETTERS, SUPPORT, DISCLOSED, REMOVED = 8, 3, 3, 0.9, 0.999
#: Characters of the text around an occurrence that its context is read from.
REACH = 40 * NEAR
FOUND = "array<struct<start:int,end:int,match:string>>"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,match:string>>"


def in_blocks(items: Column, body) -> Column:
    """`body` of each run of about sqrt(n) of the n items, in order (one empty run where there are none)."""
    size = F.greatest(F.ceil(F.sqrt(F.size(items))), F.lit(1)).cast("int")
    runs = F.greatest(F.ceil(F.size(items) / size), F.lit(1)).cast("int")
    each = lambda x: F.transform(F.sequence(F.lit(0), x["runs"] - 1), lambda j: body(F.slice(x["items"], j * x["size"] + 1, x["size"])))
    return let(F.struct(items.alias("items"), size.alias("size"), runs.alias("runs")), each)


def located(text: Column, pattern: Column) -> Column:
    """start, end (code points) and text of each match, from the matches and the gaps between them.

    Prefix sums on two levels, inside runs of about sqrt(n) matches and over the runs' lengths, so that an array is
    never extended more than sqrt(n) times and a text of very many matches takes little more than linear time.
    """
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    split = F.split(text, pattern, -1)
    steps = let(
        F.struct(matches.alias("matches"), split.alias("gaps")),
        lambda x: F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["matches"])), x["matches"], lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match"))),
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("found"))

    def step(held: Column, s: Column) -> Column:
        start = held["at"] + s["gap"]
        end = start + F.length(s["match"])
        return F.struct(end.alias("at"), F.concat(held["found"], F.array(F.struct(start.alias("start"), end.alias("end"), s["match"].alias("match")))).alias("found"))

    runs = in_blocks(steps, lambda run: F.aggregate(run, begin, step))
    before = lambda r: F.aggregate(r, F.array(F.lit(0)), lambda held, one: F.concat(held, F.array(F.element_at(held, -1) + one["at"])))
    moved = lambda m, by: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["match"].alias("match"))
    placed = lambda x: F.flatten(F.transform(x["runs"], lambda run, j: F.transform(run["found"], lambda m: moved(m, F.get(x["before"], j)))))
    return let(runs, lambda r: let(F.struct(r.alias("runs"), before(r).alias("before")), placed))


def luhn(digits: Column) -> Column:
    """Whether a string of 14 to 19 digits passes: every second digit from the right is doubled, nines cast out."""
    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.struct(F.substring(digits, -i, F.lit(1)).cast("int").alias("d"), (i % 2 == 0).alias("twice")))
    value = F.aggregate(places, F.lit(0), lambda s, p: s + F.when(p["twice"], 2 * p["d"] - F.when(p["d"] > 4, 9).otherwise(0)).otherwise(p["d"]))
    return value % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15)


def base_spans(text: Column) -> Column:
    """All valid base matches by start, then kind as listed."""

    def of(rank: int, kind: str) -> Column:
        found = F.when(text.rlike(NEEDED[kind]), located(text, F.lit(PATTERNS[kind]))).otherwise(F.array().cast(FOUND))
        right = F.filter(found, lambda m: valid(kind, m["match"]))
        return F.transform(right, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["match"].alias("match")))

    return F.array_sort(F.concat(*(of(r, k) for r, k in enumerate(KINDS))).cast(SPAN))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, and text (null reads as empty)."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


WORD = r"\p{L}+"


def contexts(found: DataFrame) -> DataFrame:
    """entity, context (a hash of its words) and its distinct terms, for every occurrence of an entity."""
    each = found.select("text", F.explode("spans").alias("s"))
    before = F.substring("text", F.greatest(F.col("s.start") - REACH, F.lit(0)) + 1, F.least(F.col("s.start"), F.lit(REACH)))
    after = F.substring("text", F.col("s.end") + 1, F.lit(REACH))
    # Base matches never span a line end, and a context stays in its line.
    left = F.regexp_extract_all(F.lower(F.element_at(F.split(before, "\n", -1), -1)), F.lit(WORD), F.lit(0))
    right = F.regexp_extract_all(F.lower(F.element_at(F.split(after, "\n", -1), 1)), F.lit(WORD), F.lit(0))
    words = F.concat(F.slice(left, F.greatest(F.size(left) - NEAR, F.lit(0)) + 1, F.lit(NEAR)), F.slice(right, F.lit(1), F.lit(NEAR)))
    entity = F.concat_ws(":", "s.kind", F.lower("s.match"))
    terms = F.array_distinct(F.filter("words", lambda w: F.length(w) >= TERM_LETTERS))
    return each.select(entity.alias("entity"), words.alias("words")).select("entity", F.xxhash64("words").alias("context"), terms.alias("terms"))


def disclosing_terms(texts: DataFrame, found: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """term and disclosure (the largest over the entities) of terms that reach the threshold.

    `found` holds text and spans of the documents with entities. The pair must meet in `support`
    different contexts, so that copies of a passage are no evidence.
    """
    seen = stored(contexts(found))
    entities = seen.groupBy("entity").agg(F.count("*").alias("ne"), F.count_distinct("context").alias("different")).where(F.col("different") >= support)
    every = seen.select("entity", "context", F.explode("terms").alias("term"))
    pairs = every.join(entities.select("entity"), "entity", "left_semi")
    met = pairs.groupBy("entity", "term").agg(F.count("*").alias("net"), F.count_distinct("context").alias("different")).where(F.col("different") >= support)
    # N: places a word can stand at, taken as a sixth of the characters.
    total = texts.agg(F.greatest(F.sum(F.length("text")) / 6, F.lit(2.0)).alias("n"))
    met = stored(met.join(entities.select("entity", "ne"), "entity").crossJoin(F.broadcast(total)))
    # The corpus counts decide alone: contexts overlap, so a term can be in more of them than it has places.
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("term"))
    counts = words.groupBy("term").agg(F.count("*").alias("nt"))
    joined = counts.join(met, "term").withColumn("disclosure", disclosure(F.col("nt")))
    return joined.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= disclosed)


def disclosure(nt: Column) -> Column:
    """PMI / IC of a pair that meets in `net` contexts of `ne`, the term standing at `nt` places of `n`."""
    net, ne, n = F.col("net"), F.col("ne"), F.col("n")
    return F.log2(F.least(net, nt) * n / (ne * nt)) / F.log2(F.greatest(n / ne, F.lit(2.0)))


def term_spans(texts: DataFrame, terms: DataFrame, removed: float = REMOVED) -> DataFrame:
    """doc_id, digest and spans of the disclosing terms, for documents that hold some: kind `removed` or `term`."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("term")
    held = texts.select("doc_id", "digest", words).join(terms, "term").distinct()
    per_doc = held.groupBy("doc_id", "digest").agg(F.collect_list(F.when(F.col("disclosure") >= removed, F.col("term"))).alias("out"), F.collect_list(F.when(F.col("disclosure") < removed, F.col("term"))).alias("general"))
    # Stored, so that its size is known and texts are not shuffled to meet a few rows.
    t, p = texts.alias("t"), stored(per_doc).alias("p")
    both = t.join(p, F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.digest") == F.col("p.digest")))

    def of(rank: int, kind: str, terms: Column) -> Column:
        # Terms are letters only; matched whole and in either case.
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(terms, "|"), F.lit(r")(?!\p{L})"))
        found = F.when(F.size(terms) > 0, located(F.col("t.text"), pattern)).otherwise(F.array().cast(FOUND))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["match"].alias("match")))

    spans = F.concat(of(len(KINDS), "term", F.col("p.general")), of(len(KINDS) + 1, "removed", F.col("p.out"))).cast(SPAN)
    return both.select("p.doc_id", "p.digest", spans.alias("more")).dropDuplicates(["doc_id", "digest"])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, digest, base (spans of the patterns) and spans (those and the disclosing terms) of every document.

    A null text reads as empty and has none. Repeated rows give repeated results. Term spans that touch a base span are left out.
    """
    texts = identified(docs)
    base = stored(texts.select("doc_id", "digest", F.when(F.col("text").rlike("[0-9@]"), base_spans(F.col("text"))).otherwise(F.array().cast(SPAN)).alias("base"), F.col("text")).select("doc_id", "digest", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")))
    found = base.where(F.size("base") > 0).select("text", F.col("base").alias("spans"))
    more = term_spans(texts, stored(disclosing_terms(texts, found))).alias("m")
    b = base.drop("text").alias("b")
    joined = b.join(more, F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("b.digest") == F.col("m.digest")), "left")
    apart = F.filter(F.coalesce("m.more", F.array().cast(SPAN)), lambda t: ~F.exists(F.col("b.base"), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return joined.select("b.doc_id", "b.digest", "b.base", F.array_sort(F.concat("b.base", apart)).alias("spans"))


def listed(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span as its kind in brackets, `removed` ones gone; of overlapping spans the first names it.

    Runs of about sqrt(n) spans are replaced each in its own stretch of the text, so no step reads the text from its
    start; a run begins where the furthest span of the runs before it ends.
    """

    def within(x: Column, run: Column, at: Column, to: Column) -> Column:
        def step(held: Column, s: Column) -> Column:
            sign = F.when(s["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            gap = F.substring(held["part"], held["at"] - held["origin"] + 1, s["start"] - held["at"])
            whole = F.struct(held["origin"].alias("origin"), held["part"].alias("part"), s["end"].alias("at"), F.concat(held["out"], gap, sign).alias("out"))
            inside = F.struct(held["origin"].alias("origin"), held["part"].alias("part"), F.greatest(held["at"], s["end"]).alias("at"), held["out"].alias("out"))
            return F.when(s["start"] >= held["at"], whole).otherwise(inside)

        begin = F.struct(at.alias("origin"), F.substring(x["text"], at + 1, to - at).alias("part"), at.alias("at"), F.lit("").alias("out"))
        return F.aggregate(run, begin, step)["out"]

    ends = lambda runs: F.aggregate(
        runs, F.array(F.lit(0)),
        lambda held, run: F.concat(held, F.array(F.aggregate(run, F.element_at(held, -1), lambda e, s: F.greatest(e, s["end"])))),
    )

    def joined(x: Column) -> Column:
        parts = F.transform(x["runs"], lambda run, j: within(x, run, F.get(x["ends"], j), F.get(x["ends"], j + 1)))
        return F.concat(F.array_join(parts, ""), F.substring(x["text"], F.element_at(x["ends"], -1) + 1, F.length(x["text"])))

    runs = in_blocks(spans, lambda run: run)
    return let(F.struct(text.alias("text"), runs.alias("runs")), lambda x: let(F.struct(x["text"].alias("text"), x["runs"].alias("runs"), ends(x["runs"]).alias("ends")), joined))


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with personal data and disclosing terms replaced (n_chars, where there is one, follows)."""
    spans = personal_data(docs).where(F.size("spans") > 0).select("doc_id", "digest", "spans")
    spans = stored(spans.dropDuplicates(["doc_id", "digest"])).alias("s")
    text = F.coalesce(docs["text"], F.lit(""))
    d = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("digest")).alias("d")
    joined = d.join(spans, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.digest") == F.col("s.digest")), "left")
    clean = F.when(F.col("s.spans").isNull(), F.col("d.row.text")).otherwise(replaced(F.col("d.row.text"), F.col("s.spans")))
    parted = joined.select("d.row", clean.alias("text"))
    made = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return parted.select(*((made[c] if c in made else F.col("row").getField(c)).alias(c) for c in docs.columns))


def of_kind(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def op7_disclosure_sanitising(spark, folder):
    found = personal_data(table(spark, folder, "documents"))
    return found.select("doc_id", *map(of_kind, KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))

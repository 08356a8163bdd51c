"""MinHash near-duplicates with tensored banding.

Each distinct set of word shingles gets a few small collections of minhashes. A table key combines two
collections, so COLLECTIONS * PER_COLLECTION minhashes fill COLLECTIONS * (COLLECTIONS - 1) / 2 tables
that use 2 * PER_COLLECTION of them each. Two sets with similarity s agree on a collection with
probability p = s ** PER_COLLECTION and meet in a table unless fewer than two collections agree.

A table bucket is never expanded into all pairs of its members at first. Each member is compared with the
bucket's first and with the next few by id (a digest, the same order in every bucket, so that members who
share many buckets are not compared with ever new neighbours); confirmed links join into
components. Buckets whose members then lie in several components are looked at again, and every pair
across components is compared: where few are left for each member, pair by pair, where sizes and four bits of
each minhash already tell most pairs apart while they are joined; members of the other (hot) buckets come
together in clusters and are compared exactly on their full sets, block against block.
Candidates met pair by pair that agree on too few minhashes are not compared; the rest is confirmed on
full sets of shingles, whose exact sizes of intersection and union decide.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from seqloom.llm.common import documents, map_slices, stored, table
from seqloom.llm.components import components

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
#: At the least similarity 0.75: p = 0.42, and 4 in 100,000 pairs meet in no table.
COLLECTIONS, PER_COLLECTION = 24, 3
#: A candidate must agree on so many of the 72 minhashes; at similarity 0.75, 54 are expected and 1 pair in a million has fewer.
AGREE = 36
#: Neighbours by id that a member is compared with first; the order runs within parts of PART members.
#: One table in RING_TABLES does this: it only joins up most of a group early, and is no condition for finding a link.
RING, RING_TABLES, PART = 2, 8, 1024
#: A bucket whose pairs across components come to at most this many for each member has them compared pair by
#: pair, any other one in blocks: either way all of them.
ACROSS = 16
#: Sets and shingles in a block, on average. Sets of sizes more than a factor SIZE_STEP apart (a little above
#: 4/3) cannot reach the similarity: blocks hold one class of sizes and meet only those of the next.
BLOCK_SETS, BLOCK_SHINGLES, SIZE_STEP = 1024, 1_000_000, 1.34
SEED = 20

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_hash: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_hash) > 200_000:
        _hash.clear()
    out = np.empty(len(words), dtype=np.uint64)
    get, make = _hash.get, xxhash.xxh64_intdigest
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = _hash[w] = make(w)
        out[i] = h
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection with well-mixed bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; empty without words."""
    words = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER).split() for t in texts]
    sizes = [len(w) for w in words]
    flat = word_hashes([w for text in words for w in text])
    out, at = [], 0
    with np.errstate(over="ignore"):
        for n in sizes:
            h = flat[at : at + n]
            at += n
            width = min(SHINGLE, n)
            key = np.full(max(n - width + 1, 0) if n else 0, width, dtype=np.uint64)
            for k in range(width):
                key = mixed(key + h[k : n - width + 1 + k] * np.uint64(0x9E3779B97F4A7C15))
            out.append(np.unique(key))
    return out


def minhashes(sets: list[np.ndarray], salts: np.ndarray) -> np.ndarray:
    """Minhashes (sets, salts) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    with np.errstate(over="ignore"):
        return np.stack([np.minimum.reduceat((flat ^ s) * (s | np.uint64(1)) ^ (flat >> np.uint64(32)), starts) for s in salts], axis=1)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, n_shingles, the set's digest (two numbers) and its minhashes (32 bits each)."""
    salts = mixed(np.arange(1, 1 + COLLECTIONS * PER_COLLECTION, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))

    def work(batch):
        sets = shingle_sets(batch.column("text").to_pylist())
        n = np.array([len(s) for s in sets], dtype=np.int64)
        full = np.flatnonzero(n)
        marks: list = [None] * len(sets)
        if len(full):
            found = mixed(minhashes([sets[i] for i in full], salts)) >> np.uint64(32)
            for i, row in zip(full.tolist(), found.astype(np.uint32).view(np.int32)):
                marks[i] = row
        halves = digests(sets)
        return {"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "n_shingles": n, "d1": halves[:, 0].copy(), "d2": halves[:, 1].copy(), "marks": pa.array(marks, pa.list_(pa.int32()))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select(docs["doc_id"], docs["text"], text_digest(docs).alias("digest"))
    return map_slices(plain, work, f"doc_id {kind}, digest bigint, n_shingles bigint, d1 bigint, d2 bigint, marks array<int>")


def text_digest(docs: DataFrame) -> F.Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits for each set, as two numbers; the first one names its class."""
    return np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)


def collection(k: int) -> F.Column:
    return F.xxhash64(*(F.element_at("marks", k * PER_COLLECTION + j + 1) for j in range(PER_COLLECTION)))


def with_collections(sets: DataFrame) -> DataFrame:
    """id, doc, the collections' values `c`, and in `shared` (bits) those that another set has, too: only they make keys that meet."""
    made = sets.select("id", "doc", F.array(*(collection(k) for k in range(COLLECTIONS))).alias("c"))
    single = made.select("id", F.posexplode("c").alias("k", "value"))
    met = single.groupBy("k", "value").agg(F.count("*").alias("size")).where("size > 1").select("k", "value")
    bits = single.join(met, ["k", "value"], "left_semi").groupBy("id").agg(F.sum(F.expr("shiftleft(1, k)")).cast("int").alias("shared"))
    return made.join(bits, "id")


def keys_of(two: int, seed: list) -> F.Column:
    """Struct of a key and the bits of the two collections it combines, null unless another set shares both."""
    a, b = (k for k in range(COLLECTIONS) if two >> k & 1)
    key = F.struct(F.xxhash64(*seed, F.lit(two), F.col("c")[a], F.col("c")[b]).alias("bucket"), F.lit(two).alias("two"))
    return F.when(F.col("shared").bitwiseAND(F.lit(two)) == two, key)


TABLES = [1 << a | 1 << b for a, b in combinations(range(COLLECTIONS), 2)]


def table_rows(sets: DataFrame) -> DataFrame:
    """A row for each set and table: id, doc, bucket, and in `held` the collections that its key combines (bits)."""
    keys = F.filter(F.array(*(keys_of(two, []) for two in TABLES)), lambda t: t.isNotNull())
    return sets.select("id", "doc", F.explode(keys).alias("t")).select("id", "doc", "t.bucket", F.col("t.two").alias("held"))


def sized(a: str, b: str) -> F.Column:
    """Whether two set sizes allow the similarity at all."""
    return DENOMINATOR * F.least(a, b) >= NUMERATOR * F.greatest(a, b)


def agreeing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and that agree on enough minhashes."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("marks").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("marks").alias("y"))
    same = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, p: s + p)
    return pairs.join(right, "b").join(left, "a").where(sized("an", "bn") & (same >= AGREE)).select("a", "b")


def confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs whose full sets (id, shingles) reach the similarity."""
    left, right = full.select(F.col("id").alias("a"), F.col("shingles").alias("x")), full.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("x", "y"))
    judged = both.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("total"))
    return judged.where(DENOMINATOR * F.col("shared") >= NUMERATOR * (F.col("total") - F.col("shared"))).select("a", "b")


def full_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and shingles of the wanted classes, read from the document with the smallest id of each. Repeated
    rows of it can give a row more for every slice, which the joins bear."""
    of = sets.select("id", F.col("doc").alias("doc_id")).join(wanted, "id", "left_semi").select("doc_id").distinct()
    texts = documents(docs, "doc_id", "text").alias("d").join(of.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")

    def work(batch):
        sets = shingle_sets(batch.column("text").to_pylist())
        ids, first = np.unique(digests(sets)[:, 0], return_index=True) if sets else (np.zeros(0, dtype=np.int64), [])
        return {"id": ids.copy(), "shingles": pa.array([sets[i].view(np.int64) for i in first], pa.list_(pa.int64()))}

    return map_slices(texts, work, "id bigint, shingles array<bigint>").join(wanted, "id", "left_semi")


def linked(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """node, component of the classes that have a link; see the module's text."""
    own = stored(with_collections(sets))
    rows = stored(table_rows(own))
    tried = stored(agreeing(first_pairs(rows), sets))
    full = stored(full_sets(docs, sets, ends(tried)))
    found = stored(confirmed(tried, full))
    labels = components(edges_of(found))
    placed = stored(open_buckets(rows, labels))
    if placed.isEmpty():
        return labels
    few = stored(placed.where("few").join(own.select("id", "c"), "id").join(sets.select("id", "n", signature("marks").alias("s")), "id"))
    x = few.select("bucket", "held", F.col("id").alias("a"), F.col("component").alias("ac"), F.col("c").alias("x"), F.col("n").alias("an"), F.col("s").alias("sx"))
    y = few.select("bucket", "held", F.col("id").alias("b"), F.col("component").alias("bc"), F.col("c").alias("y"), F.col("n").alias("bn"), F.col("s").alias("sy"))
    # Only pairs that may be links become rows. A pair whose first shared bucket is a hot one is compared there.
    wanted = (F.col("a") < F.col("b")) & (F.col("ac") != F.col("bc")) & sized("an", "bn") & (alike("sx", "sy") >= AGREE) & first_shared()
    across = x.join(y, ["bucket", "held"]).where(wanted).select("a", "b")
    fresh = stored(agreeing(across.distinct().join(tried, ["a", "b"], "left_anti"), sets))
    hot = stored(clusters(placed.where("NOT few")))
    full = with_sets(docs, sets, full, ends(fresh).unionByName(hot.select("id")).distinct())
    more = stored(confirmed(fresh, full))
    if not hot.isEmpty():
        more = stored(more.unionByName(block_links(hot, full)))
    if more.isEmpty():
        return labels
    return components(edges_of(found.unionByName(more)))


def edges_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))


def with_sets(docs: DataFrame, sets: DataFrame, full: DataFrame, wanted: DataFrame) -> DataFrame:
    """`full` and the sets that `wanted` needs besides."""
    missing = stored(wanted.join(full.select("id"), "id", "left_anti"))
    return full if missing.isEmpty() else full.unionByName(stored(full_sets(docs, sets, missing)))


def open_buckets(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, held, id, component and few for the members of buckets that lie in several components."""
    at = F.coalesce("component", "id").alias("component")
    placed = rows.join(labels.withColumnRenamed("node", "id"), "id", "left").select("bucket", "held", "id", at)
    # Pairs across components: half of what the squares of the components leave of the bucket's square.
    per = placed.groupBy("bucket", "held", "component").agg(F.count("*").alias("s"))
    several = per.groupBy("bucket", "held").agg(F.sum("s").alias("size"), F.sum(F.col("s") * F.col("s")).alias("squares")).where("squares < size * size AND size > 2")
    several = several.select("bucket", "held", (F.col("size") * F.col("size") - F.col("squares") <= 2 * ACROSS * F.col("size")).alias("few"))
    return placed.join(several, ["bucket", "held"])


def signature(marks: str) -> F.Column:
    """The lowest four bits of every minhash, sixteen to a number."""
    count = COLLECTIONS * PER_COLLECTION
    words = []
    for start in range(0, count, 16):
        four = [F.shiftleft(F.element_at(marks, i + 1).cast("bigint").bitwiseAND(F.lit(15)), 4 * (i - start)) for i in range(start, min(start + 16, count))]
        word = four[0]
        for f in four[1:]:
            word = word.bitwiseOR(f)
        words.append(word)
    return F.array(*words)


def alike(a: str, b: str) -> F.Column:
    """How many of the four-bit marks of two signatures are equal: at least as many as minhashes are."""
    count = COLLECTIONS * PER_COLLECTION
    low = F.lit(0x1111111111111111)
    unlike = F.lit(0)
    for k in range(-(-count // 16)):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(low)
        unlike = unlike + F.bit_count(x)
    return F.lit(count) - unlike


def clusters(hot: DataFrame) -> DataFrame:
    """id, component and cluster of the members of hot buckets: those who share one are in one cluster."""
    first = hot.groupBy("bucket", "held").agg(F.min("id").alias("v"))
    edges = hot.join(first, ["bucket", "held"]).select(F.col("id").alias("u"), "v").where("u != v").distinct()
    of = components(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    return hot.select("id", "component").distinct().join(of, "id")


def block_links(hot: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a < b) across components among all members of each cluster, from their full sets, block against block."""
    size = F.floor(F.log(F.size("shingles")) / F.log(F.lit(SIZE_STEP))).cast("int").alias("scale")
    members = stored(hot.join(full.dropDuplicates(["id"]), "id").select("cluster", size, "id", "component", "shingles"))
    heavy = members.groupBy("cluster", "scale").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES)).alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")
    placed = members.join(heavy, ["cluster", "scale"]).select("cluster", "scale", block, "id", "component", "shingles")
    every = heavy.select("cluster", "scale", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    left = every.select("cluster", F.col("scale").alias("ls"), F.col("block").alias("lb"))
    right = every.select("cluster", F.col("scale").alias("rs"), F.col("block").alias("rb"))
    met = stored(left.join(right, "cluster").where("rs = ls + 1 OR (rs = ls AND lb <= rb)"))
    names = ["cluster", "ls", "lb", "rs", "rb"]
    one = placed.withColumnsRenamed({"scale": "ls", "block": "lb"}).join(met, ["cluster", "ls", "lb"]).select(*names, F.lit(0).alias("side"), "id", "component", "shingles")
    two = placed.withColumnsRenamed({"scale": "rs", "block": "rb"}).join(met.where("rs != ls OR rb != lb"), ["cluster", "rs", "rb"]).select(*names, F.lit(1).alias("side"), "id", "component", "shingles")

    def work(block: pa.Table) -> pa.Table:
        side = block.column("side").to_numpy()
        ids, component = block.column("id").to_numpy(), block.column("component").to_numpy()
        lists = block.column("shingles").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        code = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        starts = np.cumsum(sizes) - sizes
        ours = np.flatnonzero(side == 0)
        theirs = np.flatnonzero(side == 1) if side.any() else ours
        at = np.repeat(starts[theirs] - (np.cumsum(sizes[theirs]) - sizes[theirs]), sizes[theirs]) + np.arange(sizes[theirs].sum())
        flat, begin = code[at], np.cumsum(sizes[theirs]) - sizes[theirs]
        held = np.zeros(int(code.max(initial=-1)) + 1, dtype=np.int32)
        a, b = [], []
        for i in ours.tolist() if len(theirs) else []:
            own = code[starts[i] : starts[i] + sizes[i]]
            held[own] = 1
            shared = np.add.reduceat(held[flat], begin)
            held[own] = 0
            near = (DENOMINATOR * shared >= NUMERATOR * (sizes[i] + sizes[theirs] - shared)) & (component[theirs] != component[i])
            found = ids[theirs[near]]
            a.append(np.minimum(found, ids[i]))
            b.append(np.maximum(found, ids[i]))
        none = [np.zeros(0, dtype=np.int64)]
        return pa.table({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})

    return one.unionByName(two).groupBy(*names).applyInArrow(work, "a bigint, b bigint").distinct()


def first_shared() -> F.Column:
    """Whether `held` are the first collections that x and y agree on: of all buckets that two sets share, one gives the pair."""
    same = F.transform(F.zip_with("x", "y", lambda p, q: p == q), lambda e, k: F.when(e, F.call_function("shiftleft", F.lit(1), k)).otherwise(F.lit(0)))
    agreed = F.aggregate(same, F.lit(0), lambda m, bit: m.bitwiseOR(bit))
    upto = F.call_function("shiftleft", F.lit(2), F.floor(F.log2("held")).cast("int")) - 1
    return agreed.bitwiseAND(upto) == F.col("held")


def first_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a < b) of each bucket's members with its first (the one with the smallest doc) and with RING neighbours."""
    bounds = rows.groupBy("bucket", "held").agg(F.min(F.struct("doc", "id")).alias("low"), F.count("*").alias("size")).where("size > 1")
    met = stored(rows.join(bounds, ["bucket", "held"]).select("bucket", "held", "id", F.col("low.id").alias("first"), "size"))
    star = met.where(F.col("id") != F.col("first")).select("id", F.col("first").alias("other"))
    # Parts are ranges of the digest: the same neighbours meet in every bucket that both are in.
    part = F.floor((F.col("id") / 2.0**64 + 0.5) * F.ceil(F.col("size") / PART))
    order = Window.partitionBy("bucket", "held", "part").orderBy("id")
    near = met.where((F.col("size") > 2) & (F.pmod(F.hash("held"), F.lit(RING_TABLES)) == 0)).withColumn("part", part).select("id", F.array(*(F.lead("id", k).over(order) for k in range(1, RING + 1))).alias("near"))
    near = near.select("id", F.explode("near").alias("other"))
    both = star.unionByName(near.where("other IS NOT NULL"))
    return both.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, component_id and kept of every document.

    Texts without words (null, empty) have empty sets and are linked with nothing. Texts with one set of
    shingles form one class, however many they are. Repeated rows give repeated results; a null id takes
    the component of its text, or null where it has none.
    """
    sketch = stored(sketches(docs))
    classes = sketch.where("n_shingles > 0").groupBy("d1", "n_shingles").agg(F.min("doc_id").alias("doc"), F.min("marks").alias("marks"))
    sets = stored(classes.select(F.col("d1").alias("id"), "doc", F.col("n_shingles").alias("n"), "marks"))
    placed = linked(docs, sets).join(sets.select(F.col("id").alias("node"), "doc"), "node")
    first = placed.groupBy("component").agg(F.min("doc").alias("first"))
    of_class = placed.join(first, "component").select(F.col("node").alias("d1"), "first")
    alone = sets.select(F.col("id").alias("d1"), "doc").join(of_class, "d1", "left").select("d1", F.coalesce("first", "doc").cast("bigint").alias("component_id"))
    named = sketch.where("n_shingles > 0").join(alone, "d1").select("doc_id", "digest", "n_shingles", "component_id")
    bare = sketch.where("n_shingles = 0").select("doc_id", "digest", "n_shingles", F.col("doc_id").cast("bigint").alias("component_id"))
    return named.unionByName(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns; of repeated rows with one id and text, one."""
    kept = stored(near_duplicates(docs).where("kept").groupBy("doc_id", "digest").count())
    # Stored apart, so that Spark knows how few there are and does not shuffle the texts once more for them.
    repeated = stored(kept.where("count > 1"))
    return keyed(docs, kept.where("count = 1")).unionByName(keyed(docs, repeated).dropDuplicates(["doc_id", "text"]))


def keyed(docs: DataFrame, keys: DataFrame) -> DataFrame:
    d, k = docs.alias("d"), keys.alias("k")
    on = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col("k.digest"))
    return d.join(k, on, "left_semi")


def op9_tensored_minhash(spark, folder):
    return near_duplicates(table(spark, folder, "documents")).drop("digest")

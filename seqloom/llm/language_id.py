"""Language identification of code-switched text by a linear-chain conditional random field.

Each word is labelled with a language: affixes, character n-grams and a lexicon give its emissions, learned
transitions say how languages follow each other, forward-backward gives each word's marginals. A
document's language is the one with the largest share of the marginals, weighted by word length.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from seqloom.llm.common import documents, fold, map_slices, table
from seqloom.llm.crf import fitted, forward_backward

#: Labelled documents a language gives to training at most, chosen by a hash of the id, and the words that one of
#: them gives on average at most, drawn from its whole text by a hash of their position: the bounds of the
#: sample that the model is fitted on.
SAMPLE, TRAIN_WORDS = 200, 400
#: Buckets that features are hashed to.
BUCKETS = 1 << 16
STEPS, RATE, PENALTY = 60, 0.25, 1e-6
#: Share of training sequences that continue in another language, so that changes are seen.
SWITCHED = 0.3
HELD_OUT, FOLDS = 2, 4
#: Emissions of words that a Python worker keeps, then starts anew; so with the buckets of affixes and n-grams.
REMEMBERED = 400_000

#: Runs of letters with their marks; digits such as ² or ½ are none.
LETTERS = r"\p{L}[\p{L}\p{M}]*"
WORD = regex.compile(LETTERS)


class Numbered(dict):
    """Words numbered in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Buckets(dict):
    """Buckets of features that many words share."""

    def __missing__(self, feature: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[feature] = bucket = _bucket(feature)
        return bucket


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


_shared = Buckets()


def features(word: str) -> list[int]:
    """Hashed features of a word: the word itself (lexicon), affixes of 1 to 4 letters, n-grams of 2 and 3."""
    edged = f"<{word}>"
    found = {"p" + word[:1], "p" + word[:2], "p" + word[:3], "p" + word[:4], "s" + word[-1:], "s" + word[-2:], "s" + word[-3:], "s" + word[-4:]}
    found.update(map("".join, zip(edged, edged[1:])), map("".join, zip(edged, edged[1:], edged[2:])))
    return [_bucket("w" + word), *map(_shared.__getitem__, found)]


def word_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words on end, and where each word's begin."""
    each = [features(w) for w in words]
    sizes = np.array([len(f) for f in each], dtype=np.int64)
    return np.fromiter(chain.from_iterable(each), dtype=np.int64, count=int(sizes.sum())), np.cumsum(sizes) - sizes


def summed(weights: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[flat], starts, axis=0) if len(starts) else np.zeros((0, weights.shape[1]))


class LanguageModel:
    def __init__(self, languages: list[str], weights: np.ndarray, transition: np.ndarray):
        self.languages, self.weights, self.transition = languages, weights.astype(np.float32), transition
        self._number, self._emission = Numbered(), np.zeros((0, len(languages)), dtype=np.float32)

    def __getstate__(self):
        return {"languages": self.languages, "weights": self.weights, "transition": self.transition}

    def __setstate__(self, state):
        self.__init__(**state)

    def codes(self, texts: list[list[str]]) -> np.ndarray:
        """Row of each word in the table of emissions, which grows by the words not met before."""
        number = self._number
        if len(number) > REMEMBERED:
            number.clear()
            self._emission = self._emission[:0]
        known = len(number)
        total = sum(map(len, texts))
        code = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=total)
        fresh = list(number)[known:] if len(number) > known else []
        if fresh:
            self._emission = np.concatenate([self._emission, summed(self.weights, *word_table(fresh)).astype(np.float32)])
        return code

    def shares(self, texts: list[list[str]]) -> np.ndarray:
        """For each text the share of each language in its words' marginals, by length; zeros without words."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        marginal, _, _ = forward_backward(self._emissions(texts).astype(np.float64), sizes, self.transition)
        weight = np.fromiter(map(len, chain.from_iterable(texts)), dtype=np.float64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        sums = np.stack([np.bincount(owner, weights=marginal[:, k] * weight, minlength=len(texts)) for k in range(len(self.languages))], axis=1)
        return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)

    def _emissions(self, texts: list[list[str]]) -> np.ndarray:
        code = self.codes(texts)
        return self._emission[code]


def learned(sample: list[tuple[str, str]]) -> LanguageModel:
    """A model from (text, language) pairs. Part of the sequences run on into a text of another language."""
    languages = sorted({lang for _, lang in sample})
    label = {lang: k for k, lang in enumerate(languages)}
    pieces = [(WORD.findall(t.lower()), label[lang]) for t, lang in sample]
    pieces = [p for p in pieces if p[0]]
    draw = np.random.default_rng(7)
    words, gold, sizes = [], [], []
    for i in draw.permutation(len(pieces)).tolist():
        parts = [pieces[i]]
        if draw.random() < SWITCHED:
            parts.append(pieces[int(draw.integers(len(pieces)))])
        sizes.append(sum(len(w) for w, _ in parts))
        for w, k in parts:
            words.extend(w)
            gold.extend([k] * len(w))
    number: dict[str, int] = {}
    code = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    flat, starts = word_table(list(number))
    per_word = np.diff(np.r_[starts, len(flat)])
    owner = np.repeat(np.arange(len(starts)), per_word)
    k = len(languages)

    def gradient(d: np.ndarray) -> np.ndarray:
        of_word = np.stack([np.bincount(code, weights=d[:, j], minlength=len(number)) for j in range(k)], axis=1)
        return np.stack([np.bincount(flat, weights=of_word[owner, j], minlength=BUCKETS) for j in range(k)], axis=1)

    weights, transition = fitted(lambda w: summed(w, flat, starts)[code], gradient, (BUCKETS, k), np.array(gold), np.array(sizes), STEPS, RATE, PENALTY)
    return LanguageModel(languages, weights, transition)


def training_sample(docs: DataFrame, size: int = SAMPLE) -> list[tuple[str, str]]:
    """At most `size` labelled documents of each language, outside the held-out fold."""
    labelled = documents(docs, "doc_id", "text", "lang").where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.select("doc_id", "lang").distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= size).drop("at")
    # Words from all over the text: each position is drawn or not by its hash, TRAIN_WORDS of a longer text on average.
    whole = labelled.join(F.broadcast(ids), ["doc_id", "lang"]).withColumn("words", F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0)))
    drawn = F.filter("words", lambda w, i: F.pmod(F.xxhash64("doc_id", i), F.lit(1 << 20)) * F.size("words") < TRAIN_WORDS << 20)
    texts = whole.groupBy("doc_id", "lang").agg(F.min(F.array_join(drawn, " ")).alias("text"))
    return [(r["text"], r["lang"]) for r in texts.orderBy("lang", "doc_id").collect()]


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (its share of the marginals) of every document.

    A text that is null or has no letter is `und` with score 0; so is every text when there is no model
    (no labelled row to learn from). Repeated rows give repeated results. Texts are read whole, a very long one as a
    slice of its own. In training, a row repeated with one label counts once, with two labels once for each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch):
        texts = [WORD.findall((t or "").lower()) for t in batch.column("text").to_pylist()]
        if model is None:
            best, score = ["und"] * len(texts), np.zeros(len(texts))
        else:
            share = model.shares(texts)
            top = share.argmax(axis=1)
            best = [model.languages[k] if t else "und" for k, t in zip(top, texts)]
            score = np.where([bool(t) for t in texts], np.clip(share.max(axis=1), 0, 1), 0.0)
        return {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(best), "score": pa.array(score)}

    out = map_slices(documents(docs, "doc_id", "text"), work, f"doc_id {kind}, lang_pred string, score double", chars=4_000_000)
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op3_crf_language(spark, folder):
    docs = table(spark, folder, "documents")
    sample = training_sample(docs)
    return identify(docs, learned(sample) if sample else None)

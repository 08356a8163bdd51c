"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from its own measures and those of the lines around it. The marginals
of forward-backward, weighted by the lines' lengths, give the document's score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seqloom.llm.common import documents, fold, map_slices, runs, table
from seqloom.llm.crf import fitted, forward_backward

#: Labelled documents of each class that the model is fitted on at most, chosen by a hash of the id, and the lines
#: that one of them gives on average at most, drawn from its whole text in runs of RUN by a hash of their place: the
#: bounds of the training sample.
SAMPLE, TRAIN_LINES, RUN = 1200, 200, 10
STEPS, RATE, PENALTY = 120, 0.15, 1e-4
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

SYMBOLS = "#*$%&|<>{}[]\\^~=_@"
MARKS = ".,;:!?"
#: Shares are cut at these points, each cut one feature.
CUTS = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.4])
SIZES = np.array([0, 2, 5, 10, 20, 50, 150])
DROPPED = str.maketrans("", "", SYMBOLS)
UNMARKED = str.maketrans("", "", MARKS + "'\"()-")


def line_measures(line: str) -> tuple:
    words = line.split()
    n = len(line) or 1
    w = len(words) or 1
    unsymboled = line.translate(DROPPED)
    letters = sum(map(len, words)) or 1
    return (
        (len(line) - len(unsymboled)) / n,
        sum(map(line.count, "!?")) / w,
        sum(map(str.isupper, words)) / w,
        1 - len(set(words)) / w,
        sum(map(str.isalpha, unsymboled.translate(UNMARKED).split())) / w,
        sum(map(line.count, "0123456789")) / letters,
        len(words),
        letters / w,
    )


def measures(lines: list[str]) -> np.ndarray:
    """Features (lines, F) of each line on its own: cuts of its measures."""
    if not lines:
        return np.zeros((0, WIDTH))
    m = np.array([line_measures(x) for x in lines])
    shares = [(m[:, j : j + 1] > CUTS) for j in (0, 1, 2, 3)] + [m[:, 4:5] < 1 - CUTS[:, None].T, m[:, 5:6] > CUTS]
    sizes = [m[:, 6:7] > SIZES, m[:, 7:8] > np.array([2, 3, 4, 6, 9, 14])]
    closed = np.array([x.rstrip()[-1:] in MARKS and bool(x.strip()) for x in lines])[:, None]
    opened = np.array([x.lstrip()[:1].isupper() for x in lines])[:, None]
    return np.concatenate([*shares, *sizes, closed, opened], axis=1).astype(np.float64)


WIDTH = 6 * len(CUTS) + len(SIZES) + 6 + 2


def observed(texts: list[list[str]]) -> np.ndarray:
    """Own features, those of the line before and after (zeros at the ends), equality with the line before, a constant."""
    lines = [x for t in texts for x in t]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    own = measures(lines)
    first = np.zeros(len(lines), dtype=bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(lines) > 1:
        before[1:] = own[:-1] * ~first[1:, None]
        after[:-1] = own[1:] * ~first[1:, None]
    same = np.array([a == b for a, b in zip(lines[1:], lines)] if lines else [], dtype=bool)
    same = np.r_[False, same & ~first[1:]][: len(lines)]
    return np.concatenate([own, before, after, same[:, None], np.ones((len(lines), 1))], axis=1)


class QualityModel:
    def __init__(self, weights: np.ndarray, transition: np.ndarray, prior: float):
        self.weights, self.transition, self.prior = weights, transition, prior

    def scores(self, texts: list[str]) -> np.ndarray:
        """Share of each text that lies in good lines; a text without lines gets the prior of class 1."""
        return np.concatenate([np.zeros(0), *(self._scores(texts[run]) for run in runs(texts))])

    def _scores(self, texts: list[str]) -> np.ndarray:
        parts = [lines_of(t) for t in texts]
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        x = observed(parts)
        marginal, _, _ = forward_backward(x @ self.weights, sizes, self.transition)
        weight = np.array([len(x) for p in parts for x in p], dtype=np.float64)
        owner = np.repeat(np.arange(len(parts)), sizes)
        total = np.bincount(owner, weights=weight, minlength=len(parts))
        good = np.bincount(owner, weights=weight * marginal[:, 1], minlength=len(parts)) if len(weight) else total
        return np.where(total > 0, np.clip(good / np.maximum(total, 1), 0, 1), self.prior)


def lines_of(text: str) -> list[str]:
    return [x for x in text.split("\n") if x and not x.isspace()]


def learned(sample: list[tuple[str, int]]) -> QualityModel:
    """A model from (text, label) pairs: each line bears its document's label."""
    parts = [(lines_of(t), int(k)) for t, k in sample]
    parts = [p for p in parts if p[0]]
    prior = float(np.mean([k for _, k in sample]))
    sizes = np.array([len(p) for p, _ in parts], dtype=np.int64)
    if not len(sizes):
        return QualityModel(np.zeros((3 * WIDTH + 2, 2)), np.zeros((2, 2)), prior)
    gold = np.repeat([k for _, k in parts], sizes)
    x = observed([p for p, _ in parts])
    weights, transition = fitted(lambda w: x @ w, lambda d: x.T @ d, (x.shape[1], 2), gold, sizes, STEPS, RATE, PENALTY)
    return QualityModel(weights, transition, prior)


def training_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> list[tuple[str, int]]:
    """At most `size` documents of each class, outside the held-out fold. A document labelled both ways counts as bad."""
    usable = documents(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    one = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = one.withColumn("at", F.row_number().over(order)).where(F.col("at") <= size).drop("at")
    texts = documents(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    # Lines from all over the text; a run keeps neighbours together, whose features the model reads.
    lines = F.split("text", "\n")
    drawn = F.filter(lines, lambda _, i: F.pmod(F.xxhash64("doc_id", F.floor(i / RUN)), F.lit(1 << 20)) * F.size(lines) < TRAIN_LINES << 20)
    texts = texts.groupBy("doc_id", "quality").agg(F.min(F.array_join(drawn, "\n")).alias("text"))
    return [(r["text"], r["quality"]) for r in texts.orderBy("doc_id").collect()]


def scored(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A null text reads as empty; a text without lines gets the share of class 1 in the sample, and so
    does every text (0.5) when there is no model. Repeated rows give repeated results. Texts are read whole, in runs of
    bounded size; a very long one is a run of its own.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        score = model.scores(texts) if model else np.full(len(texts), 0.5)
        return {"doc_id": batch.column("doc_id"), "score": pa.array(score)}

    out = map_slices(documents(docs, "doc_id", "text"), work, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def model_from(docs: DataFrame, labels: DataFrame) -> QualityModel | None:
    sample = training_sample(docs, labels)
    return learned(sample) if sample else None


def good_documents(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model does not reject, all columns."""
    if model is None:
        return docs

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.scores([t or "" for t in texts]), index=texts.index)

    return docs.where(score(docs["text"]) >= threshold)


def op4_crf_quality(spark, folder):
    docs = table(spark, folder, "documents")
    return scored(docs, model_from(docs, table(spark, folder, "labels")))

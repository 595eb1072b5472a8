"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with probability p = sigmoid(bias + weights of its words); the
document's score is their noisy-or, 1 - prod(1 - p). Bias and weights are fitted on document labels alone by gradient
descent on the noisy-or's likelihood, so that the blame falls on those sentences that tell labelled documents apart,
which the operator then names as spans.

Features of a word: itself and its first three to seven letters, so that inflected insults are known by their stem.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.llm.common import appended, fold, forget, small_batches, training_rows, written

WORDS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"[^.!?\n]+")
STEMS = (3, 4, 5, 6, 7)
#: Words whose weight a worker remembers before it starts anew.
MEMO = 300_000
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
VERDICT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_sentences", T.IntegerType()), T.StructField("spans", SPANS)])


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """Start, end and distinct words of each sentence that has a word."""
    return [(m.start(), m.end(), words) for m in SENTENCES.finditer(text) if (words := set(WORDS.findall(m.group().lower())))]


@dataclass
class NoisyOr:
    """``weights`` of features, ``bias`` of any sentence."""

    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def weight(self, word: str) -> float:
        w = self.memo.get(word)
        if w is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            get = self.weights.get
            w = self.memo[word] = sum(get(f, 0.0) for f in features(word))
        return w

    def judge(self, text: str | None, threshold: float = 0.5) -> dict:
        """Score, verdict, number of sentences and offending spans. A text without a word counts as one plain sentence."""
        text = text or ""
        plain = 1 / (1 + math.exp(-self.bias))
        words = set(WORDS.findall(text.lower()))
        marked = {w for w in words if self.weight(w)}
        if not marked:
            n = max(1, sum(1 for m in SENTENCES.findall(text) if WORDS.search(m))) if words else 1
            score = -math.expm1(n * math.log1p(-plain))
            return {"score": score, "predicted": int(score >= threshold), "n_sentences": n if words else 0, "spans": []}
        log_none, n, spans = 0.0, 0, []
        for start, end, own in sentences(text):
            n += 1
            z = self.bias + sum(self.weight(w) for w in sorted(own & marked))
            log_none -= z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
            if z >= 0:
                spans.append({"start": start, "end": end, "score": 1 / (1 + math.exp(-z))})
        score = -math.expm1(log_none)
        return {"score": score, "predicted": int(score >= threshold), "n_sentences": n, "spans": spans}


def fit_noisy_or(bags: list[tuple[int, int, list[list[int]]]], n_features: int, rounds: int = 250, rate: float = 0.1, ridge: float = 1e-3) -> tuple[float, np.ndarray]:
    """Bias and weights by Adam on the whole sample. bags: label, number of sentences, features of those that have any."""
    y = np.array([b[0] for b in bags], float)
    owner = np.array([d for d, b in enumerate(bags) for _ in b[2]], np.int64)
    sizes = np.array([len(s) for b in bags for s in b[2]], np.int64)
    flat = np.array([f for b in bags for s in b[2] for f in s], np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    plain = np.array([b[1] - len(b[2]) for b in bags], float)
    theta = np.zeros(n_features + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = theta[-1] + np.bincount(of, weights=theta[flat], minlength=len(sizes))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p0 = 1 / (1 + np.exp(-np.clip(theta[-1], -30, 30)))
        log_none = np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)) + plain * np.log1p(-p0)
        none = np.exp(log_none)
        pull = np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0)  # d loss / d z is pull * p
        g_sentence = pull[owner] * p
        g = np.append(np.bincount(flat, weights=g_sentence[of], minlength=n_features), g_sentence.sum() + (pull * plain).sum() * p0) / len(y)
        g[:-1] += ridge * theta[:-1] / max(1, len(y)) * 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return float(theta[-1]), theta[:-1]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of either label a feature is, some documents at a time: they have many features."""
    for batch in batches:
        for at in range(0, len(batch), 200):
            part = batch.slice(at, 200)
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                counts[label > 0].update({f for w in set(WORDS.findall((text or "").lower())) for f in features(w)})
            names = list(counts[0] | counts[1])
            neg, pos = (pa.array([c[f] for f in names], pa.int64()) for c in counts)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), neg, pos], ["feature", "neg", "pos"])


def train_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, out_fold: int = 0, max_documents: int = 12_000, max_features: int = 20_000, least_documents: int = 5, least_z: float = 3.5) -> NoisyOr:
    """Fit on labelled documents whose id's fold is not ``out_fold``: at most ``max_documents``, drawn by hash, an id once.

    The same rows give the same model, however they are dealt. A document brings its marked sentences to the driver, so a
    sampled text takes memory there in proportion to how many sentences hold a feature. Features are in ``least_documents`` of them at least and have a log odds ratio of ``least_z`` standard errors at
    least; the ``max_features`` clearest are kept. Without labelled documents of both kinds no text is toxic.
    """
    small_batches(docs.sparkSession)
    sample = written(training_rows(docs, labels, "toxic", fold(F.col("doc_id"), folds) == out_fold, max_documents), "training")
    sums = sample.agg(F.sum((F.col("label") > 0).cast("int")).alias("pos"), F.count("*").alias("n")).first()
    if not sums["n"] or not sums["pos"] or sums["pos"] == sums["n"]:
        forget(sample)
        return NoisyOr()
    pos, neg = float(sums["pos"]), float(sums["n"] - sums["pos"])
    counts = sample.mapInArrow(_document_counts, "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    a, b = F.col("pos") + 0.5, F.col("neg") + 0.5
    ratio = F.log(a / (pos + 1)) - F.log(b / (neg + 1))
    clear = counts.where(F.col("pos") + F.col("neg") >= least_documents).select("feature", (ratio / F.sqrt(1 / a + 1 / b)).alias("z"))
    names = [r[0] for r in clear.where(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "feature").limit(max_features).collect()]
    index = {f: i for i, f in enumerate(names)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own = [], []
            for text in batch.column("text").to_pylist():
                found = sentences(text or "")
                n.append(max(1, len(found)))
                own.append([ids for _, _, words in found if (ids := sorted(index[f] for w in words for f in features(w) if f in index))])
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(n, pa.int32()), pa.array(own, pa.list_(pa.list_(pa.int32())))], ["label", "n", "own"])

    rows = sample.mapInArrow(bags, "label int, n int, own array<array<int>>").toLocalIterator()
    bias, weights = fit_noisy_or(sorted((int(r[0] > 0), r[1], r[2]) for r in rows), len(names))  # sums of floats depend on the order
    forget(sample)
    return NoisyOr(bias, {f: float(w) for f, w in zip(names, weights, strict=True) if w})


def judged(docs: DataFrame, model: NoisyOr, name: str) -> DataFrame:
    """``docs`` with a struct column ``name``: score, predicted, n_sentences and the offending spans (characters)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return appended(docs, name, VERDICT, lambda texts: pa.array([shared.value.judge(t) for t in texts], pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("n_sentences", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, spans of each row of ``docs``.

    Null and empty texts are scored like one plain sentence. Null ids are held out or not as the empty text is (its
    crc32 is 0: held out). Repeated rows each give a row; ties cannot matter, as each row is scored by itself. Long texts
    are scored whole, in time and memory in proportion. Other columns are ignored. An empty table gives no rows.
    """
    model = train_toxicity(docs, labels)
    return judged(docs.select("doc_id", "text"), model, "verdict").select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "verdict.*")


def drop_toxic(docs: DataFrame, model: NoisyOr, name: str) -> DataFrame:
    """The rows of ``docs`` that ``model`` does not reject, with the columns that they had."""
    return judged(docs, model, name).where(F.col(name)["predicted"] == 0).drop(name)

"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles over the features, one feature at a time on the residual of all others, then over the
pairs of features that reduce the remaining loss most. As every tree sees one feature or one pair, their sum collapses
into a lookup table per feature and per pair, so that a document's score is a sum of table entries at its bins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.llm.common import appended, fold, small_batches, training_rows

FEATURES = (
    "log_words", "word_length", "distinct_words", "distinct_trigrams", "top_word", "symbols_per_word", "upper_share", "exclamations_per_word", "digit_share",
    "stops_per_word", "commas_per_word", "line_words", "repeated_lines", "non_ascii_share", "short_words", "long_words", "letter_entropy", "bigram_entropy",
)
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
SENTENCE_ENDS = re.compile(r"[.!?\n]+")


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES over the whole text; zeros without a word."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode(), np.uint8)
    of = np.bincount(raw, minlength=256)
    size = len(raw)
    letters = of[97:123] + of[65:91]
    share = letters / max(1, letters.sum())
    counts = Counter(words)
    trigrams = set(zip(words, words[1:], words[2:], strict=False))
    lines = [line for line in text.split("\n") if line.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    upper, lower = int(of[65:91].sum()), int(of[97:123].sum())
    pairs = np.bincount((raw[:-1].astype(np.int64) & 31) * 32 + (raw[1:] & 31), minlength=1024) / max(1, size - 1)
    pairs = pairs[pairs > 0]
    return [
        float(np.log1p(n)), float(lengths.mean()), len(counts) / n, len(trigrams) / max(1, n - 2) if n > 2 else 1.0, max(counts.values()) / n, float(of[SYMBOLS].sum()) / n,
        upper / max(1, upper + lower), of[33] / n, float(of[48:58].sum()) / size, of[46] / n, of[44] / n, float(np.log1p(n / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)),
        float(of[128:].sum()) / size, float((lengths <= 3).mean()), float((lengths >= 12).mean()), float(-(share[share > 0] * np.log(share[share > 0])).sum()), float(-(pairs * np.log(pairs)).sum()),
    ]


@dataclass
class Additive:
    """``edges`` of each feature's bins; ``tables`` by feature; ``pairs``: two features and a table over their coarse bins."""

    prior: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1) if edges else np.zeros((len(x), 0), np.int64)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        fine, rough = self.bins(x, self.edges), self.bins(x, self.coarse)
        for j, t in enumerate(self.tables):
            z += t[fine[:, j]]
        for i, j, t in self.pairs:
            z += t[rough[:, i], rough[:, j]]
        return z

    def scores(self, texts: list) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([statistics(t) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def stump_tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """The Newton steps of a tree over a feature's bins, from the gradients and curvatures of each bin."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, left: int) -> None:
        gs, hs = g[a:b], h[a:b]
        if left and b - a > 1:
            cg, ch = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
            rg, rh = gs.sum() - cg, hs.sum() - ch
            gain = np.where((ch >= least) & (rh >= least), _gain(cg, ch, ridge) + _gain(rg, rh, ridge), -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > _gain(gs.sum(), hs.sum(), ridge) + 1e-9:
                grow(a, a + k + 1, left - 1)
                grow(a + k + 1, b, left - 1)
                return
        out[a:b] = gs.sum() / (hs.sum() + ridge)

    grow(0, len(g), depth)
    return out


def cross_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best tree that cuts either of two features once: four quadrants, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = (cg[:-1, :-1], ch[:-1, :-1])
    quads = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    quads.append((tg - sum(q[0] for q in quads), th - sum(q[1] for q in quads)))
    total = sum(_gain(x, y, ridge) for x, y in quads)
    if not total.size:
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(int(np.argmax(total)), total.shape)
    out = np.zeros_like(g)
    steps = [float(q[0][i, j] / (q[1][i, j] + ridge)) for q in quads]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = steps
    return out, float(total[i, j] - _gain(tg, th, ridge))


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse: int = 10, cycles: int = 120, pair_cycles: int = 60, n_pairs: int = 8, rate: float = 0.15, depth: int = 2, ridge: float = 2.0, least: float = 3.0) -> Additive:
    """Boost the tables on a sample: ``cycles`` rounds over features, then ``pair_cycles`` over the best pairs."""
    if not len(y) or y.min() == y.max():
        return Additive(prior=0.0 if not len(y) else (6.0 if y[0] else -6.0))

    def cuts(k: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) for j in range(x.shape[1])]

    model = Additive(float(np.log(y.mean() / (1 - y.mean()))), cuts(bins), cuts(coarse))
    fine, rough = model.bins(x, model.edges), model.bins(x, model.coarse)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.prior)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(cycles):
        for j, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * stump_tree(np.bincount(fine[:, j], g, len(t)), np.bincount(fine[:, j], h, len(t)), depth, ridge, least)
            t += step
            z += step[fine[:, j]]
    g, h = slopes()
    width = [len(e) + 1 for e in model.coarse]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(rough[:, i] * width[j] + rough[:, j], v, width[i] * width[j]).reshape(width[i], width[j])

    found = sorted(((-cross_tree(grid(i, j, g), grid(i, j, h), ridge)[1], i, j) for i, j in combinations(range(x.shape[1]), 2)))[:n_pairs]
    model.pairs = [(i, j, np.zeros((width[i], width[j]))) for _, i, j in found]
    for _ in range(pair_cycles):
        for i, j, t in model.pairs:
            g, h = slopes()
            step = rate * cross_tree(grid(i, j, g), grid(i, j, h), ridge)[0]
            t += step
            z += step[rough[:, i], rough[:, j]]
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))], ["label", "x"])


def train_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, out_fold: int = 0, max_documents: int = 20_000) -> Additive:
    """Fit on labelled documents whose id's fold is not ``out_fold``: at most ``max_documents``, drawn by hash, an id once.

    The same rows give the same model, however they are dealt; of each only its statistics reach the driver. Without any the score is 0.5; with labels of one kind alone it is near that label.
    """
    small_batches(docs.sparkSession)
    sample = training_rows(docs, labels, "quality", fold(F.col("doc_id"), folds) == out_fold, max_documents)
    rows = sample.mapInArrow(_sampled, "label int, x array<double>").toArrow()
    x = np.array(rows["x"].combine_chunks().flatten(), float).reshape(-1, len(FEATURES))
    y = np.array(rows["label"].to_numpy() > 0, float)
    order = np.lexsort((*x.T[::-1], y))  # sums of floats depend on the order of rows
    return fit_additive(x[order], y[order])


def scored(docs: DataFrame, model: Additive, name: str) -> DataFrame:
    """``docs`` with a double column ``name``: the chance of label 1."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return appended(docs, name, T.DoubleType(), lambda texts: pa.array(shared.value.scores(texts), pa.float64()))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= ``threshold``) of each row of ``docs``.

    Null and empty texts have zeros for features and are scored as such. A null id's fold is that of the empty text.
    Repeated rows each give a row; ties cannot matter, as each row is scored by itself. Long texts are measured whole, in
    time and memory in proportion. Other columns are ignored. An empty table gives no rows.
    """
    out = scored(docs.select("doc_id", "text"), train_quality(docs, labels), "score")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

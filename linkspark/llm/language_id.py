"""Language identification of mixed texts.

The script of a word, found from ranges of code points, narrows the languages that it can be in. Each word is then scored
for every candidate by its letter pairs and triples, and the Viterbi path over the words, with a penalty for each switch,
labels spans of one language. A document's language is the one with most letters on the path.

All scores of a batch are made at once on the array of its code points. Where no stretch of a document gains more by other
languages than one switch costs, the path is constant; only the other documents go through the steps of Viterbi, all
documents of a batch at the same step together.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.llm.common import appended, fold, hash_limit, small_batches

#: First and last code point of scripts.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
NAMES = ["other", *dict.fromkeys(s[0] for s in SCRIPTS)]
BUCKETS = 1 << 16
#: Characters whose words are made and scored at once.
SLICE = 1 << 20
#: A language has a script if so large a share of its letters is in it.
SHARE = 0.01
NEVER = -1e4
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))
FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
UNKNOWN = {"lang_pred": "und", "score": 0.0, "spans": []}


@lru_cache(1)
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: 1 for a mark and 2 for a letter, its lower case, its script."""
    kind, low, script = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        first = unicodedata.category(c)[0]
        kind[i] = 2 if first == "L" else first == "M"
        if kind[i] == 2 and len(x := c.lower()) == 1:
            low[i] = ord(x)
    for name, a, b in SCRIPTS:
        script[a : b + 1] = NAMES.index(name)
    return kind, low, script


@dataclass
class Words:
    """The words of some texts: code points, where words start and end, the text of each, hashed letter groups."""

    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    has_letter: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    pairs: np.ndarray
    triples: np.ndarray
    first: np.ndarray
    base: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    kind, low, script = characters()
    coded = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.array([len(c) // 4 + 1 for c in coded], np.int64)
    cp = np.frombuffer(b"\n\0\0\0".join(coded) + b"\n\0\0\0", np.uint32)
    k = kind[cp]
    inside = k > 0
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    doc = np.searchsorted(base, start, side="right") - 1
    c = np.where(inside, low[cp], 0).astype(np.uint64)
    p1 = np.concatenate([[0], c[:-1]]).astype(np.uint64)
    p2 = np.where(p1 > 0, np.concatenate([[0, 0], c[:-2]])[: len(c)] if len(c) > 1 else np.zeros(len(c)), 0).astype(np.uint64)
    at = np.flatnonzero(inside | before)
    a, b, d = c[at], p1[at], p2[at]
    mix = np.uint64(0x9E3779B97F4A7C15)
    two = (b * np.uint64(0x1F123BB5) + a + np.uint64(1)) * mix
    pairs = (two >> np.uint64(48)).astype(np.int64)
    triples = (((two ^ (two >> np.uint64(29))) + (d + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93)) * mix >> np.uint64(48)).astype(np.int64)
    first = np.searchsorted(at, start)
    is_letter = k == 2
    has = np.maximum.reduceat(is_letter, start) if len(start) else np.zeros(0, bool)
    letters = np.add.reduceat(is_letter.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    return Words(at, start, end, doc, has, script[cp[start]] if len(start) else np.zeros(0, np.uint8), letters, pairs, triples, first, base)


def sliced(texts: list[str | None], size: int | None = None) -> Iterator[tuple[np.ndarray, Words]]:
    """The words of ``texts`` by slices of about SLICE characters, with the number of the text of each slice's parts.

    A long text is cut before a character that is neither letter nor mark; a word is never cut. Places are in the whole text.
    """
    size = size or SLICE
    doc: list[int] = []
    parts: list[tuple[str, int]] = []
    room = size

    def words() -> tuple[np.ndarray, Words]:
        w = words_of([p for p, _ in parts])
        w.base = w.base - np.array([at for _, at in parts], np.int64)
        return np.array(doc, np.int64), w

    for i, text in enumerate(texts):
        at, text = 0, text or ""
        while True:
            end = at + room
            if end < len(text):
                end = next((k for k in range(end, len(text)) if unicodedata.category(text[k])[0] not in "LM"), len(text))
            doc.append(i)
            parts.append((text[at:end], at))
            room -= len(text[at:end])
            at = end
            if room <= 0:
                yield words()
                doc, parts, room = [], [], size
            if at >= len(text):
                break
    if parts:
        yield words()


@dataclass
class Languages:
    names: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    allowed: np.ndarray = field(default_factory=lambda: np.ones((len(NAMES), 0), bool))
    penalty: float = 12.0

    def word_scores(self, w: Words) -> np.ndarray:
        if not len(w.start):
            return np.zeros((0, len(self.names)), np.float32)
        sums = np.zeros((len(w.start), len(self.names)), np.float32)
        for j in range(len(self.names)):  # a language at a time: letters by languages would be a large array
            own = self.table[:, j]
            sums[:, j] = np.add.reduceat(own[w.pairs] + own[w.triples], w.first, dtype=np.float32)
        return np.where(self.allowed[w.script], sums, np.float32(NEVER))

    def paths(self, scores: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
        """The language of each word: the best path of each document under the switching penalty."""
        out = np.zeros(len(scores), np.int64)
        hard = []
        for a, b in bounds:
            s = scores[a:b].astype(np.float64)
            one = int(np.argmax(s.sum(0)))
            out[a:b] = one
            if s.shape[1] > 1:
                rest = np.delete(s, one, 1).max(1) - s[:, one]
                c = np.cumsum(rest)
                low = np.minimum.accumulate(np.concatenate([[0.0], c[:-1]]))
                if (c - low).max() > self.penalty:
                    hard.append((a, b))
        if hard:
            self._viterbi(scores, sorted(hard, key=lambda x: x[0] - x[1]), out)
        return out

    def _viterbi(self, scores: np.ndarray, bounds: list[tuple[int, int]], out: np.ndarray) -> None:
        """bounds by falling length, so that those still under way are a prefix."""
        a = np.array([x[0] for x in bounds])
        n = np.array([x[1] - x[0] for x in bounds])
        best = scores[a].astype(np.float64)
        back: list[tuple[np.ndarray, np.ndarray]] = []  # of each word: the best language, and which others come from it
        live = [int(np.searchsorted(-n, -t, side="left")) for t in range(int(n[0]) + 1)]  # documents longer than t words
        for t in range(1, int(n[0])):
            k = live[t]
            now = best[:k]
            top = now.argmax(1)
            other = now[np.arange(k), top] - self.penalty
            switch = other[:, None] > now
            back.append((top.astype(np.int16), np.packbits(switch, axis=1)))
            best[:k] = np.where(switch, other[:, None], now) + scores[a[:k] + t]
        state = best.argmax(1)
        out[a + n - 1] = state
        for t in range(int(n[0]) - 1, 0, -1):
            k = live[t]
            top, switch = back[t - 1]
            moved = switch[np.arange(k), state[:k] >> 3] >> (7 - (state[:k] & 7)) & 1
            state[:k] = np.where(moved, top, state[:k])
            out[a[:k] + t - 1] = state[:k]

    def identify(self, texts: list[str | None]) -> list[dict]:
        """Language, score and spans of each text. A text takes, for each word, a number per language and a few more."""
        result = [UNKNOWN] * len(texts)
        if not self.names:
            return result
        own = []
        for part, w in sliced(texts):
            k = w.has_letter
            base = w.base[w.doc[k]]
            own.append((self.word_scores(w)[k], w.start[k] - base, w.end[k] - base, part[w.doc[k]], w.letters[k]))
        scores, start, end, doc, letters = (np.concatenate(x) for x in zip(*own, strict=True)) if own else [np.zeros(0)] * 5
        if not len(scores):
            return result
        edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
        bounds = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        path = self.paths(scores, bounds)
        for a, b in bounds:
            own, i = path[a:b], int(doc[a])
            sums = np.bincount(own, letters[a:b], len(self.names))
            lang = int(np.argmax(sums))
            cut = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [b - a]])
            spans = [{"start": int(start[a + x]), "end": int(end[a + y - 1]), "lang": self.names[own[x]]} for x, y in zip(cut[:-1], cut[1:], strict=True)]
            result[i] = {"lang_pred": self.names[lang], "score": float(sums[lang] / sums.sum()), "spans": spans}
        return result


def train_languages(docs: DataFrame, folds: int = 4, out_fold: int = 2, per_language: int = 4000, penalty: float = 12.0) -> Languages:
    """Learn from text and lang of the documents whose id's fold is not ``out_fold``: about ``per_language`` of each
    language at most, drawn by a hash of the text, so that the same rows give the same model however they are dealt. Copies
    of a text teach once, rows without a lang or a text nothing. The model has BUCKETS numbers for each distinct lang."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != out_fold))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return Languages()
    limits = spark.createDataFrame([(n, hash_limit(sizes[n], per_language)) for n in names], "lang string, upto long")
    sample = known.join(F.broadcast(limits), "lang").where(F.xxhash64("text", F.lit("lang")) <= F.col("upto")).select("lang", "text")
    sample = sample.distinct()  # copies teach once, however many there are
    index = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for doc, w in sliced(batch.column("text").to_pylist()):
                if not len(w.start):
                    continue
                of_word = np.repeat(np.arange(len(w.start)), np.diff(np.append(w.first, len(w.at))))
                lang = which[doc[w.doc]]
                grams = np.concatenate([lang[of_word] * BUCKETS + g for g in (w.pairs, w.triples)])
                scripts = np.repeat(lang * len(NAMES) + w.script, w.letters)
                for kind, cells, width in (("gram", grams, BUCKETS), ("script", scripts, len(NAMES))):
                    cell, n = np.unique(cells, return_counts=True)
                    columns = [pa.array([kind] * len(cell), pa.string()), pa.array(cell // width, pa.int32()), pa.array(cell % width, pa.int32()), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["kind", "lang", "cell", "n"])

    counts = sample.mapInArrow(count, "kind string, lang int, cell int, n long").groupBy("kind", "lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    grams, scripts = np.zeros((BUCKETS, len(names))), np.zeros((len(NAMES), len(names)))
    is_gram = np.array(counts["kind"].to_pylist()) == "gram"
    lang, cell, n = (np.array(counts[c]) for c in ("lang", "cell", "n"))
    grams[cell[is_gram], lang[is_gram]] = n[is_gram]
    scripts[cell[~is_gram], lang[~is_gram]] = n[~is_gram]
    table = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS))
    allowed = scripts >= np.maximum(1, SHARE * scripts.sum(0))
    allowed[~allowed.any(1)] = True  # no learned language has the script: all are candidates
    return Languages(names, (table - table.mean(1, keepdims=True)).astype(np.float32), allowed, penalty)


def identified(docs: DataFrame, model: Languages, name: str) -> DataFrame:
    """``docs`` with a struct column ``name``: lang_pred, score and spans (characters) of one language each."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])
    return appended(docs, name, FOUND, lambda texts: pa.array(shared.value.identify(texts), kind))


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the letters in that language), spans of each row of ``docs``.

    A null, empty or letterless text is ``und`` with score 0, and so is any text if nothing could be learned. A null id's
    fold is that of the empty text. Repeated rows each give a row. Of equally good languages the first by name is taken.
    Long texts are read whole, SLICE characters at a time; what remains of them is a few numbers and one per language for
    each word. Other columns are ignored. An empty table: no rows.
    """
    out = identified(docs.select("doc_id", "text"), train_languages(docs), "found")
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "found.*")

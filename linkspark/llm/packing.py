"""Harmonic packing of token sequences.

Lengths are partitioned into classes by the reciprocals of the capacity: class k has those over capacity / (k + 1) and up to
capacity / k, and a sequence of it takes k pieces. Documents are tokenised and ended by a separator. What is left after
whole capacities is a piece of its class if it all but fills a k-th of a sequence; else a piece of exactly capacity / (k + 1)
is cut from it, and its rest, which is short, is placed likewise. Each worker fills its own sequences, knowing at once where
a piece goes; the few sequences still open at its end, one per class at most, are merged first-fit.

Ids come from the library, once per distinct white-space separated chunk and worker: no token of this kind of vocabulary
crosses white space.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from linkspark.llm.common import small_batches

#: A piece may leave so large a share of its place in a sequence empty. More would cut fewer documents and pad more.
SLACK = 0.04
#: Chunks whose ids a worker remembers in a task, and how many of them it keeps then: those it met first, as the frequent
#: ones are met early.
MEMO, KEEP = 250_000, 150_000
#: Other chunks given to the library at once.
SLICE = 2000
ONE_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?")


class Encoder:
    """Ids of texts as the library gives them, without special tokens added.

    New chunks that are one word of Latin-1 letters, perhaps with a point or comma after it, are encoded many in a string:
    word and stop are one pre-token each, of which the last piece, and no other, is one that ends a word.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        # single words need neither the normalizer's nor the splitter's expressions, if this one lowers and splits alike
        self.of_words = Tokenizer.from_file(path)
        self.of_words.normalizer = None
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        letters = [chr(c) for c in range(0x100) if ONE_WORD.fullmatch(chr(c))]
        probe = [*letters, *(f"{c}{c}a." for c in letters), *(f"a{c}," for c in letters), "Word.", "Straße"]
        self.lowers = self._whole(" ".join(probe)) == self._of_words(probe)
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.start = np.zeros(1 << 18, np.int64)
        self.length = np.zeros(1 << 18, np.int64)
        self.used = 0

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _of_words(self, words: list[str]) -> list[int]:
        text = " ".join(words).lower().replace(".", " .").replace(",", " ,")
        return self.of_words.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def forget(self) -> None:
        """Keep the first KEEP chunks, whose ids are the first of ``flat``."""
        if len(self.index) > KEEP:
            self.used = int(self.start[KEEP])
            self.index = dict(islice(self.index.items(), KEEP))
            self.flat = self.flat[: max(self.used, 1)].copy()
            self.start, self.length = self.start[:KEEP].copy(), self.length[:KEEP].copy()

    def _add(self, chunks: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        k, n = len(self.index), len(chunks)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        if k + n > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * (k + n)), np.resize(self.length, 2 * (k + n))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + n] = self.used + np.cumsum(length) - length
        self.length[k : k + n] = length
        self.used += len(ids)
        self.index.update(zip(chunks, range(k, k + n), strict=True))

    def _learn(self, chunks: list[str]) -> None:
        plain = list(map(ONE_WORD.fullmatch, chunks))
        words = [c for c, m in zip(chunks, plain, strict=True) if m]
        other = [c for c, m in zip(chunks, plain, strict=True) if not m]
        for at in range(0, len(other), SLICE):  # the library's encodings are large beside their ids
            some = other[at : at + SLICE]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self._add(some, np.array([i for x in ids for i in x], np.uint32), np.array(list(map(len, ids)), np.int64))
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.array(self._of_words(some) if self.lowers else self._whole(" ".join(some)), np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum([1 + (c[-1] in ".,") for c in some]) - 1
            if len(cut) != last[-1] + 1:
                raise ValueError("the tokenizer does not mark the ends of words")
            self._add(some, ids, np.diff(cut[last], prepend=0))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text. Chunks are what ASCII white space parts, which every rule of the tokenizer does too; they are
        split and numbered in Arrow, so that only distinct ones become Python strings."""
        if len(self.index) > MEMO:
            self.forget()
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        coded = parts.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        if len(new := np.flatnonzero(known < 0).tolist()):
            self._learn([chunks[i] for i in new])
            known[new] = [self.index[chunks[i]] for i in new]
        at = known[coded.indices.to_numpy()] if len(chunks) else np.zeros(0, np.int64)
        n = self.length[at]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces, in order: whole capacities, then places of falling size, the last all but filled."""
    out, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        k = capacity // rest
        if rest < (1 - SLACK) * (capacity // k):
            out.append(capacity // (k + 1))
            rest -= out[-1]
        else:
            out.append(rest)
            rest = 0
    return out


@dataclass
class Bins:
    """The open sequences of a worker, one per class: number of pieces wanted; sequence, pieces and ids so far."""

    capacity: int
    first: int
    made: int = 0
    open: dict[int, list[int]] = field(default_factory=dict)

    def fresh(self) -> int:
        self.made += 1
        return self.first + self.made - 1

    def kind(self, length: int) -> int:
        """The class: how many of its pieces fill a sequence."""
        return self.capacity // length

    def place(self, length: int) -> tuple[int, int, int]:
        """Sequence and offset of a piece, and its class; the class's sequence closes with its last piece."""
        k = self.kind(length)
        at = self.open.setdefault(k, [self.fresh(), 0, 0])
        spot = (at[0], at[2], k)
        at[1] += 1
        at[2] += length
        if at[1] == k:
            del self.open[k]
        return spot

    def merged(self) -> dict[int, tuple[int, int]]:
        """Where the sequences still open go: first-fit by falling length, as (sequence, offset) by old sequence."""
        bins: list[list[int]] = []
        to: dict[int, tuple[int, int]] = {}
        for seq, _, used in sorted(self.open.values(), key=lambda x: (-x[2], x[0])):
            for b in bins:
                if b[1] + used <= self.capacity:
                    to[seq] = (b[0], b[1])
                    b[1] += used
                    break
            else:
                bins.append([seq, used])
                to[seq] = (seq, 0)
        return to


NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _packed(path: str, capacity: int, separator: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        waiting: dict[int, list[tuple]] = {}  # pieces of open sequences: a sequence per class at most

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * (len(NAMES) + 1 + with_ids)
            arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1 : len(NAMES) + 1])]
            if with_ids:
                arrays.append(pa.array(columns[-1], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", *NAMES, *["ids"] * with_ids])

        kind = None
        for batch in batches:
            kind, done = batch.schema.field("doc_id").type, []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), own.encode(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(separator)).astype("<u4")
                at = 0
                for n in cuts(len(ids), capacity):
                    piece = ids[at : at + n]
                    sequence, offset, k = bins.place(n)
                    row = (doc, at, n, zlib.crc32(piece.tobytes()), len(ids), sequence, offset, *([piece.tolist()] if with_ids else []))
                    at += n
                    if k == 1:
                        done.append(row)
                        continue
                    waiting.setdefault(sequence, []).append(row)
                    if k not in bins.open:
                        done += waiting.pop(sequence)
            yield batch_of(done)
        own.forget()
        if kind is not None:
            to = bins.merged()
            yield batch_of([(*r[:5], to[s][0], to[s][1] + r[6], *r[7:]) for s, rows in waiting.items() for r in rows])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids on demand) of each piece.

    ``docs`` (doc_id, text): a null or empty text is the separator alone. Null ids are kept; repeated rows are packed
    each, ties cannot matter, as places go by the order of a worker's rows. Long texts are cut into whole sequences and a
    rest; their ids are held while they are packed. Other columns are ignored; an empty table gives no rows. sequence_id is
    unique, not dense: the worker's number and a count. A sequence is padded to ``capacity`` unless its length is a power of
    two.
    """
    if capacity < 2:
        raise ValueError("a sequence must hold two ids at least")
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    fields = [rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in NAMES), *[T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids]
    return rows.mapInArrow(_packed(tokenizer, capacity, separator, with_ids), T.StructType(fields))

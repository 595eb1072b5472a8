"""Token counts by distinct pre-tokens.

A byte-level BPE never merges across pre-tokens, so a document's count is the sum, over its distinct pre-tokens, of
frequency times pieces. Pieces are counted once per distinct pre-token; ids of documents are never made.

Plan: one pass over the texts splits them and counts pre-tokens per document. The most frequent pre-tokens (picked on a
bounded sample, at most ``hot`` of them, so of a size known beforehand) are summed at once in that pass; all others leave
it as rows (document, pre-token, frequency), are written once, counted per distinct pre-token, joined back and summed.
The pick decides only which way a pre-token takes, never the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from linkspark.llm.common import bounded_sample, small_batches, written

#: The split of the byte-level scheme.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which every Unicode version and regex engine agrees; other texts go through the library's own splitter.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7E\xA1-ɏ]*")


class Splitter:
    """Splits a text as the tokenizer does, before any piece is made."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added) or self.tokenizer.normalizer is not None:
            raise ValueError("only tokenizers without a normalizer and with plain added tokens")
        contents = sorted((t.content for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, contents))) if contents else None
        self.split = regex.compile(SPLIT).findall

    def counts(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens with frequencies, and the number of special strings, each of which is one token."""
        parts = self.special.split(text) if self.special else [text]
        found: Counter = Counter()
        for part in parts:
            if PLAIN.fullmatch(part):
                found.update(self.split(part))
            elif part:
                found.update(part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part))
        return found, len(parts) - 1

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pretokens, add_special_tokens=False)]


@lru_cache(4)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def _sampled(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(splitter(path).counts(text or "")[0])
        yield pa.RecordBatch.from_pydict({"pretoken": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return run


def _frequencies(path: str, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = hot.value, splitter(path)
        for batch in batches:
            rows, words, ns, size = [], [], [], []
            numbers = batch.column("row").to_pylist()
            at = []  # where each document's own row is: only that has its id
            for number, text in zip(numbers, batch.column("text").to_pylist(), strict=True):
                counts, total = split.counts(text or "")
                for word, n in counts.items():
                    p = known.get(word)
                    if p is None:
                        rows.append(number)
                        words.append(word)
                        ns.append(n)
                    else:
                        total += n * p
                at.append(len(rows))
                rows.append(number)
                size.append(len((text or "").encode()))
                words.append(None)
                ns.append(total)
            place = np.full(len(rows), -1, np.int64)
            place[at] = np.arange(len(at))
            own = pa.array(place, mask=place < 0)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), batch.column("doc_id").take(own), pa.array(size, pa.int64()).take(own), pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["row", "doc_id", "n_bytes", "pretoken", "n"])

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(splitter(path).pieces(batch.column(0).to_pylist()), pa.int64())], ["pretoken", "pieces"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, hot: int = 200_000, sample: int = 4000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of each row of ``docs`` (doc_id, text).

    ``tokenizer`` is the path of a tokenizers file. Null text counts as empty: 0 bytes, 0 tokens. Null doc_ids are kept.
    Repeated rows each give a row. Rows with one doc_id and different texts are different documents. An empty table
    gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    picked = bounded_sample(docs, F.struct("doc_id", "text"), sample).select("text").mapInArrow(_sampled(tokenizer), "pretoken string, n long")
    top = [r[0] for r in picked.groupBy("pretoken").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "pretoken").limit(hot).select("pretoken").toLocalIterator()]
    known = spark.sparkContext.broadcast(dict(zip(top, splitter(tokenizer).pieces(top), strict=True)))

    # a row's number is made and used within one written table: all that a document yields comes from one task
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = T.StructType([T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("pretoken", T.StringType()), T.StructField("n", T.LongType())])
    freq = written(numbered.mapInArrow(_frequencies(tokenizer, known), schema), "pretokens")
    rare = freq.where("pretoken IS NOT NULL").select("row", "pretoken", "n")
    pieces = rare.select("pretoken").distinct().mapInArrow(_pieces(tokenizer), "pretoken string, pieces long")
    sums = rare.join(pieces, "pretoken").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rare"))
    each = freq.where("pretoken IS NULL").join(sums, "row", "left")
    n_tokens = F.col("n") + F.coalesce("rare", F.lit(0))
    return each.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))

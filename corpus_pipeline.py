"""A training corpus from ``documents``: toxic documents go, near duplicates go, personal data is replaced, sources are
mixed to their weights, and what remains is packed into token sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of their input, whatever other columns it has: names that a stage needs for itself give way to them. Texts are read
whole, however long. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm.common import forget, fresh, table, written
from linkspark.llm.mixing import mixed_documents
from linkspark.llm.packing import pack
from linkspark.llm.near_duplicates import drop_near_duplicates
from linkspark.llm.surrogates import session_key, with_surrogates
from linkspark.llm.toxicity import drop_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model, trained on the labels of ``sf_dir``, does not call toxic.

    Null and empty texts stay; equal texts have one verdict, so that repeated rows stay or go together. Null ids are judged
    like others. Without labels of both kinds nothing goes.
    """
    return drop_toxic(docs, train_toxicity(docs, table(spark, sf_dir, "labels")), fresh(docs, "verdict"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more: the smallest id, null ids last, ties by
    a hash of the text; of equal rows one. Null, empty and wordless texts are one group."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data; n_chars follows. Null texts stay null, and their n_chars is null.
    Repeated rows are rewritten alike, equal entities too, in all documents. The key is the session's (``session_key``)."""
    name = fresh(docs, "new")
    columns = {"text": F.col(name)["text"]}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length(F.col(name)["text"]).cast(docs.schema["n_chars"].dataType)
    return with_surrogates(docs, name, session_key(spark)).withColumns(columns).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight has them, stored in the order of the mixture. Null sources are one source,
    null texts count one token, rows equal in id and text are taken together, ties go by id."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; a null or empty text is its end token alone. Repeated rows are
    packed each. Columns: those of ``pack``."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixing), ("packing", packing)]
#: SQL has neither the learned model nor the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(before)  # nothing reads it any more; the input itself is not a written table
    return STAGES[-1][1](spark, docs, sf_dir)

"""Surrogates for personal data.

Detected entities are replaced by keyed surrogates of the same type, script and format: e-mail for e-mail, a card number
with the same check for a card number, a given name of the gender that its title tells for a given name. A surrogate is a
function of the key and the entity's normal form, so that equal entities stay equal however they are written, in all
documents. Over the whole corpus it is then checked that no surrogate is somebody's real value and no two are equal: such
entities move on, to other permutations of their format and then to a wider format or a reserved range (``pii_forms``).
Data never make it fail: what still clashes after all attempts keeps its last surrogate and is marked ``unmet``.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.llm.common import appended, forget, fresh, small_batches, written
from linkspark.llm.pii_detect import GIVEN, NAMES, detect
from linkspark.llm.pii_forms import laid_out, surrogate, tweaked

#: Moved entities that are sent to every worker; beyond, they are joined to the texts that have them, over salts.
MAX_BROADCAST, SALTS = 200_000, 16
#: The setting with the key of the registered query and the pipeline.
KEY_SETTING = "spark.linkspark.surrogates.key"

MENTIONS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("entity", T.StringType())]))
FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("surrogate", T.StringType()),
            T.StructField("unmet", T.BooleanType()),
        ]
    )
)
REWRITTEN = T.StructType([T.StructField("text", T.StringType()), T.StructField("entities", FOUND)])
_PA_PAIR = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string())]))
_PA_FOUND = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string()), ("unmet", pa.bool_())])
_PA_REWRITTEN = pa.struct([("text", pa.string()), ("entities", pa.list_(_PA_FOUND))])

Moves = dict[tuple[str, str], tuple[int, bool]]


def session_key(spark: SparkSession) -> str:
    """The key that ``KEY_SETTING`` holds; without one a secret is drawn and kept there, so that a session has one key."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


@lru_cache(100_000)
def _surrogate(kind: str, entity: str, key: str, attempt: int) -> str:
    return surrogate(kind, entity, tweaked(key, kind, attempt), attempt)


def entities_of(text: str | None) -> list[tuple[str, str]]:
    return sorted({(kind, entity) for _, _, kind, entity in detect(text)})


def rewrite(text: str | None, key: str, moves: Moves) -> dict:
    """The text with its entities replaced, and where (in the text as it was) by what."""
    out, at, found = [], 0, []
    for a, b, kind, entity in detect(text):
        attempt, unmet = moves.get((kind, entity), (0, False))
        new = laid_out(kind, text[a:b], _surrogate(kind, entity, key, attempt))
        out += [text[at:a], new]
        at = b
        found.append({"kind": kind, "start": a, "end": b, "surrogate": new, "unmet": unmet})
    return {"text": None if text is None else "".join(out) + text[at:], "entities": found}


def _class(kind: Column) -> Column:
    """Kinds that a reader cannot tell apart must differ from each other too."""
    return F.when(kind.isin(*NAMES), F.lit("name")).otherwise(kind)


def moved_entities(entities: DataFrame, key: str, rounds: int = 24) -> DataFrame:
    """kind, entity, attempt, unmet of those distinct ``entities`` (kind, entity) whose first surrogate is real or taken.

    Dates, and listed names within their list, are permuted among real values and need only be distinct.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "entity", "attempt")), strict=True)
            new = pa.array([surrogate(k, e, tweaked(key, k, n), n) for k, e, n in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], ["kind", "entity", "attempt", "surrogate"])

    shape = "kind string, entity string, attempt int, surrogate string"
    now = written(entities.select("kind", "entity", F.lit(0).alias("attempt")).mapInArrow(made, shape), "surrogates")
    real = entities.select(_class(F.col("kind")).alias("class"), F.col("entity").alias("surrogate")).distinct().withColumn("real", F.lit(True))
    listed = F.lit(False)
    for (gender, _), names in GIVEN.items():
        listed = listed | ((F.col("kind") == f"given_{gender}") & F.col("entity").isin(names))
    among_real = (F.col("kind") == "birth_date") | (listed & (F.col("attempt") == 0) & (F.col("entity") != F.col("surrogate")))
    first = Window.partitionBy("class", "surrogate").orderBy("attempt", F.desc(among_real), "kind", "entity")
    for attempt in range(rounds + 1):
        checked = now.withColumn("class", _class(F.col("kind"))).join(real, ["class", "surrogate"], "left")
        bad = (F.row_number().over(first) > 1) | (F.col("real").isNotNull() & ~among_real)
        marked = written(checked.select("kind", "entity", "attempt", "surrogate", bad.alias("bad")), "checked")
        forget(now)
        if attempt == rounds or marked.where("bad").isEmpty():
            break
        moved = marked.where("bad").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")).mapInArrow(made, shape)
        now = written(marked.where("NOT bad").select("kind", "entity", "attempt", "surrogate").unionByName(moved), "surrogates")
        forget(marked)
    return marked.where("attempt > 0 OR bad").select("kind", "entity", "attempt", F.col("bad").alias("unmet"))


def with_surrogates(docs: DataFrame, name: str, key: str) -> DataFrame:
    """``docs`` with a struct column ``name``: the rewritten text, and entities (kind, start, end, surrogate, unmet).

    ``key`` is the caller's secret: who has it can tell which entity a surrogate stands for. A null text stays null and has
    no entities; texts without any, empty ones among them, stay as they are. Long texts take time and memory in proportion.
    Equal texts, repeated rows and null ids do not matter: each row is rewritten by itself. Of two entities with one
    surrogate, the later by (attempt, kind, entity) moves. Other columns are kept, whatever their names. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    k = fresh(docs, "text_key")
    pairs = lambda texts: pa.array([[{"kind": a, "entity": b} for a, b in entities_of(t)] for t in texts], _PA_PAIR)
    found = appended(docs.select("text"), "mentions", MENTIONS, pairs).where(F.size("mentions") > 0)
    mentions = written(found.select(F.xxhash64("text").alias(k), F.explode("mentions").alias("m")).select(k, "m.*").distinct(), "mentions")
    moved = written(moved_entities(mentions.select("kind", "entity").distinct(), key), "moved")
    if moved.count() <= MAX_BROADCAST:
        moves = {(r.kind, r.entity): (r.attempt, r.unmet) for r in moved.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(moves)
        return appended(docs, name, REWRITTEN, lambda texts: pa.array([rewrite(t, key, shared.value) for t in texts], _PA_REWRITTEN))
    # each text with moved entities, by its hash, gets what they moved to; a text may be in many rows
    o, s, pair = fresh(docs, "overrides"), fresh(docs, "salt"), fresh(docs, "pair")
    own = mentions.join(moved, ["kind", "entity"]).groupBy(k).agg(F.collect_list(F.struct("kind", "entity", "attempt", "unmet")).alias(o))
    own = own.withColumn(s, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = docs.withColumns({k: F.xxhash64("text"), s: F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")})
    joined = keyed.join(own, [k, s], "left").withColumn(pair, F.struct(F.col("text").alias("text"), F.col(o).alias("own"))).drop(k, s, o)

    def both(values: list) -> pa.Array:
        moves = ({(x["kind"], x["entity"]): (x["attempt"], x["unmet"]) for x in v["own"] or ()} for v in values)
        return pa.array([rewrite(v["text"], key, m) for v, m in zip(values, moves, strict=True)], _PA_REWRITTEN)

    return appended(joined, name, REWRITTEN, both, pair).drop(pair)


def surrogated(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (rewritten), n_entities, entities of each row of ``docs``; see ``with_surrogates``."""
    out = with_surrogates(docs.select("doc_id", "text"), "new", key)
    return out.select("doc_id", "new.text", F.size("new.entities").cast("long").alias("n_entities"), "new.entities")

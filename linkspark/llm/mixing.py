"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens to the power of an exponent, normalised. The exponent is bisected: the
smallest (the flattest mixture) at which no source is repeated more than a limit and the entropy is at most a target. Each
source then has a token budget: whole passes over its documents and a part of one more, taken in the order of a keyed hash.

The mixture is a sequence of blocks. A document's place in its source's own stream of tokens decides the block, so that
every block holds each source in proportion to its weight; inside a block a second keyed hash permutes the documents.

Expressions only. Token sums are taken per source and bin of the hash, of which a source has BINS; running sums therefore
see a bounded number of rows however large the source, and documents meet nothing but their source's row. Sources are rows
too: the bisection asks for sums over all of them, five steps at a time, and only those sums reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.common import WORD, forget, written

#: Bins of a source's hash order, and of the table that places a document in its source's stream.
BINS, PLACES = 65_536, 64
#: Steps of the bisection, and how many of them are prepared by one pass over the sources.
STEPS, AHEAD = 30, 5
UNIT = float(1 << 60)
#: Sources of which a broadcast is made; beyond, the join is salted.
MAX_BROADCAST, SALTS = 20_000, 128


def _hash(text: str, duck: bool = False) -> str:
    """60 bits of an MD5, as a whole number."""
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)" if duck else f"CAST(conv(substr(md5({text}), 1, 15), 16, 10) AS BIGINT)"


def _row_text(duck: bool = False) -> str:
    """What tells documents apart: id and text. A null id is empty, a null text a dash."""
    kind = "VARCHAR" if duck else "STRING"
    return f"coalesce(CAST(doc_id AS {kind}), ''), ':', coalesce(md5(text), '-')"


def measured(docs: DataFrame, seed: str) -> DataFrame:
    """kept (the whole row), doc_id, source (null as empty), tokens (words, 1 at least), row (of id and text) and h, its keyed hash."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"),
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.greatest(F.lit(1), words).cast("long").alias("tokens"),
        F.expr(f"concat({_row_text()})").alias("row"),
    )
    return own.withColumn("h", F.expr(_hash(f"concat('{seed}:', row)")))


#: A share to the power of an exponent, and that times its logarithm, as decimals: sums do not depend on the order.
POWER, LOGGED = "CAST(power(p, e) AS DECIMAL(38,15))", "CAST(power(p, e) * ln(p) AS DECIMAL(38,15))"


def _sums(sources: DataFrame, total: float, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """Of each exponent the sums of POWER and LOGGED over all sources."""
    asked = sources.select((F.col("t") / F.lit(total)).alias("p"), F.explode(F.array(*map(F.lit, exponents))).alias("e"))
    rows = asked.groupBy("e").agg(*[F.sum(F.expr(x)).cast("double") for x in (POWER, LOGGED)]).collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def bisected(sources: DataFrame, total: float, meets: Callable[[float, float, float], bool], high: float) -> float:
    """The end of STEPS halvings of 0 to ``high`` towards the least exponent e with ``meets(e, mass, logged)``."""
    lo, hi = 0.0, high
    for _ in range(0, STEPS, AHEAD):
        spans, middles = [(lo, hi)], []  # all middles that the next steps can come to
        for _ in range(AHEAD):
            now = [(a + b) / 2.0 for a, b in spans]
            middles += now
            spans = [s for (a, b), m in zip(spans, now, strict=True) for s in ((a, m), (m, b))]
        known = _sums(sources, total, middles)
        for _ in range(AHEAD):
            middle = (lo + hi) / 2.0
            lo, hi = (lo, middle) if meets(middle, *known[middle]) else (middle, hi)
    return hi


def source_plan(rows: DataFrame, budget: float, repetition: float, entropy: float | None, grain: int) -> DataFrame:
    """A row per source: its tokens, quota, whole passes, first bin left out of the last pass, running sums at PLACES.

    ``rows`` has source, tokens, h.
    """
    bins = rows.groupBy("source", F.expr(f"CAST(floor(h / {UNIT}D * {BINS}) AS INT)").alias("bin")).agg(F.sum("tokens").alias("n"))
    bins = written(bins.withColumn("place", F.expr(f"bin DIV {BINS // PLACES}")), "sums")
    # running sums inside each place, and over the places before it: no task sees all bins of a source
    places = bins.groupBy("source", "place").agg(F.sum("n").alias("m"))
    earlier = F.sum("m").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    before = places.select("source", "place", F.coalesce(earlier, F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("source", "place").orderBy("bin"))
    upto = bins.withColumn("inside", inside).join(before, ["source", "place"])
    upto = written(upto.select("source", "bin", "n", (F.col("before") + F.col("inside")).alias("upto")), "bins")
    forget(bins)
    up_to_place = [F.coalesce(F.max(F.when(F.col("bin") < (p + 1) * (BINS // PLACES), F.col("upto"))), F.lit(0)) for p in range(PLACES)]
    places = F.array(F.lit(0).cast("long"), *up_to_place)
    sources = written(upto.groupBy("source").agg(F.sum("n").alias("t"), places.alias("places")), "sources")
    total, least = sources.agg(F.sum("t").cast("double"), F.min("t")).first()
    exponent, mass = 1.0, 1.0
    wanted = float(int((total or 0.0) * float(budget)))

    def repeated(e: float, mass: float, _: float) -> bool:  # the smallest source is repeated most
        return (least / total) ** e / mass * wanted / least <= float(repetition)

    def mixed_enough(e: float, mass: float, logged: float) -> bool:
        return math.log(mass) - e * logged / mass <= float(entropy)

    if total:
        exponent = bisected(sources, total, repeated, 1.0)
        if entropy is not None:  # weights to the power of more than 1 where the sources as they are have more entropy
            exponent = max(exponent, bisected(sources, total, mixed_enough, 16.0))
        exponent = math.ceil(exponent * 1_000_000.0) / 1_000_000.0
        mass = _sums(sources, total, [exponent])[exponent][0]
    blocks = max(1, math.ceil(wanted / float(grain)))
    share = f"power(t / {total or 1.0!r}D, exponent) / {mass!r}D * {wanted!r}D"
    quota = sources.withColumns({"exponent": F.lit(exponent), "blocks": F.lit(blocks).cast("long")})
    quota = quota.selectExpr("source", "t", "places", "exponent", "blocks", f"CAST(floor({share} + 0.5D) AS BIGINT) AS quota")
    quota = quota.selectExpr("*", "CAST(quota DIV t AS INT) AS passes", "quota % t AS rest")
    cut = upto.join(quota.select("source", "rest"), "source").where("upto <= rest").groupBy("source").agg(F.max("bin").alias("last"))
    plan = quota.join(cut, "source", "left").selectExpr("source", "t", "quota", "passes", "coalesce(last, -1) AS last", "places", "exponent", "blocks")
    out = written(plan, "mixture")
    forget(upto)
    forget(sources)
    return out


def mixed(docs: DataFrame, budget: float = 1.0, repetition: float = 1.25, entropy: float | None = None, grain: int = 1_000_000, seed: str = "mix") -> DataFrame:
    """kept (a row of ``docs``: doc_id, text, source and any others), doc_id, source, tokens, epoch, block and order (the
    hash that orders a block), once for every time that the mixture has the row.

    ``budget``: tokens of the mixture as a multiple of those there. ``repetition``: how often a source may be repeated at
    most; below ``budget`` no exponent can meet it, and the exponent is 1. ``entropy``: in nats at most, before repetition.
    ``grain``: tokens of a block. A document counts its words, and 1 if it has none or its text is null. Null ids hash as
    the empty text, with the text beside them; rows equal in id and text share a place in the order and are taken or left
    together. Null sources are one source. A source's part of a pass falls short of its budget by at most one bin of its
    hash. Long texts are counted whole; columns of any names are kept in ``kept``. No rows: no rows.
    """
    rows = measured(docs, seed)
    plan = source_plan(rows.select("source", "tokens", "h"), budget, repetition, entropy, grain)
    if plan.count() <= MAX_BROADCAST:
        placed = rows.join(F.broadcast(plan), "source")
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = rows.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["source", "salt"]).drop("salt")
    placed = placed.selectExpr("*", f"h / {UNIT}D AS u").selectExpr("*", f"CAST(floor(u * {PLACES}) AS INT) AS place", f"passes + CAST(CAST(floor(u * {BINS}) AS INT) <= last AS INT) AS copies")
    placed = placed.where("copies > 0").selectExpr("*", f"places[place] + (u * {PLACES} - place) * (places[place + 1] - places[place]) AS start", "explode(sequence(0, copies - 1)) AS epoch")
    placed = placed.selectExpr("*", "CAST(least(floor((CAST(epoch AS DOUBLE) * t + start) / greatest(quota, 1) * blocks), blocks - 1) AS BIGINT) AS block")
    order = _hash(f"concat('{seed}:', CAST(block AS STRING), ':', CAST(epoch AS STRING), ':', row)")
    return placed.selectExpr("kept", "doc_id", "source", "tokens", "epoch", "block", f"{order} AS order")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, position (from 1 in its block) of each document that the mixture has."""
    rows = mixed(docs.select("doc_id", "text", "source"), **options).drop("kept")
    place = F.row_number().over(Window.partitionBy("block").orderBy("order", "doc_id", "epoch", "tokens", "source"))
    return rows.select("doc_id", "source", F.col("tokens").alias("n_tokens"), "epoch", "block", place.cast("long").alias("position"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mixture with the columns of ``docs``, stored in its order: blocks, and permuted inside."""
    rows = mixed(docs, **options).select("kept", "block", "order", "doc_id", "epoch")
    return rows.repartitionByRange("block", "order").sortWithinPartitions("block", "order", "doc_id", "epoch").select("kept.*")


def oracle(budget: float = 1.0, repetition: float = 1.25, grain: int = 1_000_000, seed: str = "mix") -> str:
    """``mixture`` as DuckDB SQL over ``documents``, without an entropy target."""
    mass = "CAST(list_sum(list_transform(ts, lambda x: CAST(power(x / total, {0}) AS DECIMAL(38,15)))) AS DOUBLE)"
    most = "power(ts[1] / total, {0}) / " + mass + " * wanted / ts[1]"
    middle = "((lo + hi) / 2)"
    order = _hash("concat('" + seed + ":', CAST(block AS VARCHAR), ':', CAST(epoch AS VARCHAR), ':', row)", True)
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS source, CAST(greatest(1, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)) AS BIGINT) AS n_tokens, row, {_hash(f"concat('{seed}:', row)", True)} AS h FROM (SELECT *, concat({_row_text(True)}) AS row FROM documents)
), bins AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY bin) AS upto FROM (SELECT source, CAST(floor(h / CAST({UNIT} AS DOUBLE) * {BINS}) AS INTEGER) AS bin, sum(n_tokens) AS n FROM d GROUP BY ALL)
), sources AS (
  SELECT source, CAST(sum(n) AS BIGINT) AS t, list_concat([0], list_transform(range({PLACES}), lambda p: coalesce(list_max(list_transform(list_filter(list({{'b': bin, 'u': upto}}), lambda x: x.b < (p + 1) * {BINS // PLACES}), lambda x: CAST(x.u AS BIGINT))), 0))) AS places FROM bins GROUP BY source
), one AS (
  SELECT ts, total, floor(total * CAST({float(budget)} AS DOUBLE)) AS wanted FROM (SELECT list(t ORDER BY t) AS ts, CAST(sum(t) AS DOUBLE) AS total FROM sources)
), steps AS (
  SELECT 0 AS i, ts, total, wanted, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi FROM one
  UNION ALL
  SELECT i + 1, ts, total, wanted, CASE WHEN {most.format(middle)} <= {float(repetition)} THEN lo ELSE {middle} END, CASE WHEN {most.format(middle)} <= {float(repetition)} THEN {middle} ELSE hi END FROM steps WHERE i < {STEPS}
), fitted AS (
  SELECT total, wanted, exponent, {mass.format('exponent')} AS mass, greatest(1, CAST(ceil(wanted / {float(grain)}) AS BIGINT)) AS blocks FROM (SELECT *, ceil(hi * 1000000) / 1000000 AS exponent FROM steps WHERE i = {STEPS})
), quotas AS (
  SELECT source, t, places, blocks, CAST(floor(power(t / total, exponent) / mass * wanted + CAST(0.5 AS DOUBLE)) AS BIGINT) AS quota FROM sources, fitted
), plans AS (
  SELECT *, quota // t AS passes, coalesce((SELECT max(bin) FROM bins WHERE bins.source = quotas.source AND upto <= quota % t), -1) AS last FROM quotas
), placed AS (
  SELECT *, CAST(floor(u * {PLACES}) AS INTEGER) AS place, passes + CASE WHEN CAST(floor(u * {BINS}) AS INTEGER) <= last THEN 1 ELSE 0 END AS copies FROM (SELECT *, h / CAST({UNIT} AS DOUBLE) AS u FROM d JOIN plans USING (source))
), copies AS (
  SELECT *, CAST(unnest(range(copies)) AS INTEGER) AS epoch, places[place + 1] + (u * {PLACES} - place) * (places[place + 2] - places[place + 1]) AS start FROM placed WHERE copies > 0
), blocked AS (
  SELECT *, CAST(least(floor((CAST(epoch AS DOUBLE) * t + start) / greatest(quota, 1) * blocks), blocks - 1) AS BIGINT) AS block FROM copies
)
SELECT doc_id, source, n_tokens, epoch, block, row_number() OVER (PARTITION BY block ORDER BY {order}, doc_id, epoch, n_tokens, source) AS position FROM blocked
"""

"""The algebra of candidate pairs: combine passes, keep by a configuration, censor ranks, attach target statistics.

A pair frame has source1_id, target_id and one nullable column per pass: ranks (their names contain 'rank') and scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDS = ["source1_id", "target_id"]
#: A missing rank compares as this.
FAR = 32767


def is_rank(column: str) -> bool:
    return "rank" in column


def active(config: dict) -> dict[str, int]:
    """The rank columns of a configuration with a depth."""
    return {c: k for c, k in config.items() if isinstance(k, int) and not isinstance(k, bool) and k > 0 and is_rank(c)}


def combine(*frames: DataFrame) -> DataFrame:
    """One row per pair of any frame: the least rank and the highest score of each pass, null where none found it."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return every.groupBy(*IDS).agg(*[(F.min(c) if is_rank(c) else F.max(c)).alias(c) for c in every.columns if c not in IDS])


def _within(column: str, depth: int) -> Column:
    return F.coalesce(F.col(column), F.lit(FAR)) <= depth


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def select_pairs(frame: DataFrame, config: dict) -> DataFrame:
    """Pairs that a forward pass has within its depth, and of those that only others have, by best rank and id, as many
    per entity as the forward depths add up to. Adds found_by (a bit per pass) and n_passes."""
    used = {c: k for c, k in active(config).items() if c in frame.columns}
    forward = {c: k for c, k in used.items() if c.startswith("rank_")}
    other = {c: k for c, k in used.items() if c not in forward}
    hit = {c: _within(c, k) for c, k in used.items()}
    marked = frame.withColumn("_forward", _any([hit[c] for c in forward])).where(F.col("_forward") | _any([hit[c] for c in other]))
    ranks = [F.coalesce(F.col(c), F.lit(FAR)) for c in other] + [F.lit(FAR)] * 2
    place = F.row_number().over(Window.partitionBy("source1_id", "_forward").orderBy(F.least(*ranks), "target_id"))
    kept = marked.withColumn("_place", place).where(F.col("_forward") | (F.col("_place") <= sum(forward.values())))
    bits = reduce(lambda a, b: a + b, [F.when(hit[c], F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(used)], F.lit(0))
    count = reduce(lambda a, b: a + b, [hit[c].cast("int") for c in used], F.lit(0))
    return kept.withColumns({"found_by": bits.cast("int"), "n_passes": count.cast("byte")}).drop("_forward", "_place")


def censor(frame: DataFrame, config: dict) -> DataFrame:
    """Ranks beyond a pass's depth, or missing, become depth + 1; rank columns without a depth go."""
    used = active(config)
    frame = frame.drop(*[c for c in frame.columns if is_rank(c) and c not in used])
    return frame.withColumns({c: F.when(_within(c, k), F.col(c)).otherwise(F.lit(k + 1)).cast("short") for c, k in used.items() if c in frame.columns})


def target_stats(reverse: DataFrame) -> DataFrame:
    """target_id and its rev_best_ and rev_second_ columns, which are equal in all its rows."""
    return reverse.groupBy("target_id").agg(*[F.max(c).alias(c) for c in reverse.columns if c.startswith(("rev_best_", "rev_second_"))])


def merge_candidates(config: dict, forward: DataFrame, reverse: DataFrame | None = None, embedding: DataFrame | None = None) -> DataFrame:
    plain = [] if reverse is None else [reverse.drop(*[c for c in reverse.columns if c.startswith(("rev_best_", "rev_second_"))])]
    frames = [forward, *plain, *([] if embedding is None else [embedding])]
    out = censor(select_pairs(combine(*frames), config), config)
    return out if reverse is None else out.join(target_stats(reverse), "target_id", "left")


def fixed_names(frame: DataFrame) -> DataFrame:
    """The combined pass under the name c1 whatever its weight, with the gap to the target's best and its margin."""
    for kind in ("rank", "score", "rev_rank", "rev_score", "rev_best", "rev_second"):
        frame = frame.withColumnsRenamed({c: f"{kind}_c1" for c in frame.columns if c.startswith(f"{kind}_combined_")})
    have = set(frame.columns)
    if {"rev_best_c1", "rev_score_c1"} <= have:
        frame = frame.withColumn("rev_gap_c1", F.col("rev_best_c1") - F.col("rev_score_c1"))
    if {"rev_best_c1", "rev_second_c1"} <= have:
        frame = frame.withColumn("rev_margin_c1", F.col("rev_best_c1") - F.col("rev_second_c1"))
    return frame


def id_lists(entities: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Each entity once, with its targets sorted and joined by commas; empty without any."""
    lists = pairs.groupBy("source1_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias(name))
    return entities.select(F.col("entity_id").alias("source1_id")).join(lists, "source1_id", "left").select(F.col("source1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))

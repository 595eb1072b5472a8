"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import forget, salted_join, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long, not null): root is the smallest node of its component.

    Each round is two grouped minima and joins back. The neighbours of a hub, which the root of a large component becomes,
    are dealt over many tasks, so that no component meets in one. A round's edges are a written table, and the previous
    one's is deleted. Self-loops and repeated edges do not matter. No edges: no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(pairs, "edges")
    before = _mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "lowest")
        large = salted_join(both, lowest.select("a", F.least("a", "m").alias("m")), "a", lowest).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large, "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        small = salted_join(large, low.select("a", "m"), "a", low).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        for done in (now, lowest, large, low):
            forget(done)
        now, mark = after, _mark(after)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

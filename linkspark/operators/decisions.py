"""From pair scores to matches, and their exact metric: macro F0.5 over Source 1 entities, singletons included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The grids of both thresholds, (owner rule, threshold, threshold of an entity's best pair).
GRID = [(owner, t / 20, round(max(t / 20 - drop, 0.05), 2)) for owner in (False, True) for t in range(4, 19) for drop in (0.0, 0.1, 0.2, 0.3)]
OOF_GRID = [(owner, t / 20, round(max(t / 20 - drop, 0.05), 2)) for owner in (False, True) for t in range(8, 19) for drop in (0.0, 0.1, 0.2)]


def owned(scores: DataFrame) -> DataFrame:
    """Every target keeps its best-scoring entities, all of them if tied."""
    best = F.max("score").over(Window.partitionBy("target_id"))
    return scores.withColumn("_best", best).where(F.col("score") == F.col("_best")).drop("_best")


def decide(scores: DataFrame, threshold: float, top_threshold: float | None = None, one_owner: bool = True) -> DataFrame:
    """Pairs that reach the threshold; an entity's best remaining pair needs the other one alone."""
    frame = owned(scores) if one_owner else scores
    best = F.col("score") == F.max("score").over(Window.partitionBy("source1_id"))
    top = threshold if top_threshold is None else top_threshold
    return frame.withColumn("_top", best).where((F.col("score") >= threshold) | (F.col("_top") & (F.col("score") >= top))).drop("_top")


def f05(n: Column, t: Column, hits: Column) -> Column:
    """Of an entity with n predicted links, t true ones and hits in common."""
    p, r = hits / n, hits / t
    return F.when(t == 0, (n == 0).cast("double")).when(hits == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_counts(entities: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """source1_id, n, t, hits of each of ``entities`` (source1_id): a row even without any link."""
    pair = ["source1_id", "target_id"]
    marked = truth.select(*pair).distinct().withColumn("t", F.lit(1)).join(predicted.select(*pair).distinct().withColumn("n", F.lit(1)), pair, "full")
    sums = marked.groupBy("source1_id").agg(F.count("n").alias("n"), F.count("t").alias("t"), F.count(F.col("n") + F.col("t")).alias("hits"))
    return entities.select("source1_id").distinct().join(sums, "source1_id", "left").fillna(0, ["n", "t", "hits"])


def score_report(entities: DataFrame, truth: DataFrame, predicted: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row of eight metrics. ``rows`` (source1_id): entities that have a prediction row, possibly without links."""
    counts = entity_counts(entities, truth, predicted)
    there = (rows if rows is not None else predicted).select("source1_id").distinct().withColumn("there", F.lit(True))
    scored = counts.join(there, "source1_id", "left").withColumn("f", f05(F.col("n"), F.col("t"), F.col("hits")))
    none = F.col("t") == 0
    return scored.agg(
        F.round(F.avg("f"), 6).alias("macro_f05"),
        F.count("*").alias("entities"),
        F.count_if(none).alias("singletons"),
        F.round(F.avg(F.when(none, F.col("f"))), 6).alias("singleton_f05"),
        F.round(F.avg(F.when(~none, F.col("f"))), 6).alias("non_singleton_f05"),
        F.round(F.try_divide(F.sum("hits"), F.sum("n")), 6).alias("link_precision"),
        F.round(F.try_divide(F.sum("hits"), F.sum("t")), 6).alias("link_recall"),
        F.count_if(F.col("there").isNull()).alias("missing_prediction_rows"),
    )


def grid_search(scores: DataFrame, entities: DataFrame, truth: DataFrame, grid: list[tuple[bool, float, float]] = GRID) -> DataFrame:
    """one_owner, threshold, top_threshold, macro_f05 of every setting, in one pass over the scores.

    An entity's pairs are counted once for each owner rule and distinct threshold, with its best pairs apart. A setting
    takes what reaches its threshold, or the best pairs alone if only they reach their own; settings are rows after that, so
    that nothing grows with their number but a few numbers an entity. Entities without pairs enter by numbers alone.
    """
    pair = ["source1_id", "target_id"]
    steps = sorted({t for _, t, _ in grid})
    own = F.col("score") == F.max("score").over(Window.partitionBy("target_id"))
    ids = entities.select("source1_id").distinct()
    true = truth.select(*pair).distinct()
    known = scores.withColumn("own", own).join(ids, "source1_id", "left_semi").join(true.withColumn("hit", F.lit(1)), pair, "left")
    rules = F.when(F.col("own"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    each = known.select("source1_id", "score", F.coalesce("hit", F.lit(0)).alias("hit"), F.explode(rules).alias("one_owner"))
    best = each.withColumn("best", F.max("score").over(Window.partitionBy("source1_id", "one_owner")))
    top = F.col("score") == F.col("best")
    reach = [(F.count_if(F.col("score") >= t).cast("int"), F.sum(F.when(F.col("score") >= t, F.col("hit")).otherwise(0)).cast("int")) for t in steps]
    counts = best.groupBy("source1_id", "one_owner").agg(
        F.first("best").alias("best"),
        F.array(*[n for n, _ in reach], F.count_if(top).cast("int")).alias("n"),
        F.array(*[h for _, h in reach], F.sum(F.when(top, F.col("hit")).otherwise(0)).cast("int")).alias("h"),
    )
    links = true.groupBy("source1_id").agg(F.count("*").alias("t"))
    every = ids.join(links, "source1_id", "left").select("source1_id", F.coalesce("t", F.lit(0)).alias("t"), F.explode(F.array(F.lit(False), F.lit(True))).alias("one_owner"))
    settings = {
        o: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold"), F.lit(x).alias("top_threshold"), F.lit(steps.index(t)).alias("at")) for i, (owner, t, x) in enumerate(grid) if owner == o])
        for o in {o for o, _, _ in grid}
    }
    asked = F.when(F.col("one_owner"), settings[True]).otherwise(settings[False]) if len(settings) == 2 else next(iter(settings.values()))
    rows = every.where(F.col("one_owner").isin(list(settings))).join(counts, ["source1_id", "one_owner"], "left")
    rows = rows.select("one_owner", "t", "best", "n", "h", F.explode(asked).alias("g"))
    # the place in the arrays of what a setting takes: its threshold's, the best pairs' (the last), or nothing
    place = F.when(F.col("best") >= F.col("g.threshold"), F.col("g.at")).when(F.col("best") >= F.col("g.top_threshold"), F.lit(len(steps)))
    taken = rows.select("one_owner", "g.i", "g.threshold", "g.top_threshold", "t", *[F.coalesce(F.get(c, place), F.lit(0)).alias(c) for c in "nh"])
    means = taken.groupBy("i", "one_owner", "threshold", "top_threshold").agg(F.round(F.avg(f05(F.col("n"), F.col("t"), F.col("h"))), 6).alias("macro_f05"))
    return means.drop("i")


def best_settings(grid: DataFrame, n: int = 10) -> DataFrame:
    return grid.orderBy(F.desc("macro_f05"), "one_owner", "threshold", "top_threshold").limit(n)


def candidate_report(entities: DataFrame, truth: DataFrame, candidates: DataFrame, slices: list[str] = ()) -> DataFrame:
    """Recall of true links, ceiling F0.5 and sizes by nearest rank, for all and for each value of a slice column.

    One grouping pass: slices are columns of ``entities``; the ceiling is that of a perfect choice among candidates.
    """
    counts = entities.join(entity_counts(entities, truth, candidates), "source1_id")
    perfect = f05(F.col("hits"), F.col("t"), F.col("hits"))
    keys = F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), *[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices])
    long = counts.withColumn("c", perfect).select("n", "t", "hits", "c", F.explode(keys).alias("k"))

    # nearest rank without gathering sizes: count them, then take running sums of the few distinct ones
    sizes = long.groupBy("k", "n").agg(F.count("*").alias("many"), F.sum("t").alias("t"), F.sum("hits").alias("hits"), F.sum("c").alias("c"))
    w = Window.partitionBy("k")
    up = sizes.withColumns({"upto": F.sum("many").over(w.orderBy("n")), "all": F.sum("many").over(w)})

    def nearest(share: float) -> Column:
        place = F.least(F.col("all") - 1, F.floor(F.col("all") * share)) + 1
        return F.min(F.when(F.col("upto") >= place, F.col("n")))

    return up.groupBy("k").agg(
        F.sum("many").alias("entities"), F.round(F.try_divide(F.sum("hits"), F.sum("t")), 6).alias("recall"), F.round(F.sum("c") / F.sum("many"), 6).alias("ceiling_f05"), F.round(F.sum(F.col("n") * F.col("many")) / F.sum("many"), 6).alias("mean_size"),
        nearest(0.5).alias("median_size"), nearest(0.9).alias("p90_size"), nearest(0.99).alias("p99_size"), F.max("n").alias("max_size"), F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("many"))), F.lit(0)).alias("empty"),
    ).select("k.*", "entities", "recall", "ceiling_f05", "mean_size", "median_size", "p90_size", "p99_size", "max_size", "empty")

"""Where links are lost, how score distributions shift, and what the data look like."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions import similarity as sm
from linkspark.functions import text as tx
from linkspark.functions.hashing import is_validation
from linkspark.operators.decisions import decide, entity_counts, f05

# The edges of the score histogram.
EDGES = [0.0, 0.3, 0.5, 0.75, 0.9, 1.0001]
PAIR = ["source1_id", "target_id"]


def link_status(scores: DataFrame, truth: DataFrame, decided: DataFrame) -> DataFrame:
    """source1_id, target_id, status: tp, rejected (a candidate, not chosen), not_candidate, or false_positive."""
    chosen = decided.select(*PAIR).distinct().withColumn("chosen", F.lit(True))
    scored = scores.select(*PAIR).distinct().withColumn("scored", F.lit(True))
    true = truth.select(*PAIR).distinct().join(scored, PAIR, "left").join(chosen, PAIR, "left")
    status = F.when(F.col("chosen"), "tp").when(F.col("scored"), "rejected").otherwise("not_candidate")
    wrong = chosen.join(truth.select(*PAIR), PAIR, "left_anti").select(*PAIR, F.lit("false_positive").alias("status"))
    return true.select(*PAIR, status.alias("status")).unionByName(wrong)


def loss_report(scores: DataFrame, truth: DataFrame, entities: DataFrame, target_names: DataFrame, threshold: float, top: float | None = None) -> DataFrame:
    """country, source, non_ascii, tp, rejected, not_candidate, false_positive. entities: source1_id, country; target_names: target_id, name."""
    known = scores.join(entities.select("source1_id"), "source1_id", "left_semi")
    status = link_status(known, truth, decide(known, threshold, top))
    sliced = status.join(entities.select("source1_id", "country"), "source1_id").join(target_names, "target_id", "left")
    sliced = sliced.select("country", F.substring("target_id", 1, 2).alias("source"), F.coalesce(~tx.is_ascii(F.col("name")), F.lit(False)).alias("non_ascii"), "status")
    return sliced.groupBy("country", "source", "non_ascii").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("tp", "rejected", "not_candidate", "false_positive")])


def loss_by_country(entities: DataFrame, truth: DataFrame, decided: DataFrame) -> DataFrame:
    """country, entities, singletons, mean_f05, loss and singleton_loss (sums of 1 - F0.5), and what share of the macro score
    either takes, in points of a hundred."""
    counts = entity_counts(entities, truth, decided).join(entities.select("source1_id", "country"), "source1_id")
    lost = counts.withColumn("lost", 1 - f05(F.col("n"), F.col("t"), F.col("hits")))
    none = F.col("t") == 0
    by = lost.groupBy("country").agg(
        F.count("*").alias("entities"), F.count_if(none).alias("singletons"), F.sum("lost").alias("sum"), F.sum(F.when(none, F.col("lost")).otherwise(0.0)).alias("of_singletons")
    )
    total = by.agg(F.sum("entities").alias("total"))
    return by.crossJoin(F.broadcast(total)).select(
        "country",
        "entities",
        "singletons",
        F.round(1 - F.col("sum") / F.col("entities"), 6).alias("mean_f05"),
        F.round("sum", 6).alias("loss"),
        F.round("of_singletons", 6).alias("singleton_loss"),
        F.round(100 * F.col("sum") / F.col("total"), 6).alias("share_points"),
        F.round(100 * F.col("of_singletons") / F.col("total"), 6).alias("singleton_share_points"),
    )


def top_score_histogram(entities: DataFrame, scores: DataFrame) -> DataFrame:
    """bin_low, bin_high, entities: entities by their best score; one without scores counts as 0."""
    best = entities.select("source1_id").distinct().join(scores.groupBy("source1_id").agg(F.max("score").alias("s")), "source1_id", "left").select(F.coalesce("s", F.lit(0.0)).alias("s"))
    bins = F.array(*[F.struct(F.lit(a).alias("bin_low"), F.lit(b).alias("bin_high")) for a, b in zip(EDGES, EDGES[1:], strict=False)])
    place = F.filter(bins, lambda x: (F.col("s") >= x["bin_low"]) & (F.col("s") < x["bin_high"]))[0]
    counted = best.groupBy(place.alias("b")).agg(F.count("*").alias("n"))
    every = entities.sparkSession.range(1).select(F.explode(bins).alias("b"))
    return every.join(counted, "b", "left").select("b.*", F.coalesce("n", F.lit(0)).alias("entities"))


def contested_targets(scores: DataFrame, floor: float = 0.5) -> DataFrame:
    """targets, contested, share: targets that several entities want with a score of ``floor`` or more."""
    owners = scores.where(F.col("score") >= floor).groupBy("target_id").agg(F.count_distinct("source1_id").alias("owners"))
    return owners.agg(F.count("*").alias("targets"), F.count_if(F.col("owners") > 1).alias("contested"), F.round(F.avg((F.col("owners") > 1).cast("double")), 6).alias("share"))


def shift_report(sets: dict[str, tuple[DataFrame, DataFrame]], threshold: float, top: float | None = None, floor: float = 0.0) -> DataFrame:
    """A row per set of (entities with country, scores) and country: entities, shares of their best scores in the bins of
    EDGES (one without scores counts as 0), links per entity, share of empty lists, targets wanted with 0.5 or more, and the
    share of those that several entities want. Scores below ``floor`` are left out, as sets may have different floors.

    All sets go through one plan: the set and the country are keys beside the entity and the target.
    """
    tagged = [(e.select(F.lit(name).alias("set"), "country", "source1_id").distinct(), s.select(F.lit(name).alias("set"), *PAIR, "score")) for name, (e, s) in sets.items()]
    entities, scores = (reduce(DataFrame.unionByName, side) for side in zip(*tagged, strict=True))
    own = scores.where(F.col("score") >= floor).join(entities, ["set", "source1_id"])
    by = ["set", "country"]
    mine = F.col("score") == F.max("score").over(Window.partitionBy(*by, "target_id"))
    owned_ = own.withColumn("owned", mine).where("owned")
    best = F.col("score") == F.max("score").over(Window.partitionBy(*by, "source1_id"))
    chosen = owned_.withColumn("best", best).where((F.col("score") >= threshold) | (F.col("best") & (F.col("score") >= (threshold if top is None else top))))
    links = chosen.groupBy(*by, "source1_id").agg(F.count("*").alias("links"))
    top1 = own.groupBy(*by, "source1_id").agg(F.max("score").alias("s"))
    each = entities.join(links, [*by, "source1_id"], "left").join(top1, [*by, "source1_id"], "left").fillna(0, ["links", "s"])
    shares = [F.round(F.avg(F.when((F.col("s") >= a) & (F.col("s") < b), 1.0).otherwise(0.0)), 6).alias(f"top_{round(100 * a):03d}") for a, b in zip(EDGES, EDGES[1:], strict=False)]
    per_entity = each.groupBy(*by).agg(F.count("*").alias("entities"), *shares, F.round(F.avg("links"), 6).alias("links_per_entity"), F.round(F.avg((F.col("links") == 0).cast("double")), 6).alias("empty_share"))
    owners = own.where(F.col("score") >= 0.5).groupBy(*by, "target_id").agg(F.count_distinct("source1_id").alias("owners"))
    per_target = owners.groupBy(*by).agg(F.count("*").alias("strong_targets"), F.round(F.avg((F.col("owners") > 1).cast("double")), 6).alias("contested_share"))
    return per_entity.join(per_target, by, "left").fillna(0, ["strong_targets"])


def shift_sets(validation: tuple[DataFrame, DataFrame], test: tuple[DataFrame, DataFrame]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """The three sets of a shift report: validation, the tenth of the test set that the same hash picks, so that as many
    compete for a target, and the whole test set."""
    entities, scores = test
    return {"val": validation, "test_10pct": (entities.where(is_validation(F.col("source1_id"))), scores), "test_all": test}


# ---- profiles


def topology(truth: DataFrame, entities: DataFrame) -> DataFrame:
    """Degrees of entities, sources among links, and targets with several parents."""
    degrees = entities.select("source1_id").distinct().join(truth.groupBy("source1_id").agg(F.count("*").alias("d")), "source1_id", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    linked = F.when(F.col("d") > 0, F.col("d"))
    parents = truth.groupBy("target_id").agg(F.count("*").alias("p"))
    a = degrees.agg(F.count("*").alias("entities"), F.count_if(F.col("d") == 0).alias("singletons"), F.round(F.avg(linked), 6).alias("mean_links"), F.percentile(linked, F.lit(0.5)).alias("median_links"), F.percentile(linked, F.lit(0.95)).alias("p95_links"), F.max("d").alias("max_links"), F.round(F.stddev_pop(linked), 6).alias("std_links"))
    b = parents.agg(F.count("*").alias("targets"), F.count_if(F.col("p") > 1).alias("multi_parent"))
    c = truth.agg(F.count_if(F.col("target_id").startswith("S2")).alias("links_s2"), F.count_if(F.col("target_id").startswith("S3")).alias("links_s3"))
    return a.join(b).join(c)


def completeness(records: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, empty, blank (white space alone), mean characters and words."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("")).alias("v")) for c in columns])
    v = F.col("v")
    words = F.size(F.filter(F.split(v, r"\s+"), lambda w: w != ""))
    return records.select(F.explode(cells).alias("c")).select("c.*").groupBy("column").agg(F.count("*").alias("rows"), F.count_if(v == "").alias("empty"), F.count_if((v != "") & v.rlike(r"^\s+$")).alias("blank"), F.round(F.avg(F.length(v)), 6).alias("mean_chars"), F.round(F.avg(words), 6).alias("mean_words"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """value, n, percent."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(100 * F.col("n") / F.col("all"), 6).alias("percent"))


def cross_country(truth: DataFrame, source1: DataFrame, targets: DataFrame) -> DataFrame:
    """links, violations: links whose ends differ in country."""
    a, b = source1.select(F.col("entity_id").alias("source1_id"), F.col("country").alias("x")), targets.select(F.col("entity_id").alias("target_id"), F.col("country").alias("y"))
    return truth.join(a, "source1_id").join(b, "target_id").agg(F.count("*").alias("links"), F.count_if(F.col("x") != F.col("y")).alias("violations"))


def reservoir(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A uniform sample of ``n`` rows by a keyed hash of ``key``: the same in every run and however rows are dealt. Each task
    keeps its own ``n`` least before they meet."""
    return rows.orderBy(F.md5(F.concat(F.col(key), F.lit(f":{seed}")).cast("binary")), key).limit(n)


def postal_confidence(records: DataFrame) -> DataFrame:
    """country, method (keyword, pattern, none), n, share: how the postal codes of a country's addresses were found."""
    own = records.select("country", tx.postal(F.col("business_address"), F.col("country"))["method"].alias("method"))
    counts = own.groupBy("country", "method").agg(F.count("*").alias("n"))
    total = counts.groupBy("country").agg(F.sum("n").alias("all"))
    return counts.join(total, "country").select("country", "method", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def pair_counts(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (name_a, address_a, country_a, name_b, address_b, country_b) by distinct names, and by distinct addresses and
    countries, with how many pairs have them as n."""
    return tuple(pairs.groupBy(*[f"{c}_{s}" for s in "ab" for c in own]).agg(F.count("*").alias("n")) for own in (["name"], ["address", "country"]))


def _profile_values(names: DataFrame, addresses: DataFrame) -> list[tuple[DataFrame, dict[str, Column]]]:
    """Normal texts of true pairs, and the match flags and similarities as expressions over them: of names, of addresses."""
    col = F.col
    own = names.select("n", *[tx.normalize_plain(col(f"name_{s}")).alias(f"n{s}") for s in "ab"])
    of_name = {
        "first3_match": F.substring("na", 1, 3) == F.substring("nb", 1, 3), "firstword_match": F.split("na", " ")[0] == F.split("nb", " ")[0], "soundex_match": tx.soundex_simple(col("na"), "0000") == tx.soundex_simple(col("nb"), "0000"),
        "name_levenshtein": sm.levenshtein_ratio(col("na"), col("nb")), "name_jaccard": sm.jaccard(tx.words(col("na")), tx.words(col("nb"))), "name_grams": sm.jaccard(tx.gram_set(col("na")), tx.gram_set(col("nb"))),
    }
    texts = addresses.select("n", *[tx.normalize_plain(col(f"address_{s}")).alias(f"a{s}") for s in "ab"], *[tx.postal(col(f"address_{s}"), col(f"country_{s}"))["code"].alias(f"p{s}") for s in "ab"])
    of_address = {
        "postal_match": (col("pa") != "") & (col("pa") == col("pb")),
        "address_levenshtein": sm.levenshtein_ratio(col("aa"), col("ab")), "address_jaccard": sm.jaccard(tx.words(col("aa")), tx.words(col("ab"))), "address_grams": sm.jaccard(tx.gram_set(col("aa")), tx.gram_set(col("ab"))),
    }
    return [(own, of_name), (texts, of_address)]


def _weighted_mean(v: Column) -> Column:
    """Of ``v`` by n, without nulls."""
    return F.sum(v * F.col("n")) / F.sum(F.when(v.isNotNull(), F.col("n")))


#: In this order.
PROFILE = ["first3_match", "firstword_match", "soundex_match", "postal_match", *[f"{f}_{m}" for f in ("name", "address") for m in ("levenshtein", "jaccard", "grams")]]


def noise_profile(names: DataFrame, addresses: DataFrame) -> DataFrame:
    """Match rates and mean similarities of true pairs, from their ``pair_counts``: every text is compared once."""
    (own, by_name), (texts, by_address) = _profile_values(names, addresses)
    a = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), *[F.round(_weighted_mean(v.cast("double")), 6).alias(k) for k, v in by_name.items()])
    b = texts.agg(*[F.round(_weighted_mean(v.cast("double")), 6).alias(k) for k, v in by_address.items()])
    return a.join(b).select("pairs", *PROFILE)


def noise_distribution(names: DataFrame, addresses: DataFrame, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """measure, mean, std (of the population), q05, q25, q50, q75, q95 of each similarity of true pairs, from their
    ``pair_counts``."""
    parts = []
    for own, values in _profile_values(names, addresses):
        kinds = [k for k in values if not k.endswith("_match")]
        rows = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), values[k].cast("double").alias("v")) for k in kinds]))
        parts.append(own.select("n", rows.alias("x")).groupBy("x.measure", "x.v").agg(F.sum("n").alias("n")))
    long, v = parts[0].unionByName(parts[1]), F.col("v")
    quantiles = [F.round(F.percentile("v", F.lit(q), F.col("n")), 6).alias(f"q{round(100 * q):02d}") for q in shares]
    means = long.groupBy("measure").agg(_weighted_mean(v).alias("mean"), *quantiles)
    # deviations from the mean itself: a difference of large sums would lose digits
    std = long.join(means.select("measure", "mean"), "measure").groupBy("measure").agg(F.round(F.sqrt(_weighted_mean((v - F.col("mean")) ** 2)), 6).alias("std"))
    return means.join(std, "measure").select("measure", F.round("mean", 6).alias("mean"), "std", *[f"q{round(100 * q):02d}" for q in shares])


def blocking_simulation(truth: DataFrame, keys: DataFrame) -> DataFrame:
    """kind, recall, marginal (links that no other kind finds), union: of ``keys`` (entity_id, kind, country, key)."""
    kinds = ["first3", "firstword", "soundex", "postal"]
    a = truth.select(*PAIR).distinct().join(keys.withColumnRenamed("entity_id", "source1_id"), "source1_id")
    b = keys.withColumnRenamed("entity_id", "target_id")
    found = a.join(b, ["target_id", "kind", "country", "key"]).groupBy(*PAIR).agg(F.collect_set("kind").alias("by"))
    every = truth.select(*PAIR).distinct().join(found, PAIR, "left").select(F.coalesce("by", F.array().cast("array<string>")).alias("by"))

    def share(c: Column) -> Column:
        return F.round(F.avg(c.cast("double")), 6)

    rows = F.array(*[F.struct(F.lit(k).alias("kind"), share(F.array_contains("by", k)).alias("recall"), share(F.array_contains("by", k) & (F.size("by") == 1)).alias("marginal"), share(F.size("by") > 0).alias("union")) for k in kinds])
    return every.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def rank_features(pairs: DataFrame, columns: list[str], ratio_columns: list[str] = (), strong: str | None = None) -> DataFrame:
    """Of each pair in its entity: rank by a column (ties by target), gap to the best, ratio to a positive best; the same
    inside (entity, source); group size, and how many have ``strong`` at 90 or more."""
    w, s = Window.partitionBy("source1_id"), Window.partitionBy("source1_id", F.substring("target_id", 1, 2))
    out = {}
    for c in columns:
        out |= {f"{c}_rank": F.row_number().over(w.orderBy(F.desc(c), "target_id")), f"{c}_gap_to_best": F.max(c).over(w) - F.col(c)}
        out |= {f"{c}_source_rank": F.row_number().over(s.orderBy(F.desc(c), "target_id")), f"{c}_source_gap_to_best": F.max(c).over(s) - F.col(c)}
    out |= {f"{c}_ratio_to_best": F.when(F.max(c).over(w) > 0, F.col(c) / F.max(c).over(w)) for c in ratio_columns}
    out["group_size"] = F.count("*").over(w)
    if strong:
        out["group_strong_names"] = F.count_if(F.col(strong) >= 90).over(w)
    return pairs.withColumns(out)

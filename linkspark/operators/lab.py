"""The blocking laboratory: configurations are compared on labelled pairs, by paired bootstrap, and missed links explained."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions import text as tx
from linkspark.functions.hashing import lab_set
from linkspark.operators.blocking import exact_cosines
from linkspark.operators.candidates import FAR, active, censor, combine, id_lists, is_rank, select_pairs
from linkspark.operators.decisions import entity_counts, f05
from linkspark.sources.tsv import write_tsv

PAIR = ["source1_id", "target_id"]
# Depths and weights that are tried, and the resamples of the bootstrap.
FORWARD, REVERSE, EMBEDDING = (0, 10, 20, 30, 50, 100), (0, 1, 3, 5, 10), (0, 5, 10)
WEIGHTS = (0.4, 0.5, 0.6, 0.7)
RESAMPLES = 200


def lab_entities(source1: DataFrame) -> DataFrame:
    """source1_id, lab_set, country of the entities of a lab set."""
    return source1.select(F.col("entity_id").alias("source1_id"), lab_set(F.col("entity_id")).alias("lab_set"), "country").where("lab_set IS NOT NULL")


def labelled_pairs(entities: DataFrame, truth: DataFrame, *frames: DataFrame) -> DataFrame:
    """The combined pass outputs of the lab entities, with is_true."""
    ids = entities.select("source1_id")
    plain = [f.drop(*[c for c in f.columns if c.startswith(("rev_best_", "rev_second_"))]).join(ids, "source1_id", "left_semi") for f in frames]
    marked = truth.select(*PAIR).distinct().withColumn("is_true", F.lit(True))
    return combine(*plain).join(marked, PAIR, "left").fillna(False, ["is_true"])


def entity_ceilings(entities: DataFrame, truth: DataFrame, pairs: DataFrame, config: dict) -> DataFrame:
    """source1_id, n candidates, t links, r links found, ceiling F0.5 under a configuration."""
    kept = select_pairs(pairs, config).groupBy("source1_id").agg(F.count("*").alias("n"), F.count_if("is_true").alias("r"))
    links = truth.groupBy("source1_id").agg(F.count_distinct("target_id").alias("t"))
    counts = entities.select("source1_id").join(kept, "source1_id", "left").join(links, "source1_id", "left").fillna(0, ["n", "r", "t"])
    return counts.withColumn("ceiling", f05(F.col("r"), F.col("t"), F.col("r")))


def configuration_report(entities: DataFrame, truth: DataFrame, pairs: DataFrame, configs: dict[str, dict]) -> DataFrame:
    """config, mean_candidates, recall, ceiling of each configuration."""
    out = None
    for name, config in configs.items():
        one = entity_ceilings(entities, truth, pairs, config).agg(F.round(F.avg("n"), 6).alias("mean_candidates"), F.round(F.try_divide(F.sum("r"), F.sum("t")), 6).alias("recall"), F.round(F.avg("ceiling"), 6).alias("ceiling")).select(F.lit(name).alias("config"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def bootstrap_se(differences: np.ndarray, resamples: int = RESAMPLES, seed: int = 0) -> float:
    """Standard error of a mean of paired differences of one value per lab entity."""
    rng = np.random.default_rng(seed)
    return float(np.std([differences[rng.integers(0, len(differences), len(differences))].mean() for _ in range(resamples)])) if len(differences) else 0.0


def paired_difference(a: DataFrame, b: DataFrame, column: str = "ceiling") -> tuple[float, float]:
    """Mean of b - a over the entities of both, and its standard error. A lab set's entities are few by design."""
    both = a.select("source1_id", F.col(column).alias("x")).join(b.select("source1_id", F.col(column).alias("y")), "source1_id").orderBy("source1_id").select((F.col("y") - F.col("x")).alias("d")).toArrow()
    d = np.array(both["d"])
    return float(d.mean()) if len(d) else 0.0, bootstrap_se(d)


def greedy_configuration(entities: DataFrame, truth: DataFrame, pairs: DataFrame, budget: float, start: dict | None = None, limit: int = 8) -> list[tuple[dict, float, float]]:
    """Add the depth with the best gain of ceiling per candidate while it exceeds two standard errors and the mean number
    of candidates stays within the budget. Steps as (config, ceiling, mean candidates)."""
    pairs, columns = pairs.cache(), [c for c in pairs.columns if is_rank(c)]
    depths = {c: FORWARD if c.startswith("rank_") else EMBEDDING if c.startswith("emb") else REVERSE for c in columns}

    def measured(config: dict):
        own = entity_ceilings(entities, truth, pairs, config).cache()
        row = own.agg(F.avg("ceiling"), F.avg("n")).first()
        return own, row[0] or 0.0, row[1] or 0.0

    config = dict(start or {})
    now = measured(config) if active(config) else (entity_ceilings(entities, truth, pairs.limit(0), {columns[0]: 1}).cache(), 0.0, 0.0)
    steps = []
    for _ in range(limit):
        found = []
        for c in columns:
            for k in [d for d in depths[c] if d > config.get(c, 0)][:1]:
                trial = measured(config | {c: k})
                if trial[2] <= budget and trial[1] > now[1]:
                    found.append(((trial[1] - now[1]) / max(trial[2] - now[2], 1e-9), c, k, trial))
        found.sort(key=lambda x: (-x[0], x[1]))
        for _, c, k, trial in found:
            gain, se = paired_difference(now[0], trial[0])
            if gain > 2 * se:
                config, now = config | {c: k}, trial
                steps.append((dict(config), now[1], now[2]))
                break
        else:
            break
    pairs.unpersist()
    return steps


def choose_weight(entities: DataFrame, truth: DataFrame, pairs: DataFrame, depth: int = 20) -> DataFrame:
    """The ceiling with each weight of the combined pass at a fixed depth, best first."""
    configs = {f"{w:.1f}": {"rank_name": depth, "rank_address": depth, f"rank_combined_{round(100 * w):03d}": depth} for w in WEIGHTS if f"rank_combined_{round(100 * w):03d}" in pairs.columns}
    return configuration_report(entities, truth, pairs, configs).orderBy(F.desc("ceiling"), "config")


def slice_recall(links: DataFrame, found: DataFrame, slices: list[str]) -> DataFrame:
    """slice, value, links, recall of true ``links`` (with slice columns) that are among ``found`` pairs."""
    marked = links.join(found.select(*PAIR).distinct().withColumn("found", F.lit(1.0)), PAIR, "left").fillna(0.0, ["found"])
    keys = F.array(*[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices])
    return marked.select(F.explode(keys).alias("k"), "found").groupBy("k").agg(F.count("*").alias("links"), F.round(F.avg("found"), 6).alias("recall")).select("k.*", "links", "recall")


SLICES = ["country", "source", "script", "empty_address", "alias"]


def link_slices(truth: DataFrame, entities: DataFrame, targets: DataFrame) -> DataFrame:
    """source1_id, target_id and SLICES of each true link: the entity's country; the target's source, script (nonlatin,
    accented or latin), whether its address is empty and its name has an alias marker. A target without a record is latin,
    without an address."""
    name = F.coalesce("business_name", F.lit(""))
    script = F.when(tx.is_nonlatin(name), "nonlatin").when(tx.is_accented(name), "accented").otherwise("latin")
    records = targets.select(F.col("entity_id").alias("target_id"), "business_name", "business_address")
    own = truth.select(*PAIR).distinct().join(entities.select("source1_id", "country"), "source1_id").join(records, "target_id", "left")
    return own.select(
        *PAIR,
        "country",
        F.substring("target_id", 1, 2).alias("source"),
        script.alias("script"),
        (F.btrim(F.coalesce("business_address", F.lit(""))) == "").alias("empty_address"),
        tx.has_alias_marker(name).alias("alias"),
    )


def slice_gains(links: DataFrame, base: DataFrame, trial: DataFrame, slices: list[str] = SLICES) -> DataFrame:
    """slice, value, links, recall_base, recall_trial, gain, se: recall of true ``links`` (with slice columns) among two sets
    of pairs. se: of the gain, from the links' own differences."""

    def marked(df: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        return df.join(pairs.select(*PAIR).distinct().withColumn(name, F.lit(1.0)), PAIR, "left").fillna(0.0, [name])

    both = marked(marked(links, base, "base"), trial, "trial")
    keys = F.array(*[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices])
    d = F.col("trial") - F.col("base")
    by = both.select(F.explode(keys).alias("k"), "base", "trial").groupBy("k")
    out = by.agg(F.count("*").alias("links"), F.avg("base").alias("a"), F.avg("trial").alias("b"), F.stddev_pop(d).alias("sd"))
    rounded = [F.round(c, 6).alias(n) for n, c in (("recall_base", F.col("a")), ("recall_trial", F.col("b")), ("gain", F.col("b") - F.col("a")), ("se", F.col("sd") / F.sqrt("links")))]
    return out.select("k.slice", "k.value", "links", *rounded)


def gate(entities: DataFrame, truth: DataFrame, pairs: DataFrame, base: dict, trial: dict) -> dict:
    """Whether ``trial`` may replace ``base``: the ceiling's gain exceeds two standard errors, recall does not fall."""
    a, b = (entity_ceilings(entities, truth, pairs, c) for c in (base, trial))
    gain, se = paired_difference(a, b)
    recall = [x.agg(F.try_divide(F.sum("r"), F.sum("t"))).first()[0] or 0.0 for x in (a, b)]
    return {"gain": gain, "se": se, "recall_base": recall[0], "recall_trial": recall[1], "passed": gain > 2 * se and recall[1] >= recall[0]}


def first_gate(sets: dict[str, DataFrame], truth: DataFrame, pairs: DataFrame, slices: DataFrame, base: dict, trial: dict) -> dict:
    """The whole first gate over lab sets by name (the one that chose the trial first, then the one that confirms it):
    ceiling and recall rise in each, the confirming gain is within two standard errors of the chooser's, and no slice of the
    confirming set loses more recall than two standard errors. ``slices``: true links as ``link_slices`` has them."""
    report: dict = {name: gate(entities, truth, pairs, base, trial) for name, entities in sets.items()}
    dev, confirm = (report[name] for name in list(sets)[:2])
    gap, se = dev["gain"] - confirm["gain"], (dev["se"] ** 2 + confirm["se"] ** 2) ** 0.5
    own = list(sets.values())[1].select("source1_id")
    gains = slice_gains(slices.join(own, "source1_id", "left_semi"), select_pairs(pairs, base), select_pairs(pairs, trial))
    worse = [tuple(r) for r in gains.where(F.col("gain") < -2 * F.col("se")).orderBy("slice", "value").collect()]  # a row per slice at most
    report |= {"dev_confirm_gap": gap, "gap_se": se, "regressed_slices": worse}
    return report | {"passed": dev["passed"] and confirm["passed"] and abs(gap) <= 2 * se + 1e-12 and not worse}


def export_candidates(entities: DataFrame, lab: str, pairs: DataFrame, config: dict, path: str) -> DataFrame:
    """Write the candidates of one lab set under a configuration: the list file, and the censored pairs beside it. Returns
    set, entities, pairs, mean_candidates."""
    members = entities.where(F.col("lab_set") == lab)
    kept = select_pairs(pairs.join(members.select("source1_id"), "source1_id", "left_semi"), config)
    censor(kept, config).write.mode("overwrite").parquet(f"{path}/pairs")
    found = pairs.sparkSession.read.parquet(f"{path}/pairs")
    write_tsv(id_lists(members.select(F.col("source1_id").alias("entity_id")), found, "candidate_entity_ids"), f"{path}/candidates")
    n = found.agg(F.count("*").alias("pairs"))
    size = members.agg(F.count("*").alias("entities"))
    return size.crossJoin(n).select(F.lit(lab).alias("set"), "entities", "pairs", F.round(F.col("pairs") / F.greatest("entities", F.lit(1)), 2).alias("mean_candidates"))


def missed_links(truth: DataFrame, kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """source1_id, target_id, least_rank of true links that were not kept; null where no pass has them at any depth."""
    ranks = [F.coalesce(F.col(c), F.lit(FAR)) for c in pairs.columns if is_rank(c)]
    nearest = pairs.select(*PAIR, F.least(*ranks, F.lit(FAR)).alias("least_rank"))
    return truth.select(*PAIR).join(kept.select(*PAIR), PAIR, "left_anti").join(nearest, PAIR, "left").select(*PAIR, F.when(F.col("least_rank") < FAR, F.col("least_rank")).alias("least_rank"))


def miss_reach(missed: DataFrame) -> DataFrame:
    """links, never, within_20, within_50, within_100: shares of missed links that deeper passes would reach."""
    r = F.col("least_rank")
    return missed.agg(F.count("*").alias("links"), F.round(F.avg(r.isNull().cast("double")), 4).alias("never"), *[F.round(F.avg(F.coalesce(r <= k, F.lit(False)).cast("double")), 4).alias(f"within_{k}") for k in (20, 50, 100)])


def two_hops(missed: DataFrame, pairs: DataFrame, rank: str, depth: int = 3) -> DataFrame:
    """source1_id, target_id, via: the entity's ``depth`` best of the other source, through which a miss may be reached."""
    nth = F.row_number().over(Window.partitionBy("source1_id", F.substring("target_id", 1, 2)).orderBy(rank, "target_id"))
    best = pairs.where(F.col(rank).isNotNull()).withColumn("nth", nth).where(F.col("nth") <= depth).select("source1_id", F.col("target_id").alias("via"))
    return missed.select(*PAIR).join(best, "source1_id").where(F.substring("via", 1, 2) != F.substring("target_id", 1, 2))


def miss_breakdown(missed: DataFrame, slices: DataFrame) -> DataFrame:
    """slice, value, misses: of which slices (see ``link_slices``) the missed links are."""
    keys = F.array(*[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in SLICES])
    return missed.select(*PAIR).join(slices, PAIR).select(F.explode(keys).alias("k")).groupBy("k").agg(F.count("*").alias("misses")).select("k.*", "misses")


def dotted_share(missed: DataFrame, source1: DataFrame, targets: DataFrame) -> DataFrame:
    """links, dotted: the share of missed links in which either name writes an abbreviation with dots."""
    flags = [r.select(F.col("entity_id").alias(i), tx.to_ascii(F.col("business_name")).rlike(tx.DOTTED).alias(n)) for r, i, n in ((source1, "source1_id", "x"), (targets, "target_id", "y"))]
    own = missed.select(*PAIR).join(flags[0], "source1_id", "left").join(flags[1], "target_id", "left")
    either = F.coalesce("x", F.lit(False)) | F.coalesce("y", F.lit(False))
    return own.agg(F.count("*").alias("links"), F.round(F.avg(either.cast("double")), 4).alias("dotted"))


def two_hop_cosines(hops: DataFrame, targets: DataFrame, weight: float = 0.6, index=None) -> DataFrame:
    """misses, q50, q75, q90, ge_50, ge_70, ge_90: of each missed target the best combined cosine with a record through which
    it may be reached (``two_hops``), as quantiles and shares."""
    pairs = hops.select(F.col("target_id").alias("source1_id"), F.col("via").alias("target_id")).distinct()
    cosines = exact_cosines(pairs, targets, targets, weight, index)
    best = cosines.groupBy("source1_id").agg(F.max("cos_c1").alias("c"))
    quantiles = [F.round(F.percentile("c", F.lit(q / 100)), 3).alias(f"q{q}") for q in (50, 75, 90)]
    shares = [F.round(F.avg((F.col("c") >= q / 100).cast("double")), 4).alias(f"ge_{q}") for q in (50, 70, 90)]
    return best.agg(F.count("*").alias("misses"), *quantiles, *shares)


def choose_text_form(entities: DataFrame, truth: DataFrame, forms: dict[str, DataFrame], config: dict) -> str:
    """The form of text whose pairs give the best ceiling: the first, unless another beats it by two standard errors."""
    names = list(forms)
    best, own = names[0], entity_ceilings(entities, truth, forms[names[0]], config)
    for name in names[1:]:
        other = entity_ceilings(entities, truth, forms[name], config)
        gain, se = paired_difference(own, other)
        if gain > 2 * se:
            best, own = name, other
    return best


def entity_scores(entities: DataFrame, truth: DataFrame, decided: DataFrame) -> DataFrame:
    """source1_id, f05 of each entity."""
    counts = entity_counts(entities, truth, decided)
    return counts.select("source1_id", f05(F.col("n"), F.col("t"), F.col("hits")).alias("f05"))


def end_to_end_gate(entities: DataFrame, truth: DataFrame, base: DataFrame, trial: DataFrame) -> dict:
    """Whether the decided matches of a trial beat those of the base in macro F0.5 by two standard errors."""
    gain, se = paired_difference(entity_scores(entities, truth, base), entity_scores(entities, truth, trial), "f05")
    return {"gain": gain, "se": se, "passed": gain > 2 * se}

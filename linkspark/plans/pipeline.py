"""Linking a split from records to match lists: block, merge, features, score, decide, write."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame

from linkspark.operators import blocking as bk, candidates as cd, decisions as dc, features as ft, matcher as mt
from linkspark.sources import tsv


def block(source1: DataFrame, targets: DataFrame, config: dict, reverse: str | None = "name:10", budget: int = 50_000) -> DataFrame:
    """Candidate pairs with their retrieval columns under fixed names."""
    forward = bk.forward_pairs(source1, targets, bk.pass_spec({k: v for k, v in config.items() if isinstance(v, int)}), budget)
    back = bk.reverse_pairs(source1, targets, reverse, budget) if reverse else None
    return cd.fixed_names(cd.merge_candidates(config, forward, back))


def train(source1: DataFrame, targets: DataFrame, truth: DataFrame, config: dict, **options) -> tuple[list[GBTClassificationModel], tuple[bool, float, float]]:
    """The fold models, and the decision setting that is best on out-of-fold scores outside validation."""
    from pyspark.sql import functions as F

    from linkspark.functions.hashing import is_validation

    pair = ["source1_id", "target_id"]
    index = bk.built_index(targets, list(bk.VIEWS))
    found = ft.pair_features(block(source1, targets, config), source1, targets, index=index)
    features = found.join(truth.select(*pair).distinct().withColumn("label", F.lit(1)), pair, "left").fillna(0, ["label"]).cache()
    try:
        models = mt.train_folds(features, ft.feature_columns(), **options)
        entities = source1.select(F.col("entity_id").alias("source1_id")).where(~is_validation(F.col("source1_id")))
        scores = mt.score_pairs(features, ft.feature_columns(), models)
        best = dc.best_settings(dc.grid_search(scores, entities, truth, dc.OOF_GRID), 1).first()
    finally:
        features.unpersist()
    return models, (best.one_owner, best.threshold, best.top_threshold)


def link(source1: DataFrame, targets: DataFrame, models: list[GBTClassificationModel], setting: tuple[bool, float, float], config: dict, path: str, floor: float = 0.05) -> None:
    """Write candidates, scores and matches below ``path``; candidates and scores are the two tables that stages share."""
    spark = source1.sparkSession
    block(source1, targets, config).write.mode("overwrite").parquet(f"{path}/candidates")
    found = spark.read.parquet(f"{path}/candidates")
    scores = mt.score_pairs(ft.pair_features(found, source1, targets), ft.feature_columns(), models, out_of_fold=False)
    scores.where(scores.score >= floor).write.mode("overwrite").parquet(f"{path}/scores")
    owner, threshold, top = setting
    matches = dc.decide(spark.read.parquet(f"{path}/scores"), threshold, top, owner)
    tsv.write_tsv(cd.id_lists(source1, found, "candidate_entity_ids"), f"{path}/candidate_pairs")
    tsv.write_tsv(cd.id_lists(source1, matches, "matched_entity_ids"), f"{path}/matching_results")

import pytest
from pyspark.sql import functions as F

from linkspark.operators import blocking as bk, candidates as cd, decisions as dc, diagnostics as dg, lab, matcher as mt, vectors as vc
from linkspark.sources import tsv

RECORD = "entity_id string, business_name string, business_address string, country string"
PAIR = "source1_id string, target_id string"


def pairs(df):
    return {(r.source1_id, r.target_id) for r in df.collect()}


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([("a", "S2-1", 0.9), ("a", "S3-2", 0.6), ("b", "S2-1", 0.7), ("b", "S3-3", 0.4), ("c", "S3-4", 0.2)], f"{PAIR}, score double")


def test_decide(scored):
    assert pairs(dc.decide(scored, 0.5)) == {("a", "S2-1"), ("a", "S3-2")}
    assert ("b", "S2-1") in pairs(dc.decide(scored, 0.5, one_owner=False))
    assert pairs(dc.decide(scored, 0.5, 0.3)) == {("a", "S2-1"), ("a", "S3-2"), ("b", "S3-3")}


def test_tied_owners_all_stay(spark):
    tied = spark.createDataFrame([("a", "t", 0.5), ("b", "t", 0.5)], f"{PAIR}, score double")
    assert len(pairs(dc.decide(tied, 0.5))) == 2


def test_metric(spark):
    rows = spark.createDataFrame([(3, 2, 2), (0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)], "n int, t int, h int")
    got = [round(r[0], 3) for r in rows.select(dc.f05(F.col("n"), F.col("t"), F.col("h"))).collect()]
    assert got == [0.714, 1.0, 0.0, 0.0, 0.0]


def test_report_ignores_unknown_entities(spark):
    entities = spark.createDataFrame([("1",), ("2",)], "source1_id string")
    truth = spark.createDataFrame([("1", "S2-1")], PAIR)
    predicted = spark.createDataFrame([("1", "S2-1"), ("99", "S2-5")], PAIR)
    r = dc.score_report(entities, truth, predicted).first()
    assert (r.macro_f05, r.missing_prediction_rows, r.singletons) == (1.0, 1, 1)


def test_grid_agrees_with_single_settings(spark, scored):
    entities = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "source1_id string")
    truth = spark.createDataFrame([("a", "S2-1"), ("b", "S3-3"), ("c", "S3-9")], PAIR)
    grid = [(True, 0.5, 0.3), (False, 0.5, 0.5), (True, 0.65, 0.65), (False, 0.2, 0.05)]
    got = {(r.one_owner, r.threshold, r.top_threshold): r.macro_f05 for r in dc.grid_search(scored, entities, truth, grid).collect()}
    for owner, t, top in grid:
        assert got[owner, t, top] == dc.score_report(entities, truth, dc.decide(scored, t, top, owner)).first().macro_f05


def test_capped_union_and_censoring(spark):
    rows = [("a", "S2-1", 1, None), ("a", "S2-2", 5, 1), ("a", "S2-3", None, 2), ("a", "S2-4", None, 3), ("a", "S2-5", None, 9)]
    frame = spark.createDataFrame(rows, f"{PAIR}, rank_name short, rev_rank_name short")
    config = {"rank_name": 2, "rev_rank_name": 3}
    kept = cd.select_pairs(frame, config)
    assert pairs(kept) == {("a", "S2-1"), ("a", "S2-2"), ("a", "S2-3")}
    got = {r.target_id: r for r in cd.censor(kept, config).collect()}
    assert got["S2-2"].rank_name == 3 and got["S2-1"].rev_rank_name == 4
    assert (got["S2-1"].found_by, got["S2-2"].found_by, got["S2-2"].n_passes) == (1, 2, 1)


def test_pass_specs():
    config = {"rank_name": 20, "rank_address": 0, "rank_combined_060": 30, "rev_rank_name": 3, "emb_form": "name"}
    assert bk.pass_spec({k: v for k, v in config.items() if isinstance(v, int)}) == "name:20,combined@0.6:30"
    assert bk.parse_passes("combined@0.6:30") == [("combined_060", {"name": 0.6, "address": 0.4}, 30)]
    with pytest.raises(ValueError):
        bk.parse_passes("nothing:3")


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        ("S1-1", "Acme Foods", "12 Main Street", "US"), ("S1-2", "Boulangerie Martin", "5 rue Voltaire", "France"), ("S1-3", "Raj Consultancy", "1 MG Road", "India"),
        ("S2-1", "Acme Food Inc", "12 Main St", "us"), ("S2-2", "Zeta dba Raj Consultancy", "MG Rd 1", "India"), ("S3-1", "राज कंसल्टेंसी", "", "India"), ("S3-2", "Boulangerie Martin SARL", "5 r Voltaire", "France"), ("S3-3", "Acme Foods", "9 Oak Ave", "France"),
    ]
    return spark.createDataFrame(rows, RECORD)


def sides(records):
    return records.where("entity_id LIKE 'S1%'"), records.where("entity_id NOT LIKE 'S1%'")


def test_neighbours_cross_scripts_and_aliases_but_no_country(records):
    found = pairs(bk.forward_pairs(*sides(records), "name:5,address:5,combined@0.6:5"))
    assert {("S1-1", "S2-1"), ("S1-3", "S2-2"), ("S1-3", "S3-1"), ("S1-2", "S3-2")} <= found
    assert ("S1-1", "S3-3") not in found


def test_combined_pass_is_the_weighted_sum(records):
    rows = bk.forward_pairs(*sides(records), "name:9,address:9,combined@0.6:9").collect()
    both = [r for r in rows if None not in (r.score_name, r.score_address, r.score_combined_060)]
    assert both and all(abs(r.score_combined_060 - 0.6 * r.score_name - 0.4 * r.score_address) < 1e-5 for r in both)


def test_reverse_has_best_and_second(records):
    got = {(r.target_id, r.source1_id): r for r in bk.reverse_pairs(*sides(records), "name:3").collect()}
    r = got["S2-1", "S1-1"]
    assert r.rev_rank_name == 1 and abs(r.rev_best_name - r.rev_score_name) < 1e-6


def test_budget_keeps_the_rarest(spark):
    rows = [("q", 0, "v", t, d, 1.0) for t, d in (("a", 1), ("b", 3), ("c", 9))]
    df = spark.createDataFrame(rows, "entity_id string, row int, view string, token string, df long, weight double")
    assert [r.token for r in bk.budgeted(df, 4).orderBy("df").collect()] == ["a", "b"]
    assert [r.token for r in bk.budgeted(df, 0).collect()] == ["a"]


def test_key_blocking(records):
    keys = bk.blocking_keys(records)
    a, b = keys.where("entity_id LIKE 'S1%'"), keys.where("entity_id NOT LIKE 'S1%'")
    found = pairs(bk.key_pairs(a, b))
    assert ("S1-1", "S2-1") in found and ("S1-1", "S3-3") not in found
    lists = {r[0]: r[1] for r in cd.id_lists(sides(records)[0], bk.key_pairs(a, b), "ids").collect()}
    assert set(lists) == {"S1-1", "S1-2", "S1-3"} and lists["S1-2"] == "S3-2"


def test_vector_search(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id int, country int, vector array<double>")
    q, index = df.where("id < 40"), df.where("id >= 40")
    exact = {(r.query_id, r.index_id) for r in vc.vector_neighbours(q, index, 5).collect()}
    for i in range(40):
        own = [j for j in range(40, 300) if j % 2 == i % 2]
        best = sorted(own, key=lambda j: (-round(float(x[i] @ x[j]), 6), j))[:5]
        assert {(i, j) for j in best} <= exact
    near = {(r.query_id, r.index_id) for r in vc.approximate_neighbours(q, index, 5, probes=16, cells=16).collect()}
    assert near == exact


def test_approximate_recall(spark, sf, monkeypatch):
    from linkspark.plans import queries as plans

    q, index = plans._vector_sides(spark, sf)
    exact = {(r.query_id, r.index_id) for r in vc.vector_neighbours(q, index).collect()}
    for most in (1000, 200):  # all queries measured, and some
        monkeypatch.setattr(vc, "MEASURED", most, raising=False)
        near = {(r.query_id, r.index_id) for r in plans.q_vec_topk_approximate(spark, sf).collect()}
        assert len(near & exact) >= 0.9 * len(exact)
    assert vc.approximate_neighbours(q.limit(0), index).count() == vc.approximate_neighbours(q, index.limit(0)).count() == 0


def test_loss_report(spark, scored):
    truth = spark.createDataFrame([("a", "S2-1"), ("b", "S2-7"), ("b", "S3-3")], PAIR)
    entities = spark.createDataFrame([("a", "us"), ("b", "us"), ("c", "fr")], "source1_id string, country string")
    names = spark.createDataFrame([("S2-1", "plain"), ("S3-3", "é")], "target_id string, name string")
    got = {(r.country, r.source, r.non_ascii): r for r in dg.loss_report(scored, truth, entities, names, 0.5).collect()}
    assert (got["us", "S2", False].tp, got["us", "S2", False].not_candidate) == (1, 1)
    assert got["us", "S3", True].rejected == 1 and got["us", "S3", False].false_positive == 1


def test_ceiling(spark):
    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "source1_id string")
    truth = spark.createDataFrame([("a", "S2-1"), ("a", "S2-2"), ("c", "S3-1")], PAIR)
    frame = spark.createDataFrame([("a", "S2-1", 3, True), ("a", "S2-2", 50, True), ("c", "S3-1", 90, True)], f"{PAIR}, rank_name short, is_true boolean")
    got = lab.configuration_report(entities, truth, frame, {"narrow": {"rank_name": 20}}).first()
    assert abs(got.ceiling - (1.25 * 0.5 / 0.75 + 1 + 0) / 3) < 1e-5


def test_neyman_rates():
    rates = mt.neyman_rates({"hard": 100, "easy": 10_000}, {"hard": 1.0, "easy": 0.01}, 150)
    assert rates["hard"] == 0.75 and abs(rates["easy"] * 10_000 - 75) < 1e-6
    assert mt.neyman_rates({"hard": 10, "easy": 100}, {"hard": 5.0, "easy": 1.0}, 60) == {"hard": 1.0, "easy": 0.5}


def test_shuffled_labels_keep_their_number(spark):
    df = spark.createDataFrame([(f"s{i % 7}", f"t{i}", int(i % 3 == 0)) for i in range(60)], f"{PAIR}, label int")
    out = mt.shuffled_labels(df)
    assert out.count() == 60 and out.agg(F.sum("label")).first()[0] == 20


def test_files(spark, tmp_path, records):
    (tmp_path / "r.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\ta \"q\" \\\t\tUS\n")
    assert [tuple(r) for r in tsv.read_records(spark, str(tmp_path / "r.tsv")).collect()] == [("S1-1", 'a "q" \\', "", "US")]
    assert tsv.read_records(spark, str(tmp_path / "r.tsv"), strict=False).first().business_address == ""
    (tmp_path / "bad.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tonly two\n")
    with pytest.raises(Exception, match="without 4 fields"):
        tsv.read_records(spark, str(tmp_path / "bad.tsv")).collect()
    with pytest.raises(ValueError, match="header"):
        tsv.read_records(spark, str(tmp_path / "r.tsv").replace("r.tsv", "t.tsv") if (tmp_path / "t.tsv").write_text("x\ty\n") else "").collect()
    (tmp_path / "l.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n")
    rows, links = tsv.read_links(spark, str(tmp_path / "l.tsv"))
    assert rows.count() == 2 and pairs(links) == {("S1-1", "S2-1"), ("S1-1", "S3-2")}
    (tmp_path / "d.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-1\t\n")
    with pytest.raises(Exception, match="duplicate row"):
        tsv.read_links(spark, str(tmp_path / "d.tsv"))[1].collect()
    tsv.write_tsv(records, str(tmp_path / "out"))
    assert tsv.inventory(spark, str(tmp_path), "l.tsv").first().rows == 2
    tsv.package([str(tmp_path / "r.tsv")], str(tmp_path / "z.zip"))
    with pytest.raises(FileNotFoundError):
        tsv.package([str(tmp_path / "none")], str(tmp_path / "z.zip"))


def test_stream(spark, tmp_path, records):
    from linkspark.streaming.incremental import link_stream

    one, others = sides(records)
    others.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(others.schema).parquet(str(tmp_path / "in"))
    link_stream(stream, one, str(tmp_path / "out"), str(tmp_path / "check"), "name:3").awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("target_id = 'S2-1' AND source1_id = 'S1-1'").count() == 1


def test_index_is_used_again(spark, tmp_path, records):
    from linkspark.operators import index_store as store

    path = str(tmp_path / "index")
    assert store.build_index(records, path, ["name", "address"]) and not store.build_index(records, path, ["name", "address"])
    assert store.build_index(records, path, ["name"])
    index = store.load_index(spark, path)
    assert index.postings.where("country = 'us'").count() > 0 and index.idf.select("view").distinct().count() == 1


def test_a_stored_index_finds_the_same(spark, tmp_path, records, monkeypatch):
    from linkspark.operators import features as ft, index_store as store

    one, others = sides(records)
    index = store.stored_index(others, str(tmp_path / "index"), ["name", "address", "address_char"])
    spec = "name:5,address:5,combined@0.6:5"
    found = bk.neighbours(one, others, spec)
    wide = bk.forward_pairs(one, others, "name:5").select("source1_id", "target_id")
    cosines, features = bk.exact_cosines(wide, one, others), ft.pair_features(wide, one, others)

    def rows(df):
        return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df.collect())

    want = [rows(df) for df in (found, cosines, features)]
    monkeypatch.setattr(bk, "idf_table", None)  # nothing is counted anew
    got = [bk.neighbours(one, index, spec), bk.exact_cosines(wide, one, others, index=index), ft.pair_features(wide, one, others, index=index)]
    assert [rows(df) for df in got] == want


def test_linking_end_to_end(spark, tmp_path):
    import random

    from linkspark.plans import pipeline

    rng = random.Random(0)
    words = "acme delta river stone hill green north star blue oak metro union royal prime".split()
    rows, links = [], []
    for i in range(60):
        name, address = " ".join(rng.sample(words, 3)), f"{rng.randint(1, 99)} {rng.choice(words)} street"
        rows.append((f"S1-{i}", name, address, "US"))
        for s in ("S2", "S3"):
            rows.append((f"{s}-{i}", name + rng.choice(["", " inc", " ltd"]), address.replace("street", rng.choice(["st", "street"])), "us"))
            links.append((f"S1-{i}", f"{s}-{i}"))
    df = spark.createDataFrame(rows, RECORD)
    one, others = sides(df)
    truth = spark.createDataFrame(links, PAIR)
    config = {"rank_name": 3, "rank_combined_060": 3, "rev_rank_name": 3}
    models, setting = pipeline.train(one, others, truth, config, rounds=2, depth=2)
    pipeline.link(one, others, models, setting, config, str(tmp_path / "out"))
    entities, found = tsv.read_links(spark, str(tmp_path / "out" / "matching_results"))
    report = dc.score_report(entities, truth, found).first()
    assert report.entities == 60 and report.macro_f05 > 0.9
    base = found.where("target_id LIKE 'S2%'")
    assert lab.end_to_end_gate(entities, truth, base, found)["passed"]


def test_store_split_and_report(spark, tmp_path, records):
    import json

    tsv.write_record_store(records, "record_store", 4)
    assert spark.table("record_store").count() == records.count()
    with pytest.raises(ValueError, match="repeated id"):
        tsv.write_record_store(records.union(records.limit(1)), "record_store_2", 4)
    rows = spark.createDataFrame([(f"S1-{i}", "S2-1") for i in range(200)], "source1_entity_id string, matched_entity_ids string")
    tsv.split_truth(rows, str(tmp_path / "split"))
    parts = {p: tsv.read_links(spark, str(tmp_path / "split" / p))[0].count() for p in ("train", "validation")}
    assert sum(parts.values()) == 200 and 5 < parts["validation"] < 40
    tsv.write_report({"a": 1}, str(tmp_path / "report"))
    assert json.loads((tmp_path / "report.json").read_text()) == {"a": 1}


def test_lab_choices(spark):
    rows, links = [], []
    for i in range(60):
        links.append((f"e{i}", f"S2-{i}"))
        rows.append((f"e{i}", f"S2-{i}", 40 if i % 2 else 5, 3, 25, True))
        rows.append((f"e{i}", f"S3-{i}", 1, 50, 60, False))
    pairs = spark.createDataFrame(rows, f"{PAIR}, rank_name short, rank_combined_060 short, rank_combined_040 short, is_true boolean")
    entities, truth = spark.createDataFrame([(f"e{i}",) for i in range(60)], "source1_id string"), spark.createDataFrame(links, PAIR)
    best = lab.choose_weight(entities, truth, pairs, 10).first()
    assert best.config == "0.6" and best.recall == 1
    steps = lab.greedy_configuration(entities, truth, pairs, budget=5.0, limit=2)
    assert steps[0][0] == {"rank_combined_060": 10} and steps[0][1] == 1.0
    gate = lab.gate(entities, truth, pairs, {"rank_name": 10}, {"rank_combined_060": 10})
    assert gate["passed"] and gate["recall_base"] == 0.5
    assert lab.choose_text_form(entities, truth, {"short": pairs.where("rank_name < 10"), "long": pairs}, {"rank_name": 50}) == "long"


def test_folds_and_curve(spark):
    import random

    rng = random.Random(0)
    rows = [(f"e{i % 150}", f"S2-{i}", rng.random(), int(i % 3 == 0)) for i in range(900)]
    pairs = spark.createDataFrame([(s, t, x + y, y) for s, t, x, y in rows], f"{PAIR}, x double, label int")
    entities = pairs.select("source1_id").distinct()
    truth = pairs.where("label = 1").select("source1_id", "target_id")
    curve = mt.learning_curve(pairs, ["x"], 0.5, entities, truth, rounds=2, depth=2)
    assert curve["all"] > 0.9
    scores = mt.score_pairs(pairs, ["x"], mt.train_folds(mt.shuffled_labels(pairs), ["x"], rounds=2, depth=2))
    shuffled = dc.score_report(entities, truth, dc.decide(scores, 0.5, one_owner=False)).first()
    assert shuffled.macro_f05 < shuffled.singletons / shuffled.entities + 0.1 < curve["all"]  # near what no link at all scores


def test_first_gate_and_export(spark, tmp_path):
    rows, links, slices = [], [], []
    for i in range(80):
        links.append((f"e{i}", f"S2-{i}"))
        slices.append((f"e{i}", f"S2-{i}", "us" if i % 2 else "fr", "S2", "latin", False, False))
        rows += [(f"e{i}", f"S2-{i}", 40 if i % 4 else 5, 3, True), (f"e{i}", f"S3-{i}", 1, 50, False)]
    pairs = spark.createDataFrame(rows, f"{PAIR}, rank_name short, rank_combined_060 short, is_true boolean")
    truth = spark.createDataFrame(links, PAIR)
    own = spark.createDataFrame(slices, f"{PAIR}, country string, source string, script string, empty_address boolean, alias boolean")
    sets = {n: spark.createDataFrame([(f"e{i}", n) for i in range(a, b)], "source1_id string, lab_set string") for n, a, b in (("block_dev", 0, 40), ("block_confirm", 40, 80))}
    good = lab.first_gate(sets, truth, pairs, own, {"rank_name": 10}, {"rank_combined_060": 10})
    assert good["passed"] and good["regressed_slices"] == [] and abs(good["dev_confirm_gap"]) < 1e-9
    worse = lab.first_gate(sets, truth, pairs, own, {"rank_combined_060": 10}, {"rank_name": 10})
    assert not worse["passed"] and {r[0] for r in worse["regressed_slices"]} >= {"country", "source"}
    entities = sets["block_dev"].unionByName(sets["block_confirm"])
    report = lab.export_candidates(entities, "block_confirm", pairs, {"rank_combined_060": 10}, str(tmp_path / "out")).first()
    assert tuple(report) == ("block_confirm", 40, 40, 1.0)
    lists, found = tsv.read_links(spark, str(tmp_path / "out" / "candidates"), "candidate_entity_ids")
    assert lists.count() == 40 and pairs_of(found) == {(f"e{i}", f"S2-{i}") for i in range(40, 80)}


def pairs_of(df):
    return {(r.source1_id, r.target_id) for r in df.collect()}


def test_feature_lists():
    from linkspark.operators import features as ft

    v2, v3 = ft.feature_list("v2"), ft.feature_list()
    assert len(v2) == 42 and len(v3) == 80 and len(ft.feature_columns()) == 81 and set(v2) - set(v3) == {"target_non_ascii"}
    with pytest.raises(ValueError):
        ft.feature_list("v9")


def test_triggered_targets_alone_search(spark):
    df = spark.createDataFrame([(i, "x", [float(i), 1.0], i % 2 == 0) for i in range(10)], "id int, country string, vector array<double>, triggered boolean")
    assert {r.query_id for r in vc.triggered_neighbours(df, df, 3).collect()} == {0, 2, 4, 6, 8}


def test_transfer_between_countries(spark):
    import random

    rng = random.Random(0)
    rows = [(f"e{i % 300}", f"S2-{i}", "us" if i % 300 < 150 else "fr", rng.random(), int(i % 3 == 0)) for i in range(1800)]
    pairs = spark.createDataFrame([(s, t, c, x + y, y) for s, t, c, x, y in rows], f"{PAIR}, country string, x double, label int")
    entities = pairs.select("source1_id", "country").distinct()
    truth = pairs.where("label = 1").select("source1_id", "target_id")
    r = mt.country_transfer(pairs, ["x"], entities, truth, "us", "fr", 0.5, share=0.9, rounds=3, depth=2).first()
    assert (r.train_country, r.eval_country) == ("us", "fr") and r.fit_rows > 300 and r.macro_f05 > 0.9

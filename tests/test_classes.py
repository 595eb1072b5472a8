"""Copies are computed once: classes of rows, and what comes out of their pairs."""

import pytest
from pyspark.sql import functions as F

from linkspark.operators import blocking as bk
from linkspark.operators.classes import SLICE, classes, expanded
from linkspark.plans import queries as q

KEYS = "entity_id string, kind string, country string, key string"


def exchanges(df) -> str:
    return "\n".join(x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x)


def same_as_sql(spark, folder, name):
    import duckdb

    con, df = duckdb.connect(), q.QUERIES[name](spark, folder)
    for t in ("part", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(q.SQL[name])
    names = [d[0] for d in found.description]
    shown = lambda data: sorted(tuple(repr(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x) for x in r) for r in data)
    assert shown(df.select(*names).collect()) == shown(found.fetchall())


@pytest.fixture(scope="module")
def keyed(spark):
    left = [(f"S1-{i}", k, "x", f"{i % m}") for i in range(40) for k, m in (("a", 3), ("b", 5))]
    right = [(f"S2-{i}", k, "y" if i == 7 else "x", f"{i % m}") for i in range(60) for k, m in (("a", 4), ("b", 5))]
    wanted = {(p[0], q[0]) for p in left for q in right if p[1:] == q[1:]}
    return spark.createDataFrame(left, KEYS), spark.createDataFrame(right, KEYS), wanted


def test_key_pairs_are_made_once_and_not_moved(keyed):
    a, b, wanted = keyed
    found = bk.key_pairs(a, b)
    got = [(r.source1_id, r.target_id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    assert "target_id" not in exchanges(found)


def test_large_classes_come_apart(spark):
    n = SLICE + 3
    a = spark.range(n).select(F.concat(F.lit("S1-"), "id").alias("entity_id"))
    both = classes(a.withColumn("k", F.lit(1)), ["k"])
    assert both.count() == 1 and expanded(both.select("entity_id"), both, "entity_id").distinct().count() == n


def test_key_lists_are_made_once_per_class(spark, keyed):
    a, b, wanted = keyed
    entities = spark.createDataFrame([(f"S1-{i}",) for i in [*range(40), 99]], "entity_id string")
    got = {r[0]: r[1] for r in bk.key_lists(entities, a, b, "ids").collect()}
    assert got == {f"S1-{i}": ",".join(sorted(t for s, t in wanted if s == f"S1-{i}")) for i in [*range(40), 99]}


def test_key_pairs_are_counted_without_making_them(spark, keyed):
    a, b, wanted = keyed
    count = bk.key_pair_count(a, b)
    assert count.collect()[0][0] == len(wanted) and "source1_id" not in exchanges(count)
    links = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-7"), ("S1-2", "S2-3"), ("S1-50", "S2-1")], "source1_id string, target_id string")
    assert {(r[0], r[1]) for r in bk.key_found(links, a, b).where("hit = 1").collect()} == wanted & {(r[0], r[1]) for r in links.collect()}


def test_noise_of_counted_pairs_is_that_of_pairs(spark, sf):
    from linkspark.operators import diagnostics as dg
    from linkspark.plans import fixtures as fx

    rows = fx.parts(spark, sf).where("country <= 'size 3'")
    rows = rows.unionByName(rows.withColumn("entity_id", F.concat("entity_id", F.lit("-2"))))
    a, b = (rows.select(F.col("entity_id").alias(i), *[F.col(c).alias(f"{n}_{s}") for c, n in (("business_name", "name"), ("business_address", "address"), ("country", "country"))]) for i, s in (("source1_id", "a"), ("target_id", "b")))
    pairs, counted = fx.part_pairs(rows).join(a, "source1_id").join(b, "target_id"), fx.part_pair_counts(rows)
    for made, multiplied in zip(dg.pair_counts(pairs), counted, strict=True):
        assert {tuple(sorted(r.asDict().items())) for r in made.collect()} == {tuple(sorted(r.asDict().items())) for r in multiplied.collect()}
        assert "source1_id" not in multiplied._jdf.queryExecution().executedPlan().toString()
    assert dg.noise_profile(*counted).first().pairs == pairs.count() > 0


@pytest.fixture(scope="module")
def tripled(sf, tmp_path_factory):
    """Parts and customers three times, with keys shifted by multiples of three: nine times the pairs, of the same texts."""
    import duckdb

    folder = tmp_path_factory.mktemp("tripled")
    for table, key, some in (("part", "p_partkey", "p_size <= 8"), ("customer", "c_custkey", "true")):
        duckdb.sql(f"COPY (SELECT * REPLACE ({key} + 30000 * i AS {key}) FROM '{sf}/{table}.parquet', range(3) r(i) WHERE {some}) TO '{folder}/{table}.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["fuzzy_ratios", "partial_ratios", "text_similarities", "idf_overlap"])
def test_texts_of_copies_are_compared_once(spark, tripled, name):
    same_as_sql(spark, tripled, name)
    made = q._sides(spark, tripled)
    assert 0 < made.count() * 9 <= q.QUERIES[name](spark, tripled).count()


def test_names_are_compared_once(spark, tripled):
    from linkspark.plans import fixtures as fx

    names = fx.name_pairs(fx.parts(spark, tripled)).select("name_a", "name_b").distinct()
    assert q._sides(spark, tripled).count() == names.count() > 0


@pytest.mark.parametrize("name", ["fuzzy_ratios", "partial_ratios"])
def test_names_and_addresses_are_compared_apart(spark, tripled, name, monkeypatch):
    from linkspark.operators import features as ft

    made, some = [], ft.fuzzy_some
    monkeypatch.setattr(ft, "fuzzy_some", lambda names, *sides: made.append({ft.FUZZY[n][1].split("_")[0] for n in names}) or some(names, *sides))
    q.QUERIES[name](spark, tripled)
    assert sorted(map(sorted, made)) == [["address"], ["name"]]


def test_index_of_copies_is_that_of_all(spark, tripled):
    from linkspark.plans import fixtures as fx

    targets = fx.targets(fx.parts(spark, tripled))
    targets = targets.withColumn("business_name", F.when(F.col("country") == "size 1", F.concat("business_name", F.lit(" dba other"))).otherwise(F.col("business_name")))
    rows = bk.index_rows(targets, True)
    for view, column in (("name", "business_name"), ("address", "business_address")):
        whole, counted = bk.idf_table(bk.term_counts(rows, [view]), rows), bk.counted_index(fx.text_records(targets, column), [view]).idf
        got, wanted = (sorted(tuple(r) for r in df.select("country", "view", "term", "df", "n").collect()) for df in (counted, whole))
        assert got == wanted and got


@pytest.mark.parametrize("name", ["token_features", "exact_cosines", "pair_features_checked"])
def test_features_of_copies_are_made_once(spark, tripled, name):
    same_as_sql(spark, tripled, name)
    plan = q.QUERIES[name](spark, tripled)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(_m1" in plan or "explode(members" in plan


def test_ranks_count_the_copies(spark, tripled):
    from linkspark.operators import features as ft
    from linkspark.plans import fixtures as fx

    rows = fx.parts(spark, tripled)
    plain = ft.pair_features(fx.part_pairs(rows), fx.source1(rows), fx.targets(rows))
    shown = ["source1_id", "target_id", "blend_rank", "name_token_set_rank", "blend_source_rank", "group_size", "cos_c1_ratio_to_best", "target_source3"]
    got, wanted = (sorted(tuple(r) for r in df.select(*shown).collect()) for df in (q.q_pair_features(spark, tripled), plain))
    assert got == wanted and got

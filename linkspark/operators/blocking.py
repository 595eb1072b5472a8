"""Candidate generation: blocking keys and budgeted TF-IDF neighbours; vector neighbours are in ``vectors``.

Nothing ever crosses a country. Records are (entity_id, name, address, country) rows; pairs are rows too.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions import text as tx
from linkspark.operators import postings as ps
from linkspark.operators.classes import classes, sliced
from linkspark.operators.search import best_by_blocks

DIGITS = 6


def country_key(country: Column) -> Column:
    """Casefolded; plain lower case is the same but for a few letters, which only other scripts' labels have."""
    return F.replace(F.lower(F.regexp_replace(F.coalesce(country, F.lit("")), r"^\s+|\s+$", "")), F.lit("ß"), F.lit("ss"))


# ---- keys


def blocking_keys(records: DataFrame) -> DataFrame:
    """entity_id, kind, country, key of each non-empty key of ``records`` (business_name, business_address, country)."""
    n = tx.normalize_plain(F.col("business_name"))
    normal = records.withColumn("n", n)
    keys = F.array(
        F.struct(F.lit("first3").alias("kind"), F.when(F.length("n") >= 3, F.substring("n", 1, 3)).otherwise("").alias("key")),
        F.struct(F.lit("firstword").alias("kind"), F.split("n", " ")[0].alias("key")),
        F.struct(F.lit("soundex").alias("kind"), tx.soundex_simple(F.col("n")).alias("key")),
        F.struct(F.lit("postal").alias("kind"), tx.postal(F.col("business_address"), F.col("country"))["code"].alias("key")),
    )
    return normal.select("entity_id", country_key(F.col("country")).alias("country"), F.explode(keys).alias("k")).where("k.key <> ''").select("entity_id", "country", "k.kind", "k.key")


def large_blocks(left: DataFrame, right: DataFrame, n: int = 20) -> DataFrame:
    """kind, country, key, pairs of the ``n`` keys that make most pairs: what a bound on pairs would have to look at."""
    on = ["kind", "country", "key"]
    sizes = [df.groupBy(*on).agg(F.count("*").alias(c)) for df, c in ((left, "a"), (right, "b"))]
    return sizes[0].join(sizes[1], on).select(*on, (F.col("a") * F.col("b")).alias("pairs")).orderBy(F.desc("pairs"), *on).limit(n)


def _key_sets(keys: DataFrame) -> DataFrame:
    """entity_id, ks: all keys of an entity, in order."""
    key = F.concat_ws("\0", "kind", "country", "key")
    return keys.groupBy("entity_id").agg(F.array_sort(F.collect_set(key)).alias("ks"))


def _class_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns of ``left`` and ``right`` (each with ks, and no other in common) for pairs of rows that share a key, each
    pair once: where it has its first common key."""
    a = left.select("*", F.posexplode("ks").alias("place", "key")).withColumn("earlier", F.slice("ks", F.lit(1), F.col("place"))).drop("ks", "place")
    b = right.select("*", F.explode("ks").alias("key"))
    return a.join(b, "key").where(~F.arrays_overlap("earlier", "ks")).drop("key", "earlier", "ks")


def key_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """source1_id, target_id of the distinct pairs that share a key: all of them, however common the key (see
    ``large_blocks``). Entities with the same keys are one class; its pairs are made once and come apart where they are."""
    a, b = (sliced(classes(_key_sets(df), ["ks"])).select("ks", F.col("members").alias(m)) for df, m in ((left, "m1"), (right, "m2")))
    found = _class_pairs(a, b).select("m2", F.explode("m1").alias("source1_id"))
    return found.select("source1_id", F.explode("m2").alias("target_id"))


def key_pair_count(left: DataFrame, right: DataFrame) -> DataFrame:
    """candidate_pairs: how many ``key_pairs`` has, from sizes of classes; no pair is made."""
    a, b = (_key_sets(df).groupBy("ks").agg(F.count("*").alias(n)) for df, n in ((left, "n1"), (right, "n2")))
    return _class_pairs(a, b).agg(F.coalesce(F.sum(F.col("n1") * F.col("n2")), F.lit(0)).alias("candidate_pairs"))


def key_found(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``links`` (source1_id, target_id, distinct) and hit: 1 if ``key_pairs`` has the pair, else 0."""
    a, b = (_key_sets(df).select(F.col("entity_id").alias(i), F.col("ks").alias(k)) for df, i, k in ((left, "source1_id", "k1"), (right, "target_id", "k2")))
    both = links.join(a, "source1_id", "left").join(b, "target_id", "left")
    return both.select(*links.columns, F.coalesce(F.arrays_overlap("k1", "k2"), F.lit(False)).cast("int").alias("hit"))


def key_lists(entities: DataFrame, left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Each row of ``entities`` with its targets of ``key_pairs``, sorted and joined by commas; empty without any.

    A list is made once per class of entities with the same keys, and meets the class's members where it is."""
    sets = _key_sets(left)
    a = classes(sets, ["ks"]).select("ks", F.col("entity_id").alias("c"))
    b = sliced(classes(_key_sets(right), ["ks"])).select("ks", "members")
    lists = _class_pairs(a, b).groupBy("c").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("members"))), ",").alias(name))
    of = entities.select("entity_id").join(sets, "entity_id", "left").join(a, "ks", "left").groupBy("c").agg(F.collect_list("entity_id").alias("members"))
    return of.join(lists, "c", "left").select(F.explode("members").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


# ---- TF-IDF

VIEWS = {"name": lambda n, a: tx.name_features(n), "address": lambda n, a: tx.address_features(a), "address_char": lambda n, a: tx.address_char_features(a)}


def index_rows(records: DataFrame, variants: bool, by_words: bool = False) -> DataFrame:
    """entity_id, row, country, name, address: normalized, a row per name variant on demand. ``by_words``: names in batches, each
    distinct word once, with the same results."""
    if by_words:
        names = (tx.name_variants_of_words if variants else tx.normal_names_of_words)(F.col("business_name"))
    else:
        names = tx.name_variants(F.col("business_name")) if variants else F.array(tx.normalize_name(F.col("business_name")))
    return records.select("entity_id", country_key(F.col("country")).alias("country"), tx.normalize_address(F.col("business_address")).alias("address"), F.posexplode(names).alias("row", "name"))


def term_counts(rows: DataFrame, views: list[str], tokens: bool = False) -> DataFrame:
    """entity_id, row, country, view, term (and token on demand), tf.

    A term is the 64-bit hash of country, view and token, by which all joins go; tokens themselves are needed only where they
    are shown or order ties. Rows are dealt by entity while they are few: the grouping of their many tokens, and of all that
    is per entity later, then needs no exchange.
    """
    features = F.array(*[F.struct(F.lit(v).alias("view"), VIEWS[v](F.col("name"), F.col("address")).alias("tokens")) for v in views])
    # a number of partitions keeps adaptive execution from merging what grows so much in the next step
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_view = rows.repartition(n, "entity_id").select("entity_id", "row", "country", F.explode(features).alias("f"))
    long = of_view.select("entity_id", "row", "country", "f.view", F.explode("f.tokens").alias("token"))
    long = long.withColumn("term", F.xxhash64("country", "view", "token"))
    return long.groupBy("entity_id", "row", "country", "view", "term", *["token"] * tokens).agg(F.count("*").alias("tf"))


def country_sizes(rows: DataFrame) -> DataFrame:
    """country, n: index rows of each country."""
    return rows.groupBy("country").agg(F.count("*").alias("n"))


def idf_table(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """country, view, term (and token where ``counts`` has it), df, n, idf = ln((n + 1) / (df + 1)) + 1, with n the index rows
    of the country."""
    df = counts.groupBy("country", "view", "term", *["token"] * ("token" in counts.columns)).agg(F.count("*").alias("df"))
    return df.join(country_sizes(rows), "country").withColumn("idf", F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0)


def weighted(counts: DataFrame, idf: DataFrame, unseen: DataFrame | None = None) -> DataFrame:
    """Unit TF-IDF vectors. ``unseen`` (country, n): then tokens that the index lacks count, with a df of 0."""
    own = idf.select("term", "df", "idf")
    if unseen is None:
        joined = counts.join(own, "term")
    else:
        joined = counts.join(own, "term", "left").join(unseen, "country")
        joined = joined.withColumns({"idf": F.coalesce("idf", F.log(F.col("n") + 1.0) + 1.0), "df": F.coalesce("df", F.lit(0))})
    w = F.col("tf") * F.col("idf")
    norms = joined.groupBy("entity_id", "row", "view").agg(F.sqrt(F.sum(w * w)).alias("norm"))
    kept = ["entity_id", "row", "country", "view", "term", *["token"] * ("token" in counts.columns)]
    return joined.join(norms, ["entity_id", "row", "view"]).select(*kept, "df", (w / F.col("norm")).alias("weight"))


def budgeted(queries: DataFrame, budget: int) -> DataFrame:
    """Each query's rarest tokens, while their frequencies stay within the budget; the rarest always."""
    w = Window.partitionBy("entity_id", "row", "view").orderBy("df", "token")
    upto = F.sum("df").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return queries.withColumn("upto", upto).withColumn("nth", F.row_number().over(w)).where((F.col("upto") <= budget) | (F.col("nth") == 1)).drop("upto", "nth")


def parse_passes(spec: str) -> list[tuple[str, dict[str, float], int]]:
    """'name:20,combined@0.6:30' as (pass, weight by view, depth)."""
    out = []
    for item in spec.split(","):
        label, _, k = item.strip().rpartition(":")
        if label in VIEWS:
            out.append((label, {label: 1.0}, int(k)))
        elif label.startswith("combined@"):
            w = float(label[9:])
            out.append((f"combined_{round(100 * w):03d}", {"name": w, "address": 1 - w}, int(k)))
        else:
            raise ValueError(f"no such pass: {label!r}")
    return out


def pass_spec(config: dict) -> str:
    """The forward passes of a configuration {rank column: depth}, as ``parse_passes`` reads them."""
    names = [(c.removeprefix("rank_"), k) for c, k in config.items() if c.startswith("rank_") and k > 0]
    return ",".join(f"combined@{int(n[9:]) / 100:g}:{k}" if n.startswith("combined_") else f"{n}:{k}" for n, k in names)


@dataclass
class Index:
    """What a search needs of the records that it looks in: postings (term, view, entity_id, row, weight), IDF, sizes of
    countries, ids (entity_id)."""

    postings: DataFrame
    idf: DataFrame
    sizes: DataFrame
    ids: DataFrame


def built_index(records: DataFrame, views: list[str], variants: bool = True) -> Index:
    """The index of ``records``, not stored; ``index_store`` writes one and reads it again."""
    rows = index_rows(records, variants)
    counts = term_counts(rows, views)
    idf = idf_table(counts, rows)
    return Index(weighted(counts, idf), idf, country_sizes(rows), records.select("entity_id").distinct())


def counted_index(records: DataFrame, views: list[str], tokens: bool = False) -> Index:
    """IDF and sizes of the index of records of which ``records`` has each text once, with copies: how many have it. It has no
    postings and no ids, as ``exact_cosines`` needs none."""
    of, rows = records.select("entity_id", "copies"), index_rows(records, True)
    sizes = rows.join(of, "entity_id").groupBy("country").agg(F.sum("copies").alias("n"))
    df = term_counts(rows, views, tokens).join(of, "entity_id").groupBy("country", "view", "term", *["token"] * tokens).agg(F.sum("copies").alias("df"))
    return Index(None, df.join(sizes, "country").withColumn("idf", F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0), sizes, None)


def pass_views(spec: str) -> list[str]:
    return sorted({v for _, ws, _ in parse_passes(spec) for v in ws})


def neighbours(queries: DataFrame, index: DataFrame | Index, spec: str, budget: int = 50_000, variants: bool = True, query_variants: bool = False) -> DataFrame:
    """query_id, index_id, pass, score, rank: each query's best index entities by each pass of ``spec``.

    ``index``: records, or an index of them. Scores are cosines of pruned query vectors. An entity's variants count once,
    with its best score, before the depth is applied; ties go to the smaller id.
    """
    passes, views = parse_passes(spec), pass_views(spec)
    stored = isinstance(index, Index)
    asked_rows, depths = index_rows(queries, query_variants, not stored), [(ws, k) for _, ws, k in passes]
    if stored:
        index_ids = index.ids
        postings = index.postings.where(F.col("view").isin(views)).select("entity_id", "row", "country", "view", "term", "weight")
        own = weighted(term_counts(asked_rows, views, tokens=True), index.idf, index.sizes)
        asked = budgeted(own, budget).select("entity_id", "row", "country", "view", "term", "weight")
        n_index = index.sizes.agg(F.sum("n")).first()[0] or 0
        found = best_by_blocks(asked, postings, views, depths, queries.count(), n_index)
    else:
        index_ids = index.select("entity_id")
        found = ps.found(asked_rows, index_rows(index, variants, True), views, depths, budget, queries.count())
    best = found.select("q", "i", "n", F.round("score", DIGITS).alias("score"))
    depth = F.element_at(F.array(*[F.lit(k) for _, _, k in passes]), F.col("n") + 1)
    # ties of the last place all stay, until ids decide
    near = best.withColumn("place", F.rank().over(Window.partitionBy("q", "n").orderBy(F.desc("score")))).where(F.col("place") <= max(k for _, _, k in passes))
    near = near.where(F.col("place") <= depth)
    ids = [df.select(F.col("entity_id").alias(name)).distinct().withColumn(h, F.xxhash64(name)) for df, name, h in ((queries, "query_id", "q"), (index_ids, "index_id", "i"))]
    named = near.join(ids[0], "q").join(ids[1], "i").withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "n").orderBy(F.desc("score"), "index_id")))
    name = F.element_at(F.array(*[F.lit(label) for label, _, _ in passes]), F.col("n") + 1)
    return named.where(F.col("rank") <= depth).select("query_id", "index_id", name.alias("pass"), "score", "rank")


def wide_pairs(long: DataFrame, spec: str, best: bool = False) -> DataFrame:
    """A row per pair with rank_<pass> and score_<pass>; on demand the query's best and second score of each pass."""
    names = [n for n, _, _ in parse_passes(spec)]
    columns = [c for n in names for c in (F.min(F.when(F.col("pass") == n, F.col("rank"))).cast("short").alias(f"rank_{n}"), F.max(F.when(F.col("pass") == n, F.col("score"))).cast("float").alias(f"score_{n}"))]
    pairs = long.groupBy("query_id", "index_id").agg(*columns)
    if not best:
        return pairs
    top = [F.max(F.when((F.col("pass") == n) & (F.col("rank") == r), F.col("score"))).cast("float").alias(f"{p}_{n}") for n in names for r, p in ((1, "best"), (2, "second"))]
    return pairs.join(long.groupBy("query_id").agg(*top), "query_id")


def forward_pairs(source1: DataFrame, targets: DataFrame | Index, spec: str, budget: int = 50_000) -> DataFrame:
    return wide_pairs(neighbours(source1, targets, spec, budget), spec).withColumnsRenamed({"query_id": "source1_id", "index_id": "target_id"})


def reverse_pairs(source1: DataFrame | Index, targets: DataFrame, spec: str, budget: int = 50_000) -> DataFrame:
    """Targets, each name variant a query, against Source 1; columns with rev_, and the target's best and second."""
    wide = wide_pairs(neighbours(targets, source1, spec, budget, variants=False, query_variants=True), spec, best=True)
    names = {"query_id": "target_id", "index_id": "source1_id"} | {c: f"rev_{c}" for c in wide.columns if c not in ("query_id", "index_id")}
    return wide.withColumnsRenamed(names)


def profiles(records: DataFrame, index: Index, views: list[str]) -> DataFrame:
    """entity_id and a map from term to weight for each view: the whole unit vectors, under the IDF of ``index``."""
    own = weighted(term_counts(index_rows(records, False), views), index.idf, index.sizes)
    maps = [F.map_from_entries(F.collect_list(F.when(F.col("view") == v, F.struct("term", "weight")))).alias(f"vec_{v}") for v in views]
    return own.groupBy("entity_id").agg(*maps)


def map_dot(a: Column, b: Column) -> Column:
    """Of two maps from term to weight, null as empty."""
    shared = F.transform(F.map_entries(a), lambda e: e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))
    return F.coalesce(F.aggregate(shared, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def cosine_columns(a: str, b: str, weight: float, views: list[str] | None = None) -> dict[str, Column]:
    """cos_name, cos_address, cos_address_char, cos_c1 of two structs of vectors; of ``views`` alone, then without cos_c1."""
    own = {f"cos_{v}": map_dot(F.col(f"{a}.vec_{v}"), F.col(f"{b}.vec_{v}")) for v in views or VIEWS}
    return own if views else own | {"cos_c1": weight * own["cos_name"] + (1 - weight) * own["cos_address"]}


def exact_cosines(pairs: DataFrame, source1: DataFrame, targets: DataFrame, weight: float = 0.6, index: Index | None = None, only: list[str] | None = None) -> DataFrame:
    """source1_id, target_id, cos_name, cos_address, cos_address_char, cos_c1: whole vectors, for given pairs alone.

    Each record's vectors are made once and sent to its pairs. ``index``: of the targets, if it is there already. ``only``: views
    that are asked for, then without cos_c1.
    """
    views = only or list(VIEWS)
    index = index or built_index(targets, views)

    def side(records: DataFrame, id_name: str, alias: str) -> DataFrame:
        ids = pairs.select(F.col(id_name).alias("entity_id")).distinct()
        own = profiles(records.join(ids, "entity_id", "left_semi"), index, views)
        return own.select(F.col("entity_id").alias(id_name), F.struct(*[f"vec_{v}" for v in views]).alias(alias))

    joined = pairs.select("source1_id", "target_id").join(side(source1, "source1_id", "x"), "source1_id", "left").join(side(targets, "target_id", "y"), "target_id", "left")
    return joined.select("source1_id", "target_id", *[c.alias(n) for n, c in cosine_columns("x", "y", weight, only).items()])

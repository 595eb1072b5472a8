"""Near duplicates: texts whose sets of word shingles have a Jaccard similarity of a limit or more.

SimHash fingerprints of the shingles propose pairs first (``simhash.links``: generalised pigeonhole, probe and verify). No
radius that can be afforded has all pairs of a similarity of 0.8, so a prefix filter over the shingles themselves proposes
the rest: of the hashes by which two alike texts are compared, the rarest few of each share one. What either proposes is
verified on the shingle sets, and groups are connected components of what holds.

A node is a distinct shingle set: its FULL smallest 32-bit hashes, which is all of them in all but very long texts, so that
similarities are exact there, and beyond have a standard error below 0.01. Its SKETCH smallest are the prefix filter's. Sets
are stored once, and sent only where their node has a partner to be compared with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.llm.common import appended, bounded_sample, forget, fresh, release, salted_join, small_batches, written
from linkspark.llm.components import components
from linkspark.llm.simhash import CHUNK, _groups, _sorted, hashed, links, majority

#: 32-bit hashes of a node's set, and of the sketch from which pairs are proposed.
FULL, SKETCH = 2048, 256
#: How far below the limit a sketch's similarity may be for a pair to be verified: four standard errors.
MARGIN = 0.1
#: Nodes of a group that are compared in one task (squared).
BLOCK = 2048
#: Documents from which common shingles are picked, the fewest of them with a common one, and how many are kept.
PICK, OFTEN, COMMON = 4000, 3, 100_000


def smallest(hashes: np.ndarray, most: int = FULL) -> np.ndarray:
    """The ``most`` smallest 64-bit hashes that differ in their upper halves, in order."""
    h = np.unique(hashes)
    upper = h >> np.uint64(32)
    return h[np.append(True, upper[1:] != upper[:-1])[: len(h)]][:most]


def upper_halves(hashes: np.ndarray) -> bytes:
    return (hashes >> np.uint64(32)).astype(np.uint32).tobytes()


def all_hashes(text: str | None, words: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *hashed(text, words)])


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The rarest of a sketch's hashes, one more than may be missing in a sketch that is to be compared with it.

    Of m hashes at most (1 - s) m are not among those that make two sketches alike by s. The first, in any order common to
    all sketches, of those they share is thus in the prefix of both. s is the limit itself for a set too small to be like
    one that its sketch does not hold whole, else less by MARGIN. The order is by how ``often`` a hash was seen (``common``,
    sorted), then by the hash; it sets the cost, not what is found.
    """
    seen = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        seen = np.where(common[at] == hashes, often[at], 0)
    s = similarity if len(hashes) < similarity * SKETCH else similarity - MARGIN
    n = int((1 - s) * len(hashes) + 1e-9) + 1
    return hashes[np.lexsort((hashes, seen))[:n]]


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two nodes' sets: exact for whole sets, else from the FULL smallest of the union."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.concatenate((x, y))
    both.sort()
    again = np.append(both[1:] == both[:-1], False)  # the first of an equal pair
    n = len(both) - int(again.sum())
    if n > FULL and (len(x) == FULL or len(y) == FULL):
        first = np.append(True, both[1:] != both[:-1])
        end = np.flatnonzero(np.cumsum(first) > FULL)[0]
        return float(again[:end].sum() / FULL)
    return float(again.sum() / n)


def group_alike(sets: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``sets`` (none empty) that are alike: all pairs are compared but those already
    joined, first by their sketches, and on the sets where those come near."""
    n, found = len(sets), []
    own = [np.frombuffer(s, np.uint32) for s in sets]
    heads = [x[:SKETCH] for x in own]
    size = np.array([len(x) for x in heads])
    start = np.cumsum(size) - size
    codes = np.unique(np.concatenate(heads), return_inverse=True)[1]
    comp, mark = np.arange(n), np.zeros(int(codes.max()) + 1, bool)
    for i in range(n - 1):
        if not (comp[i + 1 :] != comp[i]).any():
            continue
        mine = codes[start[i] : start[i] + size[i]]
        mark[mine] = True
        shared = np.add.reduceat(mark[codes[start[i + 1] :]], start[i + 1 :] - start[i + 1], dtype=np.int64)
        mark[mine] = False
        larger = np.maximum(size[i], size[i + 1 :])  # what two sketches share is divided by no less
        bar = np.where(larger < SKETCH, similarity, similarity - MARGIN) * larger
        for j in (np.flatnonzero(shared + 1e-6 >= bar) + i + 1).tolist():
            if comp[i] != comp[j] and likeness(own[i], own[j]) >= similarity:
                comp[comp == comp[j]] = comp[i]
                found.append((i, j))
    return found


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _alike(similarity: float):
    """Over rows sorted by group: links whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for _, rows in _groups(batches):
            node = rows["node"].to_pylist()
            if len(node) > 1:
                found += [(node[i], node[j]) for i, j in group_alike(rows["full"].to_pylist(), similarity)]
            if len(found) > BLOCK:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    return run


def candidate_groups(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, node, i, j of ``nodes`` (node long, distinct; prefix array of long): the groups in which nodes are compared.

    Nodes with a hash of their prefixes in common are a group, and every alike pair is in one. Of groups with the same
    members one is compared (count and 128 bits over the members tell). A group of over ``block`` nodes is dealt into
    blocks, and every pair of blocks is a group of its own.
    """
    rows = nodes.select(F.explode("prefix").alias("key"), "node")
    several = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "several")
    met = written(salted_join(rows, several, "key", several).select("key", "node", "n"), "met")
    members = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    groups = met.groupBy("key").agg(F.first("n").alias("n"), *members).groupBy("n", "x1", "x2").agg(F.min("key").alias("key"))
    groups = written(groups.select("key", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "groups")
    forget(several)
    b = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int").alias("b")
    of = salted_join(met.drop("n"), groups.select("key", "blocks"), "key", groups)
    of = of.select("key", "node", b, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    out = written(of.select("key", "node", F.greatest("b", "x").alias("i"), F.least("b", "x").alias("j")), "candidates")
    forget(met)
    forget(groups)
    return out


def proposed(nodes: DataFrame, radius: int) -> DataFrame:
    """key, node, i, j of ``nodes`` (node, fp): the pairs that SimHash proposes, as groups of two.

    Of each fingerprint one node stands for it: it is compared with the others of its fingerprint, and with those that stand
    for fingerprints within ``radius``.
    """
    lowest = written(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "firsts")
    linked = links(lowest.select("fp"), radius).select("a", "b")
    ends = [lowest.select(F.col("fp").alias(c), F.col("first").alias(f"n{c}")) for c in "ab"]
    near = linked.join(ends[0], "a").join(ends[1], "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    same = salted_join(nodes.select("node", "fp"), lowest.select("fp", "first"), "fp", lowest).where("node <> first")
    pairs = near.unionByName(same.select(F.col("first").alias("a"), F.col("node").alias("b")))
    keyed = pairs.select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("node"))
    return keyed.select("key", "node", F.lit(-1).alias("i"), F.lit(-1).alias("j"))


def alike_links(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of ``candidates`` (key, node, i, j): links whose ``sets`` (node, full) are alike, and which join all that such
    links join inside a group."""
    own = sets.join(candidates.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("full").alias("full"))
    return _sorted(candidates.join(own, "node")).mapInArrow(_alike(similarity), "a long, b long")


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of at most COMMON shingles that PICK of ``docs`` (KEY, text) have most often, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = smallest(all_hashes(text, words), SKETCH)
                yield pa.RecordBatch.from_pydict({"h": pa.array(own.view(np.int64), pa.int64())})

    sample = bounded_sample(docs.select(*KEY, "text"), F.struct(*KEY), PICK).select("text")
    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n"))
    top = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = np.array(top["h"], np.int64).view(np.uint64), np.array(top["n"], np.int64)
    return h[np.argsort(h)], n[np.argsort(h)]


MADE = T.StructType(
    [
        T.StructField("fp", T.LongType()),
        T.StructField("full", T.BinaryType()),
        T.StructField("prefix", T.ArrayType(T.LongType())),
    ]
)
_PA_MADE = pa.struct([("fp", pa.int64()), ("full", pa.binary()), ("prefix", pa.list_(pa.int64()))])
KEY = ["null_id", "id", "text_key"]


def _keyed(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with what tells its rows apart: whether the id is null, the id as text, a hash of the text."""
    own = [F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text")]
    return docs.withColumns(dict(zip(names, own, strict=True)))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """null_id, id (as text), text_key, component, keeper, n: each distinct (doc_id, text) of ``docs`` with its group.

    Texts are alike if the sets of their ``words``-word shingles, lower-cased, have a Jaccard similarity of ``similarity`` at
    least; a text of fewer words has one shingle, and wordless and null texts are one group. Groups are connected components.
    keeper: the one row of its group that stays, the smallest by (null id last, doc_id, text_key); n: how often that row is
    there. A node's number is a 64-bit hash of its set, by which two different ones among 10^9 coincide in one case in 40.
    """
    small_batches(docs.sparkSession)
    keyed = _keyed(docs.select("doc_id", "text"), KEY)
    common, often = common_shingles(keyed, words)

    def make(texts: list) -> pa.Array:
        out = []
        for text in texts:
            every = all_hashes(text, words)
            own = smallest(every)
            rare = prefix(own[:SKETCH], similarity, common, often).view(np.int64) if len(own) else []
            out.append({"fp": majority(every[k : k + CHUNK] for k in range(0, len(every), CHUNK)), "full": upper_halves(own), "prefix": rare})
        return pa.array(out, _PA_MADE)

    made = appended(keyed, "made", MADE, make)
    own = written(made.select(*KEY, "doc_id", F.xxhash64("made.full").alias("node"), "made.*"), "sets")
    nodes = written(own.groupBy("node").agg(F.min(F.struct("prefix", "fp")).alias("r")).select("node", "r.*"), "nodes")
    grouped, pairs = candidate_groups(nodes), written(proposed(nodes, radius), "proposed")
    forget(nodes)
    release(docs.sparkSession)
    edges = written(alike_links(grouped.unionByName(pairs), own.select("node", "full"), similarity), "links")
    forget(grouped)
    forget(pairs)
    release(docs.sparkSession)
    roots = written(components(edges), "roots")
    # the smallest row of each node, then of each component, then back to the rows of a node
    smallest_row = F.min(F.struct("null_id", "doc_id", "text_key", "id"))
    first = own.groupBy("node").agg(smallest_row.alias("lowest"), F.count("*").alias("n"))
    first = written(first.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root"), "first")
    lowest = first.groupBy("component").agg(F.min("lowest").alias("keeper"))
    of_node = salted_join(first.select("node", "component"), lowest, "component", first.groupBy("component").agg(F.count("*").alias("n")))
    counted = own.groupBy(*KEY, "node").agg(F.count("*").alias("n"))
    named = salted_join(counted, of_node, "node", first.select("node", "n"))
    is_keeper = F.struct(*KEY) == F.struct("keeper.null_id", "keeper.id", "keeper.text_key")
    out = written(named.select(*KEY, "component", is_keeper.alias("keeper"), "n"), "groups")
    for done in (own, edges, roots, first):
        forget(done)
    return out


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near duplicates, with the columns that they had.

    The doc_id may be of any type that has an order. Of equal rows of a keeper one stays. Null ids come last among keepers;
    null, empty and wordless texts are one group; long texts are compared whole (see FULL). No rows: no rows.
    """
    groups = near_duplicates(docs.select("doc_id", "text"), **options)
    names = [fresh(docs, c) for c in KEY]
    keyed = _keyed(docs, names)
    group_keys = [F.col(c).alias(n) for c, n in zip(KEY, names, strict=True)]
    many = groups.where("keeper AND n > 1").select(*group_keys)
    out = keyed.join(groups.where("NOT keeper OR n > 1").select(*group_keys), names, "left_anti")
    if not many.isEmpty():
        out = out.unionByName(keyed.join(many, names, "left_semi").dropDuplicates(names))
    return out.select(*docs.columns)

"""Exact top-k inner products by branch and bound over ball trees.

Vectors are dealt into shards of bounded size, and each shard is a ball tree. From the root, a query opens that node of its
frontier whose upper bound <q, centre> + |q| radius is highest: an inner node puts its two children on the frontier, a leaf
is scored. It stops where no bound reaches its k-th score so far. All queries of a block take a step at once, each on its
own frontier, and those that are at one leaf are scored by one matrix product.

The k-th score is shared: a task carries it from shard to shard, and waves of shards, each eight times the one before,
start with the k-th scores that all former waves reached. Query blocks and groups of shards are rows of one table, which
meet by a key; so their number needs no loop on the driver, and no task holds more than a block and a shard.

Scores are integer inner products of floor(scale * x), made in double precision: exact while they stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.common import forget, small_batches, written

LEAF = 256
#: Vectors of a shard at most, and at least where that is needed to keep all cores busy; shards of a task; numbers in a block
#: of queries; queries that step together.
SHARD, SMALL, TOGETHER, NUMBERS, STEP = 16_384, 2048, 64, 1 << 23, 2048
FIRST_WAVE, GROWTH = 8, 8


class BallTree:
    """Nodes 0 (the root), 1, ...: ``left`` and ``right`` children (-1 for leaves), rows ``start`` to ``end`` of ``x``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.start, self.end, self.left, self.right = [], [], [], []
        centres, radii, order = [], [], np.arange(len(x))
        self.x = x
        todo = [(0, len(x), -1, False)] if len(x) else []
        while todo:
            a, b, parent, is_right = todo.pop()
            node, rows = len(self.start), order[a:b]
            own = x[rows]
            centre = own.mean(0)
            away = ((own - centre) ** 2).sum(1)
            self.start.append(a)
            self.end.append(b)
            self.left.append(-1)
            self.right.append(-1)
            centres.append(centre)
            radii.append(np.sqrt(away.max()))
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            if b - a > leaf:  # along the line from the farthest vector to the one farthest from that
                far = own[np.argmax(away)]
                other = own[np.argmax(((own - far) ** 2).sum(1))]
                order[a:b] = rows[np.argsort(own @ (other - far), kind="stable")]
                middle = (a + b) // 2
                todo += [(middle, b, node, True), (a, middle, node, False)]
        self.order, self.x = order, x[order]
        self.start, self.end, self.left, self.right = (np.array(v, np.int64) for v in (self.start, self.end, self.left, self.right))
        self.centre, self.radius = np.array(centres).reshape(len(centres), x.shape[1]), np.array(radii)

    def bounds(self, queries: np.ndarray, norms: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """No inner product of a query with a vector of its node is above; a little is added for rounding."""
        c = self.centre[nodes]
        bound = np.einsum("ij,ij->i", queries, c) + norms * self.radius[nodes]
        return bound + 1e-9 * (1 + norms) * (1 + np.abs(c).max(1, initial=0) * np.sqrt(c.shape[1]))


class Best:
    """The k best (score, id) of each query so far, as rows that fall by score and rise by id."""

    def __init__(self, queries: int, k: int, floors: np.ndarray):
        self.k, self.floors = k, floors
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def kth(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[q, self.k - 1], self.floors[q])

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Take in scores of queries ``q``, which may repeat."""
        who = np.unique(q)
        every = [np.concatenate(x) for x in ((np.repeat(who, self.k), q), (self.score[who].ravel(), score), (self.id[who].ravel(), ids))]
        order = np.lexsort((every[2], -every[1], every[0]))
        q, score, ids = (x[order] for x in every)
        first = np.searchsorted(q, who)
        pick = (first[:, None] + np.arange(self.k)).ravel()
        self.score[who], self.id[who] = score[pick].reshape(-1, self.k), ids[pick].reshape(-1, self.k)


def search(tree: BallTree, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own_rows: np.ndarray, best: Best, at: int = 0) -> np.ndarray:
    """Improve ``best`` for ``queries``, which are its queries from ``at`` on, by a shard's vectors other than their own
    rows. How many nodes each query opened."""
    opened = np.zeros(len(queries), np.int64)
    if not len(tree.start) or not len(queries):
        return opened
    norms = np.sqrt((queries**2).sum(1))
    frontier = np.full((len(queries), len(tree.start)), -np.inf)
    live = np.arange(len(queries))
    frontier[:, 0] = tree.bounds(queries, norms, np.zeros(len(queries), np.int64))
    ids, rows = ids[tree.order], rows[tree.order]
    while True:
        node = frontier[live].argmax(1)
        bound = frontier[live, node]
        go = (bound > -np.inf) & (bound >= best.kth(live + at))
        live, node = live[go], node[go]
        if not len(live):
            return opened
        frontier[live, node] = -np.inf
        opened[live] += 1
        inner = tree.left[node] >= 0
        q = live[inner]
        for children in (tree.left, tree.right):
            child = children[node[inner]]
            frontier[q, child] = tree.bounds(queries[q], norms[q], child)
        q, leaf = live[~inner], node[~inner]
        order = np.argsort(leaf, kind="stable")
        q, leaf = q[order], leaf[order]
        if not len(q):
            continue
        cuts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
        for a, b in zip(cuts, [*cuts[1:], len(leaf)], strict=True):
            own, here = q[a:b], slice(tree.start[leaf[a]], tree.end[leaf[a]])
            score = queries[own] @ tree.x[here].T
            hit = (score >= best.kth(own + at)[:, None]) & (rows[here][None, :] != own_rows[own][:, None])
            i, j = np.nonzero(hit)
            if len(i):
                best.add(own[i] + at, score[i, j], ids[here][j])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of one (width, block, team, shard), in which queries count as shard -1."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("width", "block", "team", "shard")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def _searched(k: int, leaf: int):
    """Over rows sorted by width, block, team and shard: the k best that each query finds in its team's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[pa.RecordBatch] = []
        shard: list[pa.RecordBatch] = []
        team, now, state = None, None, None

        def start() -> tuple | None:
            if not block:
                return None
            own = pa.Table.from_batches(block)
            floors = np.array(own["floor"].to_numpy(), np.float64)
            q = _matrix(own["v"].combine_chunks(), team[0])
            return q, own["row"].to_numpy(), Best(len(q), k, floors), np.zeros(len(q), np.int64)

        def finish_shard() -> None:
            if shard and state:
                own = pa.Table.from_batches(shard)
                tree = BallTree(_matrix(own["v"].combine_chunks(), team[0]), leaf)
                q, rows, best, opened = state
                for a in range(0, len(q), STEP):
                    part = slice(a, a + STEP)
                    opened[part] += search(tree, own["vec_id"].to_numpy(), own["row"].to_numpy(), q[part], rows[part], best, a)
            shard.clear()

        def results() -> pa.RecordBatch:
            _, rows, best, opened = state
            i, j = np.nonzero(best.score > -np.inf)
            columns = [pa.array(rows[i]), pa.array(best.id[i, j]), pa.array(best.score[i, j].astype(np.int64)), pa.array(np.where(j == 0, opened[i], 0))]
            return pa.RecordBatch.from_arrays(columns, ["query", "vec_id", "score", "opened"])

        for key, rows in _keyed(batches):
            if key[:3] != team:
                finish_shard()
                if state:
                    yield results()
                team, now, state = key[:3], -1, None
                block.clear()
            if key[3] != now:
                finish_shard()
                now = key[3]
                if state is None:
                    state = start()
            (block if now == -1 else shard).append(rows)
        finish_shard()
        if state:
            yield results()

    return run


def top_inner_products(
    vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding", shard: int = SHARD, leaf: int = LEAF
) -> DataFrame:
    """query_id, rank, vec_id, score, opened: for each row with ``is_query``, the ``k`` other rows of highest inner product.

    Components are floor(``scale`` * x); scores are exact while below 2^53. Rows with a null id, and vectors that are null,
    empty or hold a null or a non-finite component, take no part. Fewer candidates than ``k`` give all; ties go to the
    smaller id. A query is a row: all rows but itself are its candidates, those that repeat its id or vector too, and
    repeated queries are answered each. Vectors of another length than the query's are not compared with it. opened: nodes of
    trees that the query opened, in its first row. Other columns are ignored. Empty: no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, rows=4096)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col(id_column).isNotNull() & (F.size(vector) > 0) & finite
    asks = F.coalesce(is_query, F.lit(False))
    own = vectors.where(good).select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("vec_id"), whole.alias("v"), asks.alias("asks"))
    rows = written(own, "vectors")
    n, numbers = rows.agg(F.count("*"), F.sum(F.when(F.col("asks"), F.size("v")))).first()
    shape = "query long, vec_id long, score long, opened long"
    best_first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    if not numbers:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, opened long")
    cores = spark.sparkContext.defaultParallelism
    shards = max(-(-n // shard), min(2 * cores, -(-n // min(shard, SMALL))))
    blocks = -(-numbers // NUMBERS)
    width = F.size("v").alias("width")
    placed = rows.select("row", "vec_id", "v", width, F.pmod(F.xxhash64("row", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"))
    queries = rows.where("asks").select("row", "v", width, F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)).cast("int").alias("block"))
    known = None
    begin, end = 0, min(FIRST_WAVE, shards)
    while begin < shards:
        together = max(1, min(TOGETHER, (end - begin) * blocks // (2 * cores)))
        wave = placed.where(F.col("shard").between(begin, end - 1)).withColumn("team", F.floor((F.col("shard") - begin) / together).cast("int"))
        wave = wave.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        asked = queries.withColumn("floor", F.lit(float("-inf")))
        if known is not None:
            kth = known.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") == k)
            asked = queries.join(kth.select(F.col("query").alias("row"), F.col("score").cast("double").alias("s")), "row", "left")
            asked = asked.withColumn("floor", F.coalesce("s", F.lit(float("-inf")))).drop("s")
        teams = -(-(end - begin) // together)
        asked = asked.withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(teams - 1)))).withColumns({"shard": F.lit(-1), "vec_id": F.lit(0).cast("long")})
        both = wave.withColumn("floor", F.lit(0.0)).unionByName(asked)
        dealt = both.repartition("width", "block", "team").sortWithinPartitions("width", "block", "team", "shard")
        found = written(dealt.mapInArrow(_searched(k, leaf), shape), "wave")
        if known is not None:
            every = known.unionByName(found).withColumn("rank", F.row_number().over(best_first))
            total = F.sum("opened").over(Window.partitionBy("query"))
            kept = every.withColumn("opened", F.when(F.col("rank") == 1, total).otherwise(0)).where(F.col("rank") <= k).drop("rank")
            merged = written(kept, "best")
            forget(found)
            forget(known)
            found = merged
        known, begin, end = found, end, min(end * GROWTH, shards)
    names = rows.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    total = F.sum("opened").over(Window.partitionBy("query"))
    ranked = known.withColumns({"rank": F.row_number().over(best_first).cast("int"), "opened": total}).where(F.col("rank") <= k)
    ranked = ranked.withColumn("opened", F.when(F.col("rank") == 1, F.col("opened")).otherwise(0))
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score", "opened")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.r <> q.r AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that correlate are put into the same part of the fingerprint. If part i gets the threshold t_i and the t_i + 1 add up
to radius + 1, then two fingerprints within the radius are within t_i of each other in some part i. Thresholds are
unequal: dynamic programming takes those with the lowest cost, from counts of how many pairs agree to within t in each
part: of parts of up to COUNTED bits taken over all fingerprints, of wider ones estimated. Each fingerprint resides under its value of every used part and visits all values
within t_i; visitors and residents of a value are compared in full, in blocks of bounded size.

Equal fingerprints are one node from the start. What a value's group emits is a spanning forest of its links, never all
pairs; a group of any size is compared whole, in pairs of blocks over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.llm.common import appended, bounded_sample, salted_join, small_batches, written
from linkspark.llm.components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Shingles hashed at a time, and fingerprints of a group compared in one task (squared).
CHUNK, BLOCK = 65_536, 4096
#: What a probe row costs, in comparisons of two fingerprints.
PROBE = 300
#: Bits of a part whose values are counted one by one; of a wider one the counts are estimated from so many fingerprints.
COUNTED, ESTIMATED = 22, 16_384


def shingles(text: str | None, words: int) -> Iterator[bytes]:
    own = (text or "").encode().translate(LOWER).split()
    if 0 < len(own) < words:
        own, words = [b" ".join(own)], 1
    return map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False))


def hashed(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, repeats included, some at a time."""
    stream = shingles(text, words)
    while len(h := np.array([xxhash.xxh64_intdigest(s, SEED) for s in islice(stream, CHUNK)], np.uint64)):
        yield h


def majority(parts: Iterator[np.ndarray]) -> int:
    """Signed 64 bits: each is 1 if set in over half of the hashes. No hash: 0."""
    total, n = np.zeros(64, np.int64), 0
    for h in parts:
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n).view(">i8")[0]) if n else 0


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of the shingles. No word: 0."""
    return majority(hashed(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    small_batches(docs.sparkSession)
    return appended(docs, "fp", T.LongType(), lambda texts: pa.array([fingerprint(t, words) for t in texts], pa.int64())).select("doc_id", "fp")


@dataclass(frozen=True)
class Parts:
    """``bits`` of each part (0: the lowest) and the part's threshold, -1 where it is not probed."""

    bits: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]

    def values(self, fp: np.ndarray, part: int) -> np.ndarray:
        out = np.zeros(len(fp), np.int64)
        for k, b in enumerate(self.bits[part]):
            out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
        return out

    def masks(self, part: int) -> np.ndarray:
        width = len(self.bits[part])
        return np.array([sum(1 << b for b in c) for t in range(1, self.thresholds[part] + 1) for c in combinations(range(width), t)], np.int64)


def correlated_groups(together: np.ndarray, n: int, parts: int) -> tuple[tuple[int, ...], ...]:
    """Deal 64 bits into ``parts`` groups, each grown from the strongest pair by the bit that correlates most with it."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    c = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(c, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        own = c[np.ix_(left, left)]
        group = [left.pop(int(np.unravel_index(np.argmax(own), own.shape)[0]))]
        while len(group) < size:
            group.append(left.pop(int(np.argmax(c[np.ix_(left, group)].sum(1)))))
        out.append(tuple(sorted(group)))
    return tuple(out)


def pairs_within(counts: np.ndarray) -> list[float]:
    """From how many fingerprints have each value: the pairs (ordered) that differ in at most t bits, for t = 0, 1, ...

    The counts' autocorrelation under exclusive or, by a Walsh-Hadamard transform there and back.
    """
    x, h = counts.astype(float), 1
    for _ in range(2):
        h = 1
        while h < len(x):
            x = x.reshape(-1, 2, h)
            x = np.stack([x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]], 1).reshape(-1)
            h *= 2
        x = x * x if _ == 0 else x / len(x)
    weight = np.bitwise_count(np.arange(len(x)))
    return np.cumsum(np.bincount(weight, x)).tolist()


def allocate(costs: list[list[float]], units: int) -> tuple[int, ...]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = units at the lowest sum of costs[i][t_i + 1]."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for own in costs:
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (cost, chosen) in best.items():
            for k, c in enumerate(own[: units - used + 1]):
                if used + k not in after or cost + c < after[used + k][0]:
                    after[used + k] = (cost + c, (*chosen, k - 1))
        best = after
    return best[units][1]


def number_of_parts(n: int, radius: int) -> int:
    """How many parts would cost least if all bits were even: few and wide ones for many fingerprints."""

    def cost(m: int) -> float:
        width, units = 64 // m, radius + 1
        ts = [units // m - 1 + (k < units % m) for k in range(m)]
        return sum(sum(comb(width, j) for j in range(t + 1)) * (n * PROBE + n * n / 2**width) for t in ts)

    return min(range(max(2, (radius + 2) // 3), radius + 2), key=cost)


def estimated_pairs(sample: np.ndarray, n: int, width: int, most: int) -> list[float]:
    """Of a part's values in a sample of fingerprints: the ordered pairs of all ``n`` that differ in t bits at most.

    Even bits would give n^2 C(width, t) / 2^width, which is the least that is counted on: a sample sees too few pairs.
    """
    near = np.zeros(width + 1)
    for k in range(0, len(sample), 256):
        near += np.bincount(np.bitwise_count(sample[k : k + 256, None] ^ sample[None, :]).ravel(), minlength=width + 1)[: width + 1]
    near[0] -= len(sample)  # each with itself
    seen = np.cumsum(near) * (n / max(len(sample), 1)) ** 2
    even = np.cumsum([float(n) ** 2 * comb(width, t) / 2.0**width for t in range(width + 1)])
    return (np.maximum(seen, even)[: most + 1] + n).tolist()


def plan_parts(fps: DataFrame, n: int, radius: int) -> Parts:
    """Group the bits and allocate thresholds from statistics over all of ``fps`` (fp). What comes to the driver is one
    number for each pair of bits, and for each value of a part of up to COUNTED bits, of which there are 2^22 at most; for
    wider parts ESTIMATED fingerprints. Only the cost depends on the estimate."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            x = ((fp[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
            total += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(4096), pa.int32()), "n": pa.array(total.ravel(), pa.int64())})

    cells = fps.mapInArrow(bits, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    together = np.zeros(4096)
    together[np.array(cells["cell"])] = np.array(cells["n"])
    groups = correlated_groups(together.reshape(64, 64), n, number_of_parts(n, radius))
    counted = len(groups[0]) <= COUNTED
    own = Parts(groups, (0 if counted else -1,) * len(groups))
    sample = np.zeros(0, np.uint64)
    if not counted:
        sample = np.array(bounded_sample(fps, F.col("fp"), ESTIMATED).toArrow()["fp"], np.int64).view(np.uint64)
    keys = fps.mapInArrow(_spread(own), "key long, fp long, resident boolean").groupBy("key").agg(F.count("*").alias("n")).toArrow()
    key, count = np.array(keys["key"]), np.array(keys["n"])
    costs = []
    for i, g in enumerate(groups):
        if counted:
            counts = np.zeros(1 << len(g))
            mine = key >> 32 == i
            counts[key[mine] & 0xFFFFFFFF] = count[mine]
            near = pairs_within(counts)
        else:
            near = estimated_pairs(own.values(sample, i), n, len(g), min(radius, len(g)))
        costs.append([0.0, *(PROBE * n * sum(comb(len(g), j) for j in range(t + 1)) + near[t] for t in range(min(radius, len(g)) + 1))])
    return Parts(groups, allocate(costs, radius + 1))


def _spread(parts: Parts):
    """Rows (part and value, fingerprint, whether it resides there or visits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            fp = column.to_numpy(zero_copy_only=False).view(np.uint64)
            for i, t in enumerate(parts.thresholds):
                if t < 0:
                    continue
                own = parts.values(fp, i) | (i << 32)
                yield pa.RecordBatch.from_arrays([pa.array(own), column, pa.array(np.ones(len(fp), bool))], ["key", "fp", "resident"])
                for mask in parts.masks(i):
                    yield pa.RecordBatch.from_arrays([pa.array(own ^ mask), column, pa.array(np.zeros(len(fp), bool))], ["key", "fp", "resident"])

    return run


def group_links(fp: np.ndarray, resident: np.ndarray, radius: int) -> list[tuple[int, int, int]]:
    """(a, b, distance): a spanning forest, of least distance, of the links of a group.

    Visitors are compared with residents alone: two visitors meet elsewhere.
    """
    rows = np.flatnonzero(resident)
    near = np.zeros(len(fp), bool)
    for k in range(0, len(rows), 512):
        close = np.bitwise_count(fp[rows[k : k + 512], None] ^ fp[None, :]) <= radius
        close[np.arange(close.shape[0]), rows[k : k + 512]] = False
        near[rows[k : k + 512]] |= close.any(1)
        near |= close.any(0)
    fp = np.unique(fp[near])
    n = len(fp)
    found: dict[tuple[int, int], int] = {}
    comp = np.arange(n)
    while n > 1:
        best: dict[int, tuple[int, int, int]] = {}
        for k in range(0, n, 512):
            d = np.bitwise_count(fp[k : k + 512, None] ^ fp[None, :]).astype(np.int16)
            d[np.arange(len(d)), np.arange(k, k + len(d))] = 99
            d[comp[k : k + 512, None] == comp[None, :]] = 99
            j = d.argmin(1)
            for i in np.flatnonzero(d[np.arange(len(d)), j] <= radius):
                edge = (int(d[i, j[i]]), *sorted((int(i) + k, int(j[i]))))
                c = int(comp[i + k])
                if c not in best or edge < best[c]:
                    best[c] = edge
        if not best:
            break
        parent = {int(c): int(c) for c in np.unique(comp)}

        def top(c: int, parent: dict[int, int] = parent) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        for d_ab, a, b in sorted(best.values()):
            x, y = top(int(comp[a])), top(int(comp[b]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                found[a, b] = d_ab
        comp = np.array([top(int(c)) for c in comp])
    signed = fp.view(np.int64)
    return [(int(signed[a]), int(signed[b]), d) for (a, b), d in found.items()]


def _first_met(found: list[tuple[int, int, int]], parts: Parts, part: int) -> list[tuple[int, int, int]]:
    """The links whose ends meet in no part before ``part``. In the first part where the ends of a link meet, the forest
    of their group joins them, so that what is left out here is joined there."""
    if not found or not part:
        return found
    a, b = (np.array([f[k] for f in found], np.int64).view(np.uint64) for k in (0, 1))
    again = np.zeros(len(found), bool)
    for i in range(part):
        if parts.thresholds[i] >= 0:
            again |= np.bitwise_count(parts.values(a, i) ^ parts.values(b, i)) <= parts.thresholds[i]
    return [f for f, seen in zip(found, again.tolist(), strict=True) if not seen]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows sorted by key, i, j as (key, i, j) and the group's rows, across the borders of batches."""
    key, own = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            now = tuple(keys[a].tolist())
            if key is not None and now != key:
                yield key, pa.Table.from_batches(own)
                own = []
            key = now
            own.append(batch.slice(a, b - a))
    if key is not None:
        yield key, pa.Table.from_batches(own)


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return rows["fp"].to_numpy().view(np.uint64), rows["resident"].to_numpy()


def _compare(parts: Parts, radius: int):
    """Over rows sorted by group: the links of each, some thousand at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, int]] = []
        for key, rows in _groups(batches):
            if len(rows) > 1:
                found += _first_met(group_links(*_arrays(rows), radius), parts, key[0] >> 32)
            if len(found) > BLOCK:
                yield _links(found)
                found = []
        yield _links(found)

    return run


def _links(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    a, b, d = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "distance": pa.array(d, pa.int32())})


def _dealt(fps: DataFrame, parts: Parts, block: int) -> DataFrame:
    """key, fp, resident, i, j, sorted by group (key, i, j). A group of over ``block`` fingerprints is dealt into blocks, and
    every pair of blocks is a group of its own."""
    rows = fps.mapInArrow(_spread(parts), "key long, fp long, resident boolean")
    large = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large")
    zero = F.lit(0)
    if large.isEmpty():
        dealt = rows.select("key", "fp", "resident", zero.alias("i"), zero.alias("j"))
    else:
        b = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
        # block b takes part in the pairs (b, 0), ..., (b, b), (b + 1, b), ...
        partner = F.explode(F.sequence(zero, F.coalesce(F.col("blocks"), F.lit(1)) - 1)).alias("x")
        of = rows.join(large, "key", "left").select("key", "fp", "resident", F.coalesce(b, zero).alias("b"), partner)
        dealt = of.select("key", "fp", "resident", F.greatest("b", "x").alias("i"), F.least("b", "x").alias("j"))
    return _sorted(dealt)


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


LINK = "a long, b long, distance int"


def links(fps: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b, distance) of distinct ``fps`` (fp long): links within ``radius`` that join what is joined within it."""
    n = fps.count()
    if not n:
        return fps.sparkSession.createDataFrame([], LINK)
    parts = plan_parts(fps, n, radius)
    return _dealt(fps, parts, block).mapInArrow(_compare(parts, radius), LINK).groupBy("a", "b").agg(F.min("distance").alias("distance"))


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links within ``radius``).

    One row for each row of ``docs``. Null, empty and wordless texts have the fingerprint zero, linked like any other. A
    null doc_id is never a component's id unless all its ids are null. Long texts are hashed whole, CHUNK shingles at a
    time. Equal texts and repeated rows share a fingerprint, ties cannot matter. An empty table gives no rows; other columns
    are ignored. Rows of one fingerprint, and fingerprints of one component, are dealt over many tasks where they are many.
    """
    own = written(fingerprints(docs.select("doc_id", "text"), words), "fingerprints")
    classes = written(own.groupBy("fp").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("n")), "classes")
    roots = written(components(links(classes.select("fp"), radius).select("a", "b")).withColumnRenamed("node", "fp"), "roots")
    ids = classes.join(roots, "fp").groupBy("root").agg(F.min("lowest").alias("reached"))
    merged = salted_join(roots, ids, "root", roots.groupBy("root").agg(F.count("*").alias("n"))).select("fp", "reached")
    found = classes.join(merged, "fp", "left").select("fp", F.coalesce("reached", "lowest").alias("component_id"))
    named = salted_join(own, found, "fp", classes, salt=F.monotonically_increasing_id())
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

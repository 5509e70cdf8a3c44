"""Centroid clustering by Exponion search (operator 12): k-means in whole numbers, with exact ties.

Every vector carries two bounds from round to round: its distance to its centroid is at most ``upper``, that to any other at
least ``lower``. When centroids move, the bounds move with them. As long as ``upper`` stays below ``lower``, or below half of the
way from its centroid to the next one, the vector stays where it is, and nothing is computed. Else its distance is computed
anew; if that doesn't settle it, the only centroids that can be as near lie in the ball of radius 2 upper + (the way to the
next centroid) around its own. Each centroid has a list of the others by distance, so the ball is a beginning of that list. The
radius is inclusive, and bounds are rounded outwards, so that ties are seen and go to the smaller number.

Vectors are dealt to blocks once, by rows and not by keys, and written bucketed by block. A round is one job: each block
reads its vectors and its last state, without a shuffle, and writes its new state and what its centroids gained and lost. Only
those sums, a row for each centroid that changed in a block, are added up by Spark, and k sums reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.llm.common import Blocks, rows_as, settle
from finstrata.llm.integers import as_long, as_numbers, finite, fitting, floored, largest

#: A block's vectors (round -1) or its state after a round.
STATE = "block long, round int, ids binary, unnamed binary, vectors binary, cluster binary, upper binary, lower binary, gained array<long>"
ASSIGNED = "vec_id long, cluster int, distance long"
LIMB = 40  # sums travel in parts of so many bits, each of which Spark adds up exactly
OUT, IN = 1 + 1e-12, 1 - 1e-12  # outward rounding of bounds


@dataclass
class Centroids:
    """Centroids, how far each has moved since the last round, and for each the others by distance."""

    at: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        k = len(self.at)
        between = np.stack([roots(squared(self.at, c), up=False) for c in self.at])
        self.order = np.argsort(between, 1, kind="stable")
        self.order[np.arange(k), (self.order == np.arange(k)[:, None]).argmax(1)] = self.order[:, 0]  # equal centroids: itself first
        self.order[:, 0] = np.arange(k)
        self.ways = np.take_along_axis(between, self.order, 1)
        self.next = self.ways[:, 1] if k > 1 else np.full(k, np.inf)
        # the largest step of any other centroid
        last = np.argsort(self.moved)[::-1]
        self.others = np.full(k, self.moved[last[0]])
        self.others[last[0]] = self.moved[last[1]] if k > 1 else 0.0


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a centroid."""
    most = x.shape[-1] * (largest(x) + largest(c)) ** 2
    x, c = fitting(most, x, c)
    d = x - c
    exact = (d * d).sum(-1)
    return exact.astype(np.int64) if most < 2**53 else exact


def roots(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots as doubles, rounded up or down, also of whole numbers beyond all doubles."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64)) * (OUT if up else IN)
    whole = [math.isqrt(s) + up for s in squares.ravel().tolist()]
    return np.array([float(r) * (OUT if up else IN) if r < 2**1022 else math.inf if up else 2.0**1022 for r in whole]).reshape(squares.shape)


def to_all(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(rows, centroids): exact squared distances; by one product of matrices where doubles hold them exactly."""
    if x.shape[1] * (largest(x) + largest(centroids)) ** 2 < 2**52:
        x, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([squared(x, c) for c in centroids], 1)


def first_two(distances: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (rows, candidates): the nearest's number, ties to the smaller, and bounds of its distance and of the second (inf: none)."""
    by_number = np.argsort(numbers)
    distances, numbers = distances[:, by_number], numbers[by_number]
    best, rows = distances.argmin(1), np.arange(len(distances))
    least = roots(distances[rows, best], up=True)
    if len(numbers) == 1:
        return numbers[best], least, np.full(len(rows), np.inf)
    second = np.sort(distances, 1)[:, 1] if distances.dtype == object else np.partition(distances, 1, 1)[:, 1]
    return numbers[best], least, roots(second, up=False)


def searched(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: Centroids) -> int:
    """Settles cluster, upper and lower (changed in place) after the centroids moved; returns how many distances were computed."""
    upper += centroids.moved[cluster]
    upper *= OUT
    lower -= centroids.others[cluster]
    lower *= np.where(lower > 0, IN, OUT)
    safe = np.maximum(lower, centroids.next[cluster] / 2)
    open_ = np.flatnonzero(upper >= safe)
    computed = len(open_)
    for c in np.unique(cluster[open_]):
        at = open_[cluster[open_] == c]
        upper[at] = roots(squared(x[at], centroids.at[c]), up=True)
        at = at[upper[at] >= safe[at]]
        # so many of the list are within the ball; rounded up to powers of two, so that vectors share few lengths
        radius = (2 * upper[at] + centroids.next[c]) * (1 + 1e-11)
        within = np.searchsorted(centroids.ways[c], radius, side="right")
        within = np.minimum(1 << np.ceil(np.log2(np.maximum(within, 1))).astype(np.int64), len(centroids.at))
        for n in np.unique(within):
            mine, ball = at[within == n], centroids.order[c, :n]
            computed += len(mine) * n
            # what is outside of the ball is farther than the second
            cluster[mine], upper[mine], lower[mine] = first_two(to_all(x[mine], centroids.at[ball]), ball)
    return computed


def gains(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[int]:
    """What each centroid gained: cluster, limb, n and sums, one after the other; numbers are cut into limbs that Spark can add up."""
    changed = np.flatnonzero(before != after)
    x, before, after, found = x[changed], before[changed], after[changed], []
    x = x.astype(object) if len(x) * largest(x) >= 2**62 else x
    for c in np.union1d(before, after):
        if c < 0:
            continue
        sums = [int(s) for s in x[after == c].sum(0) - x[before == c].sum(0)]
        n, limb = int((after == c).sum() - (before == c).sum()), 0
        while limb == 0 or any(sums):
            # Python's & and >> floor, so a negative number ends at -1
            last = all(-(2**62) < s < 2**62 for s in sums)
            found += [int(c), limb, n if limb == 0 else 0, *(sums if last else [s & (2**LIMB - 1) for s in sums])]
            sums, limb = ([] if last else [s >> LIMB for s in sums]), limb + 1
    return found


def packed(key: int, turn: int, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, gained: list[int]) -> Any:
    """A block's state as a row."""
    import pyarrow as pa

    row = [key, turn, None, None, None, cluster.tobytes(), upper.tobytes(), lower.tobytes(), gained]
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, rows_as(STATE), strict=True)], schema=rows_as(STATE))


def gathered(key: tuple, vectors: Any) -> Any:
    """A block's vectors as one row."""
    import pyarrow as pa

    ids = vectors.column("vec_id")
    v = vectors.column("v").combine_chunks()
    unnamed = np.packbits(np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool))
    row = [key[0].as_py(), -1, np.asarray(ids.fill_null(0).to_numpy(), np.int64).tobytes(), unnamed.tobytes(), np.asarray(v.flatten()).tobytes(), None, None, None, None]
    return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, rows_as(STATE), strict=True)], schema=rows_as(STATE))


class Held:
    """The rows of a block: its vectors, as integers, and its last state."""

    def __init__(self, rows: Any, dims: int, kind: str, scale: int):
        self.rows = {r: i for i, r in enumerate(rows.column("round").to_pylist())}
        self.table = rows
        self.x = floored(np.frombuffer(self.raw("vectors", -1), kind).reshape(-1, dims), scale)

    def raw(self, name: str, turn: int) -> bytes:
        return self.table.column(name)[self.rows[turn]].as_py()

    def state(self, turn: int) -> list[np.ndarray]:
        return [np.frombuffer(self.raw(name, turn), t).copy() for name, t in (("cluster", np.int32), ("upper", np.float64), ("lower", np.float64))]


def turner(turn: int, centroids_of, dims: int, kind: str, scale: int):
    def turned(key: tuple, rows: Any) -> Any:
        """A block's state after a round."""
        held, centroids = Held(rows, dims, kind, scale), Centroids(*centroids_of.value)
        if turn == 0:
            before = np.full(len(held.x), -1, np.int32)
            cluster, upper, lower = first_two(to_all(held.x, centroids.at), np.arange(len(centroids.at)))
            cluster = cluster.astype(np.int32)
        else:
            cluster, upper, lower = held.state(turn - 1)
            before = cluster.copy()
            searched(held.x, cluster, upper, lower, centroids)
        return packed(key[0].as_py(), turn, cluster, upper, lower, gains(held.x, before, cluster))

    return turned


def answerer(turn: int, centroids_of, dims: int, kind: str, scale: int):
    def answered(key: tuple, rows: Any) -> Any:
        """Every vector's cluster and exact distance."""
        import pyarrow as pa

        held, at = Held(rows, dims, kind, scale), centroids_of.value[0]
        cluster, _, _ = held.state(turn)
        distance: list[int | None] = [None] * len(cluster)
        for c in np.unique(cluster):
            for i, d in zip(np.flatnonzero(cluster == c), squared(held.x[cluster == c], at[c]).tolist(), strict=True):
                distance[i] = as_long(d)
        unnamed = np.unpackbits(np.frombuffer(held.raw("unnamed", -1), np.uint8), count=len(cluster)).astype(bool)
        ids = pa.array(np.frombuffer(held.raw("ids", -1), np.int64), mask=unnamed)
        return pa.Table.from_arrays([ids, pa.array(cluster), pa.array(distance, pa.int64())], schema=rows_as(ASSIGNED))

    return answered


def next_centroids(at: np.ndarray, sums: list[list[int]], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Componentwise floor of the means, and how far each moved, rounded up; a centroid without vectors stays."""
    new = np.array([[s // n for s in row] if n else [int(v) for v in old] for row, n, old in zip(sums, counts, at, strict=True)], object)
    new = new.astype(np.int64) if largest(new) < 2**52 else new
    moved = np.array([0.0 if (a == b).all() else roots(squared(a[None], b), up=True)[0] for a, b in zip(new, at, strict=True)])
    return new, moved


def first_centroids(rows: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``; those without an id come last, ties in the vectors' order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    picks = rows.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return floored(np.array([r.v for r in picks], np.float64), scale)


def exponion(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, block: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """k-means over vectors floored to integers, floor(scale * x): vec_id, cluster, distance (squared) to it, cluster_inertia,
    inertia, centroid_sha256 (of the centroid's numbers, joined by commas).

    Centroids start as the k vectors with the smallest SHA-256 of ``seed:vec_id``, in that order. In each round every vector goes
    to its nearest centroid, ties to the smaller number, then centroids become the floored means of their vectors; those
    without vectors stay. Vectors are assigned once more in the end. The scale is a power of two.

    Vectors that are null, hold a null or a non-finite component, or haven't exactly ``dims`` components take no part and aren't
    returned. Repeated rows count each by itself. A vector without an id takes part, and starts as a centroid only where there
    are too few others; its id stays null. With fewer than k vectors there are as many centroids as vectors. Huge components
    are computed exactly too; a distance or an inertia that doesn't fit a long is null. Other columns are not read. An empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    number = as_numbers(vectors, vector_col)
    rows = vectors.filter(finite(vector_col) & (F.size(f"`{vector_col}`") == dims)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), number.alias("v"))
    kind = "<f4" if dict(rows.dtypes)["v"] == "array<float>" else "<f8"
    n = rows.count()
    if not n:
        return spark.createDataFrame([], f"{ASSIGNED}, cluster_inertia long, inertia long, centroid_sha256 string")
    at = first_centroids(rows, k, seed, scale)
    k = len(at)
    moved, sums, counts = np.zeros(k), [[0] * dims for _ in range(k)], [0] * k
    with Blocks(spark) as held:
        blocks = max(held.buckets, -(-n // block))
        dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
        held.add(dealt.groupBy("block").applyInArrow(gathered, STATE))
        last = 0
        for turn in range(rounds + 1):
            state = spark.table(held.name).filter(F.col("round").isin(-1, turn - 1))
            centroids_of = spark.sparkContext.broadcast((at, moved))
            after = held.add(state.groupBy("block").applyInArrow(turner(turn, centroids_of, dims, kind, scale), STATE))
            last = turn
            if turn == rounds:
                break
            changes = after.filter((F.col("round") == turn) & (F.size("gained") > 0))
            starts = F.sequence(F.lit(1), F.size("gained"), F.lit(dims + 3))
            gained = changes.select(F.explode(F.transform(starts, lambda i: F.slice("gained", i, dims + 3))).alias("g"))
            each = [F.sum(F.col("g")[i + 3].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)]
            of = (F.col("g")[0].alias("cluster"), F.col("g")[1].alias("limb"))
            for r in gained.groupBy(*of).agg(F.sum(F.col("g")[2]).alias("n"), *each).collect():  # k rows, and more only for huge numbers
                counts[r.cluster] += int(r.n)
                sums[r.cluster] = [s + (int(r[f"s{i}"]) << (LIMB * r.limb)) for i, s in enumerate(sums[r.cluster])]
            at, moved = next_centroids(at, sums, counts)
            if not any(moved):  # nothing can change any more
                break
        final = spark.table(held.name).filter(F.col("round").isin(-1, last))
        centroids_of = spark.sparkContext.broadcast((at, moved))
        assigned = settle(final.groupBy("block").applyInArrow(answerer(last, centroids_of, dims, kind, scale), ASSIGNED))
    return with_inertia(spark, assigned, at)


def with_inertia(spark: SparkSession, assigned: DataFrame, at: np.ndarray) -> DataFrame:
    """Adds the sums of distances; a sum is null if a distance is, or if it doesn't fit a long."""
    whole = F.sum(F.col("distance").cast("decimal(20,0)"))
    per = assigned.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), whole).alias("s"))
    totals = {r.cluster: r.s for r in per.collect()}  # a row for each centroid
    all_ = None if any(s is None for s in totals.values()) else as_long(int(sum(totals.values())))
    digest = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in at]
    rows = [(c, None if s is None else as_long(int(s)), all_, digest[c]) for c, s in totals.items()]
    found = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(found), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Exact top-k search by columnar branch-and-bound (operator 13): the largest inner products, in whole numbers.

Vectors lie in blocks, and a block lies by columns: all first components, then all second ones. A query adds up its products
with a block a few dimensions at a time, those with the most mass first. After each few, what the rest can still bring is at
most |rest of the query| x |rest of the vector|, as Cauchy and Schwarz say; vectors that can't reach the query's k-th best any
more go, the others are moved together, and the next dimensions are read for them alone. What is left in the end is exact. The
bound is inclusive, so that ties stay.

Queries come in blocks too. Each pair of a block of queries and a block of vectors is one task's work, which returns at most k rows a
query. Before, all queries meet one block, that of the largest vectors: the k-th best there is a floor for all other blocks,
and a block whose largest vector can't reach it isn't read by the query at all. What is shuffled is blocks and each
block's best; nothing passes the driver but counts and the mass of each dimension.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finstrata.llm.common import rows_as, settle
from finstrata.llm.integers import as_numbers, finite, fitting, floored, largest

FOUND = "query_row long, query_id long, row long, vec_id long, score decimal(38,0)"
COLUMNS = "part int, ids binary, rows binary, components binary, n long"
ASKED = "part int, vec_id long, row long, v binary, floor decimal(38,0)"
MOST = 10**38 - 1
OUT = 1 + 1e-9  # bounds are rounded up


def widened(flat: np.ndarray, lengths: np.ndarray, dims: int) -> np.ndarray:
    """(rows, dims): shorter vectors end in zeros, which change no inner product."""
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def columns_of(dims: int, scale: int):
    def laid(key: tuple, vectors: Any) -> Any:
        """A block's vectors by columns; ids rise, for ties."""
        import pyarrow as pa

        vectors = vectors.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        v = vectors.column("v").combine_chunks()
        x = widened(np.asarray(v.flatten(), np.float64), np.asarray(v.value_lengths(), np.int64), dims)
        ids, rows = (np.asarray(vectors.column(name).to_numpy(), np.int64) for name in ("vec_id", "row"))
        row = [key[0].as_py(), ids.tobytes(), rows.tobytes(), np.ascontiguousarray(x.T).tobytes(), len(ids)]
        return pa.Table.from_arrays([pa.array([c], f.type) for c, f in zip(row, rows_as(COLUMNS), strict=True)], schema=rows_as(COLUMNS))

    return laid


def kth_largest(values: np.ndarray, k: int) -> float | None:
    """None where there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


class Search:
    """Queries against one block of vectors."""

    def __init__(self, x: np.ndarray, q: np.ndarray, k: int, step: int):
        """x: (dims, vectors), q: (queries, dims), both integers."""
        dims = len(x)
        self.k = k
        self.x, self.q = fitting(max(1, dims) * largest(x) * largest(q), x, q)
        if self.x.dtype == object:  # no bounds in doubles: one step, which reads all
            self.steps = [np.arange(dims)]
            self.rests = [(np.full(x.shape[1], np.inf), np.full(len(q), np.inf)), (np.zeros(x.shape[1]), np.zeros(len(q)))]
            return
        mass = np.abs(self.x).max(1, initial=0).astype(np.float64) * np.abs(self.q).max(0, initial=0)
        order = np.argsort(-mass, kind="stable")
        self.steps = [order[i : i + step] for i in range(0, dims, step)]
        rest_x, rest_q = np.zeros(x.shape[1]), np.zeros(len(q))
        self.rests = [(rest_x, rest_q)]  # what is left after each step, from the last one back
        squares_x, squares_q = rest_x.copy(), rest_q.copy()
        for at in reversed(self.steps):
            squares_x = squares_x + (self.x[at].astype(np.float64) ** 2).sum(0)
            squares_q = squares_q + (self.q[:, at].astype(np.float64) ** 2).sum(1)
            self.rests.append((np.sqrt(squares_x) * OUT, np.sqrt(squares_q) * OUT))
        self.rests.reverse()

    def first(self, queries: np.ndarray) -> np.ndarray:
        """The first step, for many queries at once."""
        at = self.steps[0] if self.steps else np.zeros(0, np.int64)
        return self.q[np.ix_(queries, at)] @ self.x[at]

    def best(self, i: int, so_far: np.ndarray, least, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query i's k best (positions, scores), ties to smaller positions, of those that aren't out and reach ``least``."""
        alive, parts = np.flatnonzero(~out), so_far
        parts = parts[alive] if len(alive) < len(parts) else parts
        for step in range(1, len(self.steps) + 1):
            if parts.dtype == object:
                break
            rest_x, rest_q = self.rests[step]
            room = (rest_x if len(alive) == len(rest_x) else rest_x[alive]) * rest_q[i]
            done = parts.astype(np.float64)
            margin = 1e-9 * np.abs(done) if parts.dtype != np.float64 else 0.0  # doubles hold whole numbers exactly here
            low = kth_largest(done - room - margin, self.k)
            floor = max([float(x) * (1 - 1e-9 if x > 0 else 1 + 1e-9) for x in (low, least) if x is not None], default=-np.inf)
            stays = done + room + margin >= floor
            if not stays.all():
                alive, parts = alive[stays], parts[stays]
            if step < len(self.steps):
                at = self.steps[step]
                read = self.x[at] if len(alive) == self.x.shape[1] else self.x[np.ix_(at, alive)]
                parts = parts + self.q[i, at] @ read
        order = np.argsort(-parts, kind="stable")[: self.k]  # positions rise
        return alive[order], parts[order]


def searcher(scale: int, dims: int, k: int, step: int, group: int = 32):
    def searched(key: tuple, blocks: Any, queries: Any) -> Any:
        """For each query of a block the k best of a block of vectors, those below the query's floor left out."""
        import decimal

        import pyarrow as pa

        found: list[tuple] = []
        q_ids, q_rows, floors = (queries.column(c).to_pylist() for c in ("vec_id", "row", "floor"))
        q = floored(np.frombuffer(bytearray().join(queries.column("v").to_pylist()), np.float64).reshape(len(queries), dims), scale)
        for ids, rows, components in zip(*(blocks.column(c) for c in ("ids", "rows", "components")), strict=True):
            ids, rows = (np.frombuffer(v.as_py(), np.int64) for v in (ids, rows))
            x = floored(np.frombuffer(bytearray(components.as_py()), np.float64).reshape(dims, len(ids)), scale)
            search = Search(x, q, k, step)
            whole_x, whole_q = search.rests[0]
            reach = whole_q * whole_x.max(initial=0)
            able = np.array([i for i in range(len(q)) if floors[i] is None or reach[i] >= float(floors[i]) * (1 - 1e-9)], np.int64)
            for start in range(0, len(able), group):
                some = able[start : start + group]
                for i, so_far in zip(some, search.first(some), strict=True):
                    least = None if floors[i] is None or abs(floors[i]) >= MOST else int(floors[i])
                    at, scores = search.best(i, so_far, least, rows == q_rows[i])
                    found += [(q_rows[i], q_ids[i], int(rows[j]), int(ids[j]), decimal.Decimal(min(MOST, max(-MOST, int(s))))) for j, s in zip(at, scores, strict=True)]
        schema = rows_as(FOUND)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * len(schema), schema, strict=True)], schema=schema)

    return searched


def as_bytes(dims: int):
    def laid(batches):
        """The queries' vectors as bytes, as wide as all."""
        import pyarrow as pa

        schema = rows_as(ASKED)
        for batch in batches:
            v = batch.column("v")
            x = widened(np.asarray(v.flatten(), np.float64), np.asarray(v.value_lengths(), np.int64), dims)
            wide = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([wide if f.name == "v" else batch.column(f.name) for f in schema], schema=schema)

    return laid


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, step: int = 8, group: int = 16_384, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k largest inner products among all other rows, vectors floored to integers, floor(scale * x): query_id, rank
    (from 1), vec_id, score. Exact.

    Queries are the rows of which ``is_query`` (a function of the id's column) holds. Ties go to the smaller vec_id, then to the
    earlier row. With fewer than k candidates all are returned. The scale is a power of two.

    Vectors that are null or hold a null or a non-finite component take no part, nor do rows without an id. Of rows with one id
    each takes part by itself, as query and as candidate of the others. A vector of fewer components than another counts as if
    it ended in zeros; an empty one scores 0 with all. Huge components are computed exactly; a score that doesn't fit a long is
    null, and beyond 38 digits scores count as equal. Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    usable = F.col(f"`{id_col}`").isNotNull() & finite(vector_col)
    rows = vectors.filter(usable).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), as_numbers(vectors, vector_col).alias("v"))
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    asked = rows.filter(is_query(F.col("vec_id")))
    n, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_queries = asked.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups, blocks = -(-n // group), -(-n_queries // block)
    # the first block holds the largest vectors, the others come by rows
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    largest_rows = rows.select("row", norm.alias("norm")).orderBy(F.desc("norm"), "row").limit(min(group, -(-n // 2)))
    dealt = lambda df, name, parts: df.withColumn(name, F.pmod(F.xxhash64("row", F.lit(name)), F.lit(parts)).cast("int"))
    parted = dealt(rows, "part", groups).join(largest_rows.select("row", F.lit(True).alias("top")), "row", "left")
    parted = parted.withColumn("part", F.when(F.col("top"), -1).otherwise(F.col("part"))).select("part", "vec_id", "row", "v")
    laid = settle(parted.groupBy("part").applyInArrow(columns_of(dims, scale), COLUMNS))
    none = F.lit(None).cast("decimal(38,0)").alias("floor")
    queries = settle(dealt(asked, "part", blocks).select("part", "vec_id", "row", "v", none).mapInArrow(as_bytes(dims), ASKED))
    search = searcher(scale, dims, k, step)
    best = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")).cast("int")).filter(F.col("rank") <= k)

    def met(first: int, last: int, queries: DataFrame) -> DataFrame:
        """The best of each pair of a block of queries and one of these blocks of vectors."""
        each = lambda lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi)))
        spread = laid.filter(F.col("part").between(first, last)).withColumnRenamed("part", "group").withColumn("part", each(0, blocks - 1))
        to = queries.withColumn("group", each(first, last))
        return spread.groupBy("group", "part").cogroup(to.groupBy("group", "part")).applyInArrow(search, FOUND)

    seeds = settle(met(-1, -1, queries))
    floors = best(seeds).filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("floor"))
    floored_ = queries.drop("floor").join(floors, "row", "left").select("part", "vec_id", "row", "v", "floor")
    found = seeds.unionByName(met(0, groups - 1, floored_))
    return best(found).select("query_id", "rank", "vec_id", F.expr("try_cast(score as long)").alias("score"))

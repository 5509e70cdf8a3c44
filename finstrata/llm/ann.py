"""Nearest neighbours by score-aware anisotropic quantisation (operator 4).

Vectors are cut into short subvectors, each replaced by one of 16 codewords: four bits. Codewords are fitted, and chosen, not
for the least error but for the least harm to high inner products: the part of the error that is parallel to the vector costs
more than the rest. A query's inner products with all codewords are a small table; scanning the codes adds up its
entries. A vector's own error is kept beside its codes: it says how far from the scan's sum the cosine can be. The best of the
scan are ranked by exact cosine, and so are all others that can still be among the nearest, so none is missed however the vectors lie.

The codebooks are fitted on a bounded sample. All vectors are encoded once, in groups of a bounded size; queries come in blocks
of a bounded size. Each pair of a block and a group is a task's work: it scans the group's codes for the block's queries, and returns
for each query the group's nearest. Nothing but the sample passes the driver.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finstrata.llm.common import rows_as, settle

CODED = "group int, ids binary, rows binary, codes binary, errors binary, vectors binary"
NEAR = "query_row long, query_id long, row long, vec_id long, score double"
CODES = 16
SLACK = 1e-4  # more than what sums of floats are wrong by


def cost_of_parallel(dims: int, threshold: float) -> float:
    """How much more the parallel part of the error costs, for inner products of unit vectors above the threshold."""
    return (dims - 1) * threshold**2 / (1 - threshold**2)


def subvectors(x: np.ndarray, width: int) -> np.ndarray:
    """(rows, subvectors, width), with zeros at the end where the width doesn't divide the dimensions."""
    pad = -x.shape[1] % width
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, width)


def encode(x: np.ndarray, books: np.ndarray, eta: float, rounds: int = 3) -> np.ndarray:
    """Codes (rows, subvectors) of unit vectors: coordinate descent on |error|^2 + (eta - 1) (error . x)^2."""
    parts = subvectors(x, books.shape[2])
    squares = ((parts[:, :, None, :] - books[None]) ** 2).sum(3)  # (rows, subvectors, codes)
    along = ((parts[:, :, None, :] - books[None]) * parts[:, :, None, :]).sum(3)
    codes = squares.argmin(2)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(rounds):
        for j in range(codes.shape[1]):
            rest = total - along[rows, j, codes[:, j]]
            codes[:, j] = (squares[:, j] + (eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
            total = rest + along[rows, j, codes[:, j]]
    return codes


def fit_books(sample: np.ndarray, width: int, eta: float, rounds: int = 8) -> np.ndarray:
    """Codebooks (subvectors, 16, width) of unit vectors: codes and codewords are fitted in turn.

    Given the codes, a codeword's best value solves a linear system: errors of its rows, their parallel parts weighed eta.
    """
    parts = subvectors(sample, width)
    random = np.random.default_rng(4)
    picks = random.permutation(len(sample))[np.arange(CODES) % len(sample)]
    books = parts[picks].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        codes = encode(sample, books, eta, 2)
        rebuilt = np.stack([books[j, codes[:, j]] for j in range(len(books))], 1)
        along = ((parts - rebuilt) * parts).sum(2)
        total = along.sum(1)
        for j in range(len(books)):
            rest = total - along[:, j]
            for c in range(CODES):
                at = np.flatnonzero(codes[:, j] == c)
                if not len(at):
                    continue
                p = parts[at, j]
                left = len(at) * np.eye(width) + (eta - 1) * p.T @ p + 1e-9 * np.eye(width)
                right = p.sum(0) + (eta - 1) * (p * (rest[at] + (p * p).sum(1))[:, None]).sum(0)
                books[j, c] = np.linalg.solve(left, right)
            along[:, j] = ((parts[:, j] - books[j, codes[:, j]]) * parts[:, j]).sum(1)
            total = rest + along[:, j]
    return books


def best_of(values: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the largest values, ties to smaller ids, which come in rising order; in no order themselves."""
    if len(values) <= most:
        return np.arange(len(values))
    least = np.partition(values, len(values) - most)[len(values) - most]
    above = np.flatnonzero(values > least)
    return np.concatenate([above, np.flatnonzero(values == least)[: most - len(above)]])


def matrix(arrays) -> np.ndarray:
    """The rows of a column of arrays of one length, as doubles."""
    flat = np.asarray(arrays.combine_chunks().flatten() if hasattr(arrays, "combine_chunks") else arrays.flatten(), np.float64)
    return flat.reshape(len(arrays), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows multiplied by powers of two so that their largest component is about 1: squares neither vanish nor overflow, and
    cosines stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x**2).sum(1))[:, None]


def encoder(books_of, eta: float, kind: str):
    def encoded(key: tuple, vectors: Any) -> Any:
        """A group's ids, codes (two in a byte), sizes of the errors and vectors, as one row. Ids rise, for ties."""
        import pyarrow as pa

        vectors = vectors.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        given, books = matrix(vectors.column("v")), books_of.value
        x = units(given)
        codes = encode(x, books, eta).astype(np.uint8)
        errors = sum(((part - books[j, codes[:, j]]) ** 2).sum(1) for j, part in enumerate(subvectors(x, books.shape[2]).transpose(1, 0, 2))) ** 0.5
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        packed = codes[:, ::2] | codes[:, 1::2] << 4
        ids, rows = (np.asarray(vectors.column(c).to_numpy(), np.int64).tobytes() for c in ("vec_id", "row"))
        values = (key[0].as_py(), ids, rows, packed.tobytes(), errors.astype(np.float32).tobytes(), given.astype(kind).tobytes())
        return pa.Table.from_arrays([pa.array([c], f.type) for c, f in zip(values, rows_as(CODED), strict=True)], schema=rows_as(CODED))

    return encoded


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of one scaled vector with scaled rows."""
    return (q * v).sum(1) / (np.sqrt((q**2).sum()) * np.sqrt((v**2).sum(1)))


def scanner(books_of, k: int, first: int, kind: str):
    def scanned(key: tuple, groups: Any, queries: Any) -> Any:
        """For each query of a block the k nearest of a group; ties to smaller ids."""
        import pyarrow as pa

        books, found = books_of.value, []
        if not len(queries):
            return rows_as(NEAR).empty_table()
        asked = scaled(matrix(queries.column("v")))
        lengths = np.sqrt((asked**2).sum(1))
        for ids, rows, packed, errors, vectors in zip(*(groups.column(c) for c in ("ids", "rows", "codes", "errors", "vectors")), strict=True):
            ids, rows, errors = (np.frombuffer(v.as_py(), t) for v, t in ((ids, np.int64), (rows, np.int64), (errors, np.float32)))
            given = scaled(np.frombuffer(vectors.as_py(), kind).reshape(len(ids), -1).astype(np.float64))
            unit = given / np.sqrt((given**2).sum(1))[:, None]
            pairs = np.frombuffer(packed.as_py(), np.uint8).reshape(len(ids), -1)
            codes = np.ascontiguousarray(np.stack([pairs & 15, pairs >> 4], 2).reshape(len(ids), -1)[:, : len(books)].T)
            for q, length, query, query_id in zip(asked, lengths, queries.column("row").to_numpy(), queries.column("vec_id").to_numpy(), strict=True):
                q1 = q / length
                table = np.einsum("jw,jcw->jc", subvectors(q1[None], books.shape[2])[0], books).astype(np.float32)
                near = np.zeros(len(ids), np.float32)
                for entries, column in zip(table, codes, strict=True):
                    near += entries[column]
                near[rows == query] = -np.inf
                at = best_of(near, ids, first)
                sure = unit[at[near[at] > -np.inf]] @ q1
                floor = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else -np.inf
                # a cosine is no farther from the scan's sum than the vector's error is long
                at = np.flatnonzero((near + errors >= floor - SLACK) & (near > -np.inf))
                dots = (unit @ q1)[at] if 4 * len(at) > len(ids) else unit[at] @ q1
                if len(at) > k:
                    at = at[dots >= np.partition(dots, len(dots) - k)[len(dots) - k] - SLACK * SLACK]
                score = cosines(q, given[at])
                best = best_of(score, ids[at], k)
                at, score = at[best], score[best]
                found.append((np.full(len(at), query, np.int64), np.full(len(at), query_id, np.int64), rows[at], ids[at], score))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[] for _ in rows_as(NEAR)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, rows_as(NEAR), strict=True)], schema=rows_as(NEAR))

    return scanned


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part; floats stay floats, all other numbers are doubles."""
    column = F.col(f"`{vector_col}`")
    floats = vectors.select(column).schema[0].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), (column if floats else column.cast("array<double>")).alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 5, width: int = 2, threshold: float = 0.2, rerank: int = 64, sample: int = 10_000, group: int | None = None, block: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest by cosine among all other rows: query_id, rank (from 1), vec_id, score (exact, double).

    Queries are the rows of which ``is_query`` (a function of the id's column) holds; a query isn't its own neighbour. Ties go to
    the smaller vec_id; with fewer than k candidates, all are returned. In each group of vectors the ``rerank`` best by the codes say how near
    the k-th is at least; all whose codes and error leave room for more are ranked exactly, so the result is exact. Where vectors lie so
    that codes say little, that may be the whole group. Groups and blocks without a given size hold about 2**20 and 2**22 components.

    Vectors that are null, empty, all zero, or hold a null or a non-finite component take no part, nor do rows without an id or
    with another number of dimensions than most have (of as common numbers, the smallest). Of rows with the same id each takes part
    by itself, as query and as candidate of the others. Tiny and huge components are as good as others. Other columns are not read.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "float32" if rows.schema["v"].dataType.simpleString() == "array<float>" else "float64"
    rows = settle(rows.filter(F.size("v") == common["n"]).withColumn("row", F.monotonically_increasing_id()))
    fitted = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(sample).toArrow().column("v"))
    eta = max(1.0, cost_of_parallel(common["n"], threshold))
    books = spark.sparkContext.broadcast(fit_books(units(fitted), width, eta))

    queries = rows.filter(is_query(F.col("vec_id")))
    n, n_queries = rows.count(), queries.count()
    sized = lambda components, most: min(most, max(512, components // common["n"]))
    # small tables are cut further, so that all cores have work
    groups = -(-n // group) if group else max(-(-n // sized(1 << 20, 16_384)), min(spark.sparkContext.defaultParallelism, -(-n // 2048)))
    blocks = max(1, -(-n_queries // (block or sized(1 << 22, 16_384))))
    dealt = lambda df, name, parts: df.withColumn(name, F.pmod(F.xxhash64("row", F.lit(name)), F.lit(parts)).cast("int"))
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    coded = settle(dealt(rows, "group", groups).groupBy("group").applyInArrow(encoder(books, eta, kind), CODED))
    work = coded.withColumn("block", each(blocks)).groupBy("group", "block")
    asked = dealt(queries, "block", blocks).withColumn("group", each(groups)).groupBy("group", "block")
    found = work.cogroup(asked).applyInArrow(scanner(books, k, max(k, rerank), kind), NEAR)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Parquet tables that are changed in whole steps, with a filter of keys for each file.

A table is a folder of data files and a list of those that count. A write makes new files and then a new list; the list's rename is the
step at which the table changes, so a write that fails leaves the table as it was. The list holds a Bloom filter of each file's
keys: rows that come again are looked for in files that may hold them, and a small batch reads few files or none. One
writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.plans.tables import settle

LISTED = "file string, rows long, bits binary"
BITS_A_KEY, PROBES = 10, 7  # one wrong answer in a hundred
LARGE = 2_000_000  # batches of more keys aren't sent to all tasks: they are looked for in all files


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def version(spark: SparkSession, path: str) -> int:
    """The number of the list that counts; 0: there is no table."""
    fs, where = file_system(spark, f"{path}/_list")
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return max([0, *(int(n) for n in names if n.isdigit())])


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The files of the table, with their numbers of rows and filters."""
    n = version(spark, path)
    return spark.read.schema(LISTED).parquet(f"{path}/_list/{n:08d}") if n else spark.createDataFrame([], LISTED)


def read(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame | None:
    """The table, or some of its files; None if there are none."""
    files = [r.file for r in listed(spark, path).select("file").collect()] if files is None else files
    return spark.read.parquet(*files) if files else None


def cells(hashes: np.ndarray, size: int) -> np.ndarray:
    """(probes, keys): the bits of a filter of 2**size bits that each key sets."""
    hashes = hashes.astype(np.int64).view(np.uint64)
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    return (hashes + np.arange(PROBES, dtype=np.uint64)[:, None] * step) & np.uint64((1 << size) - 1)


def filter_of(hashes: np.ndarray) -> bytes:
    size = max(6, int(np.ceil(np.log2(max(1, BITS_A_KEY * len(hashes))))))
    bits = np.zeros(1 << size, bool)
    bits[cells(hashes, size).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which keys a filter lets pass: all that it was made of, and a few others."""
    words = np.frombuffer(bits, np.uint8)
    at = cells(hashes, int(np.log2(8 * len(words))))
    return ((words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)


def described(key: tuple, rows: Any) -> Any:
    """A file's entry in the list."""
    import pyarrow as pa

    hashes = rows.column("hash").to_numpy()
    return pa.table({"file": [key[0].as_py()], "rows": pa.array([len(hashes)], pa.int64()), "bits": pa.array([filter_of(hashes)], pa.binary())})


def hashed(keys: list[str]):
    return F.xxhash64(*keys).alias("hash")


def candidates(rows: DataFrame, files: DataFrame, keys: list[str]) -> list[str]:
    """Files that may hold any of the rows' keys."""
    found = rows.select(hashed(keys)).limit(LARGE + 1).toArrow().column("hash").to_numpy()
    if len(found) > LARGE:
        return [r.file for r in files.select("file").collect()]
    wanted = rows.sparkSession.sparkContext.broadcast(found)  # 16 MB at most

    def probed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            held = [may_hold(bits.as_py(), wanted.value).any() for bits in batch.column("bits")]
            yield pa.RecordBatch.from_pydict({"file": batch.column("file").filter(pa.array(held, pa.bool_()))})

    return [r.file for r in files.mapInArrow(probed, "file string").collect()]


def commit(rows: DataFrame | None, path: str, keys: list[str], kept: DataFrame, spark: SparkSession, in_file: int = 5_000_000) -> int:
    """Writes rows (if any) as new files, and makes them and the kept files the table; returns how many rows were written."""
    n, files = 0, kept
    if rows is not None:
        data = f"{path}/data-{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", in_file).parquet(data)
        written = spark.read.schema(rows.schema).parquet(data).select(F.input_file_name().alias("file"), hashed(keys))
        new = settle(written.groupBy("file").applyInArrow(described, LISTED))
        n = int(new.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
        files = kept.unionByName(new)
    last = version(spark, path)
    staged = f"{path}/_list/.staged-{uuid.uuid4().hex}"
    files.coalesce(1).write.parquet(staged)
    fs, target = file_system(spark, f"{path}/_list/{last + 1:08d}")
    if fs.exists(target) or not fs.rename(file_system(spark, staged)[1], target):
        raise RuntimeError(f"another writer has changed {path}")
    return n


def append(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Adds rows as they are."""
    spark = rows.sparkSession
    return commit(rows, path, keys, listed(spark, path), spark)


def overwrite(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Replaces the table."""
    spark = rows.sparkSession
    return commit(rows, path, keys, spark.createDataFrame([], LISTED), spark)


def insert_if_absent(rows: DataFrame, path: str, key: str = "id", most: int | None = None) -> int:
    """Adds rows whose key isn't there yet, each key once, and returns their number; a second run adds none.

    ``most``: the table's rows don't become more than so many; of a batch that is too large those with the smallest keys are taken.
    """
    spark = rows.sparkSession
    batch, files = settle(rows.dropDuplicates([key])), listed(rows.sparkSession, path)
    known = read(spark, path, candidates(batch, files, [key]) or []) if version(spark, path) else None
    fresh = batch if known is None else batch.join(known.select(key), key, "left_anti")
    if most is not None:
        room = most - int(files.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
        fresh = fresh.orderBy(key).limit(max(0, room))
    fresh = settle(fresh)
    return commit(fresh, path, [key], files, spark) if fresh.take(1) else 0


def upsert(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Replaces the rows of the same keys, or adds new ones; returns how many rows were written. Only files that may hold one of
    the keys are written anew."""
    spark = rows.sparkSession
    batch, files = settle(rows.dropDuplicates(keys)), listed(rows.sparkSession, path)
    old = candidates(batch, files, keys)
    known = read(spark, path, old)
    whole = batch if known is None else known.join(batch.select(*keys), keys, "left_anti").select(*batch.columns).unionByName(batch)
    gone = spark.createDataFrame([(f,) for f in old], "file string")
    return commit(whole, path, keys, settle(files.join(gone, "file", "left_anti")), spark)


def rows_in(spark: SparkSession, path: str) -> int:
    return int(listed(spark, path).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])

"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> Column:
    """The whole text as UTF-8 bytes; a null text counts as an empty one."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")


def texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the id and the text, under names that no other column of ``docs`` can clash with."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), utf8(text_col).alias("body"), *more)


def carried(docs: DataFrame, columns: tuple[str, ...]) -> tuple[Column, str]:
    """A struct of the columns that go along with a row, and its type; a struct of nothing becomes a null."""
    if not columns:
        return F.lit(None).cast("boolean").alias("carried"), "boolean"
    struct = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("carried")
    return struct, docs.select(struct).schema["carried"].dataType.simpleString()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Where it is unset, a temporary folder does in local mode; a cluster has none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="finstrata-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and reads it from the shared folder from then on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Like settle(), but as Parquet, so that later reads prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def block(megabytes: int) -> Column:
    """Deals a task's rows (``_row``) to blocks; one block holds about so many MB of the files that are read."""
    number, unit = re.match(r"(\d+)\s*([kmgt]?)", SparkSession.active().conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    parts = max(1, (int(number) << " kmgt".index(unit or " ") * 10) // (megabytes << 20))
    return F.spark_partition_id().cast("long") * parts + F.pmod(F.xxhash64("_row"), F.lit(parts))


class Blocks:
    """A table bucketed by ``block``, so that cogroups by block don't shuffle it; ``with`` ends its entry in the catalogue.

    The files stay, and DataFrames made within go on reading them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, f"blocks_{uuid.uuid4().hex}"
        self.path, self.buckets = f"{shared_dir(spark)}/{self.name}", int(spark.conf.get("spark.sql.shuffle.partitions"))

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *error) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, rows: DataFrame) -> DataFrame:
        """Writes rows, of which each task holds few blocks, beside those that are there; returns all."""
        rows.write.mode("append").bucketBy(self.buckets, "block").option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        return self.spark.table(self.name)

    def add_dealt(self, rows: DataFrame) -> DataFrame:
        return self.add(rows.repartition(self.buckets, "block"))


def rows_as(schema: str):
    """The Arrow schema of a DDL string of plain types, for the batches that a mapInArrow function yields."""
    import pyarrow as pa

    plain = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "decimal(38,0)": pa.decimal128(38, 0)}
    plain |= {f"array<{name}>": pa.list_(kind) for name, kind in plain.items()}
    return pa.schema([(name, plain[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def bitmap(hashes: DataFrame, column: str, bits: int):
    """A NumPy bitmap of the hashes' top ``bits`` bits, of 2**bits / 8 bytes however many hashes there are; see marked()."""
    import numpy as np

    cell = F.shiftrightunsigned(column, 64 - bits)
    words = hashes.groupBy(F.shiftright(cell, 6).cast("int").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int)))").alias("b")).toArrow()
    found = np.zeros(1 << (bits - 6), np.int64)
    found[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return found.view(np.uint64)


def marked(bitmap, hashes, bits: int):
    """Which of the (unsigned) hashes the bitmap lets pass: all that it was made of, and a few others."""
    import numpy as np

    cell = hashes >> np.uint64(64 - bits)
    return (bitmap[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) > 0


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"

"""A corpus-cleaning pipeline: five stages, each of them one operator over all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.llm.common import table, written
from finstrata.llm.decontamination import decontaminate
from finstrata.llm.near_join import near_join
from finstrata.llm.packing import pack
from finstrata.llm.quality import score_quality
from finstrata.llm.queries import tokenizer
from finstrata.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of their own, also where ids are null or repeated; rows with the same id and text share one."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row_key"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good ones."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"), carry=COLUMNS)
    return scored.filter("keep").select("carried.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that Jaccard links hold together, the one with the smallest id, a null last; of rows with
    one id and text, one."""
    rows = keyed(docs)
    linked = near_join(rows, id_col="row_key").filter("n_links > 0").select(F.col("doc_id").alias("row_key"), "class_id")
    ids = rows.select("row_key", "doc_id").join(linked, "row_key")
    first = ids.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("f")).select("f.row_key")
    copies = linked.select("row_key").join(first, "row_key", "left_anti")
    return rows.join(copies, "row_key", "left_anti").dropDuplicates(["row_key"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur more than once."""
    kept = substring_dedup(docs, carry=("lang", "source", "n_chars"), one_space=False)
    text = F.col("kept").cast("string")
    chars = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("carried.n_chars"))
    return kept.select("doc_id", text.alias("text"), "carried.lang", "carried.source", chars.cast("long").alias("n_chars"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item."""
    rows = keyed(docs)
    held = decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col="row_key").select(F.col("doc_id").alias("row_key")).distinct()
    return rows.join(held, "row_key", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    pieces = pack(docs, tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("leaks", leaks), ("packed", packed)]

#: SQL can express neither a trained classifier nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

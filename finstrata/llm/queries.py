"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.llm import oracles
from finstrata.llm.ann import nearest
from finstrata.llm.clustering import exponion
from finstrata.llm.collocations import collocations
from finstrata.llm.common import table
from finstrata.llm.decontamination import decontaminate
from finstrata.llm.html_text import extract_text
from finstrata.llm.license_scan import scan_licenses
from finstrata.llm.lm_scoring import lm_scores
from finstrata.llm.near_join import near_join
from finstrata.llm.packing import pack
from finstrata.llm.quality import score_quality
from finstrata.llm.substring_dedup import substring_dedup
from finstrata.llm.token_counts import token_counts
from finstrata.llm.top_k import exact_top_k


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scores = lm_scores(table(spark, sf_dir, "documents"), trains=~held_out)
    return scores.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op4_anisotropic_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), is_query=lambda vec_id: vec_id % 50 == 0)


def op5_two_pass_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_seed_and_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("_row", "doc_row")


def op7_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("_row", "spans")


def op9_minhash_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(table(spark, sf_dir, "documents")).drop("row_key")


def op10_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op11_positional_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion(table(spark, sf_dir, "embeddings"))


def op13_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), is_query=lambda vec_id: vec_id % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_suffix_tree_dedup": oracles.SUBSTRING_DEDUP, "op9_minhash_jaccard_join": oracles.JACCARD_JOIN,
        "op11_positional_lists": oracles.COLLOCATIONS, "op12_exponion": oracles.centroids(), "op13_branch_and_bound": oracles.TOP_PRODUCTS,
    }

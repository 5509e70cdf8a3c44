"""Texts of some megabytes beside short ones, and that all operators are registered."""

import random
import re

import pytest

import __spark_entry__ as entry
from finstrata.llm import queries as Q
from finstrata.llm.decontamination import decontaminate
from finstrata.llm.lm_scoring import lm_scores
from finstrata.llm.near_join import near_join
from finstrata.llm.packing import pack
from finstrata.llm.quality import score_quality
from finstrata.llm.substring_dedup import substring_dedup
from finstrata.llm.token_counts import token_counts


def test_all_operators_are_registered():
    names = {n for n in entry.queries() if re.match(r"op\d+_", n)}
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names} == set(range(1, 14)) and len(names) == 13
    assert "pipeline" in entry.queries()
    assert {n for n in entry.oracle_sql() if re.match(r"op\d+_", n)} == {n for n in names if int(re.match(r"op(\d+)_", n)[1]) in (7, 9, 11, 12, 13)}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = [f"w{int(50_000 * rng.random() ** 3)}" for _ in range(900_000)]
    item = [f"item{i}" for i in range(30)]
    words[700_000:700_030] = item
    return " ".join(words), " ".join(item), len(words)


def test_a_text_of_megabytes(spark, documents, texts):
    long, item, n = texts
    assert len(long) > 5_000_000
    docs = documents(long, "short text of some words", item, long, "another short text of some words")
    assert {r.doc_id: r.n_tokens for r in lm_scores(docs, trains=docs.doc_id != 1).collect()} == {0: n + 1, 1: 6, 2: 31, 3: n + 1, 4: 7}
    found = decontaminate(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.score, r.doc_start) for r in found} == {(0, 1.0, 700_000), (2, 1.0, 0), (3, 1.0, 700_000)}
    joined = {r.doc_id: (r.class_id, r.n_links) for r in near_join(docs).collect()}
    assert joined[0] == joined[3] == (0, 1) and joined[1] == (1, 0)
    kept = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(docs).collect()}
    assert kept == {0: (n, n), 1: (5, 0), 2: (30, 0), 3: (n, n), 4: (6, 0)}
    assert token_counts(docs, Q.tokenizer("piece_bpe_32k.model")).count() > 0
    pieces = {r.doc_id: r.n for r in pack(docs, Q.tokenizer("word_bpe_49k.json")).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert pieces[0] == pieces[3] > n
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert score_quality(docs, labels).count() == 5

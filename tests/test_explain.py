"""Explanations of the default scorer, against copies of texts and against all orders of words."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from finstrata.functions.lexicons import LABELS, NEGATIVE_WORDS, POSITIVE_WORDS
from finstrata.functions.sentiment import keyword_scorer, keyword_shares
from finstrata.operators import explain as X

TEXTS = ["Strong profit, strong growth; no loss", "crash", "nothing here", "", None, "gain-loss Gains GAIN gain: losses! up", "weak weak risk strong-growth x y z", "été profit2 profit_ it's risk's"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    words = ["strong", "loss", "the", "Risk,", "growth", "x", "gain-loss", "up", "profit", "weak!"]
    return spark.createDataFrame(list(enumerate(TEXTS + [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 12, 40, 300)])), "k long, t string")


def test_shares_are_those_of_the_scorer(spark):
    pairs = list(itertools.product(range(12), range(12)))
    texts = spark.createDataFrame([(i, " ".join(POSITIVE_WORDS[:g] + NEGATIVE_WORDS[:b])) for i, (g, b) in enumerate(pairs)], "k long, t string")
    got = keyword_scorer(texts, "t").orderBy("k").select(*(f"score_{x}" for x in LABELS)).toPandas().to_numpy()
    assert (keyword_shares(*np.array(pairs).T) == got).all()


def test_weights_are_those_of_scored_copies(spark, rows):
    copies = lambda frame, text: keyword_scorer(frame, text)
    got, want = (X.explain(rows, "k", "t", scorer, samples=150).toPandas().sort_values(["k", "token", "weight"]).reset_index(drop=True) for scorer in (keyword_scorer, copies))
    assert got[["k", "token", "predicted_class"]].equals(want[["k", "token", "predicted_class"]]) and len(got) > 40
    assert np.allclose(got["weight"], want["weight"], atol=1e-6)
    assert set(got["k"]) == set(range(12)) - {3, 4}


def shares(held):
    words = {w for at in held for w in at}
    good = sum(w in X.GOOD for w in words)
    return keyword_shares(np.array([good]), np.array([len(words) - good]))[0]


def orders(lo, hi):
    """All orders of the tokens in which the two halves of each part stay together."""
    if hi - lo == 1:
        return [[lo]]
    middle = (lo + hi) // 2
    return [x for a in orders(lo, middle) for b in orders(middle, hi) for x in (a + b, b + a)]


@pytest.mark.parametrize("seed", range(4))
def test_owen_values_against_all_orders(seed):
    rng = random.Random(seed)
    held = [rng.sample(["strong", "growth", "profit", "loss", "risk", "weak"], rng.choice([0, 1, 1, 2])) for _ in range(10 if seed else 1)]
    every, sums = orders(0, len(held)), np.zeros((len(held), 3))
    for order in every:
        for n, i in enumerate(order):
            sums[i] += shares([held[j] for j in order[: n + 1]]) - shares([held[j] for j in order[:n]])
    got = X.owen(held)
    assert all(np.allclose(got.get(i, 0), sums[i] / len(every)) for i in range(len(held)))


def test_attributions_sum_to_the_difference(spark, rows):
    sums = X.attributions(rows, "k", "t").groupBy("k").agg(*(F.sum(x).alias(x) for x in LABELS)).toPandas().set_index("k")
    scored = keyword_scorer(rows, "t").select("k", *(f"score_{x}" for x in LABELS)).toPandas().set_index("k")
    empty = keyword_shares(np.array([0]), np.array([0]))[0]
    for k, row in scored.iterrows():
        total = sums.loc[k].to_numpy() if k in sums.index else np.zeros(3)
        assert np.allclose(total, row.to_numpy() - empty, atol=1e-9)
    assert X.attributions(rows.filter("k in (2, 3, 4)"), "k", "t").count() == 0


def test_a_long_text_ends_soon(spark):
    import time

    rng = random.Random(0)
    held = [[rng.choice(POSITIVE_WORDS + NEGATIVE_WORDS)] if rng.random() < 0.05 else [] for _ in range(20_000)]
    began = time.perf_counter()
    values = X.owen(held)
    assert time.perf_counter() - began < 60 and np.allclose(sum(values.values()), shares(held) - shares([]))


def test_only_tokens_with_lexicon_words_are_looked_at(spark):
    found = spark.createDataFrame([(1, "x " * 5_000 + "Gain-loss, gain y"), (2, "x"), (3, None)], "k long, t string").select("k", X.lexicon_words(F.col("t")).alias("held")).collect()
    assert {r.k: [(h.at, h.token, sorted(h.words)) for h in r.held] for r in found} == {1: [(5_000, "Gain-loss,", ["gain", "loss"]), (5_001, "gain", ["gain"])], 2: [], 3: []}
    values = X.owen_values(1 << 60, {5: ["gain"], 1 << 59: ["loss"]})  # the work doesn't grow with the tokens between
    assert np.allclose(sum(values.values()), shares([["gain"], ["loss"]]) - shares([]))


@pytest.mark.parametrize("words", [1, 7, 150, 300, 420])
def test_weights_are_those_of_the_whole_system(words):
    samples = 300
    chosen = X.masks(words, words, samples, 3)
    near = np.exp(-((1 - np.sqrt(chosen.mean(1))) ** 2) / 0.0625)
    y = 0.3 * chosen[:, :3].any(1) + 0.1 * chosen[:, 3:5].all(1)
    x = chosen - near @ chosen / near.sum()
    want = np.linalg.solve(x.T @ (near[:, None] * x) + (1 + 1e-9) * np.eye(words), x.T @ (near * (y - near @ y / near.sum())))
    assert np.allclose(X.ridge(chosen, y, near, block=1000), want, rtol=0, atol=1e-11)
    assert np.allclose(X.ridge(chosen, np.full(samples, 0.5), near), 0, atol=1e-11)
    gram = (x.T @ x + np.eye(words)).astype(np.float32)
    assert np.allclose(np.tril(X.factored(gram.copy(), 64)), np.linalg.cholesky(gram), atol=1e-2)

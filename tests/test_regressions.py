"""Many texts' regressions at once, against each by itself."""

import random
import time

import numpy as np
import pytest

from finstrata.functions.sentiment import keyword_scorer, keyword_shares
from finstrata.operators import explain as X


def shared_and_alone(least, words, sizes, samples):
    """Weights by the shared samples, and what is needed to get them text by text."""
    shared = X.Regressions(least, words, samples, 7, 0.25)
    turns = [X.turned(f"key{i}", n, 7) for i, n in enumerate(sizes)]
    held = [{at: [["gain", "loss", "profit", "weak"][at % 4]] for at in range(0, n, max(5, n // 9))} for n in sizes]
    y = np.stack([keyword_shares(*X.counts(X.drawn_bits(words, samples, 7), turn, samples, own))[:, i % 3] for i, (turn, own) in enumerate(zip(turns, held, strict=True))], 1)
    return shared.fitted(turns, y), [(X.masks(f"key{i}", n, samples, 7), y[:, i]) for i, n in enumerate(sizes)]


@pytest.mark.parametrize(("least", "words", "sizes"), [(1, 128, [1, 2, 7, 100, 128]), (129, 256, [129, 200, 256, 256]), (257, 300, [300, 257]), (301, 428, [301, 302, 428, 350]), (429, 429, [429]), (1327, 1400, [1327, 1400])])
def test_weights_of_many_texts_are_those_of_each(least, words, sizes):
    got, alone = shared_and_alone(least, words, sizes, 300)
    for weights, (chosen, y) in zip(got, alone, strict=True):
        assert np.allclose(weights, X.ridge(chosen, y, X.nearness(chosen.mean(1), 0.25)), rtol=0, atol=1e-10)


def test_counts_are_those_of_the_samples():
    held = {0: ["gain"], 3: ["gain", "loss"], 4: ["weak"], 600: ["profit"]}
    bits, turn, chosen = X.drawn_bits(601, 300, 7), X.turned("k", 601, 7), X.masks("k", 601, 300, 7).astype(bool)
    good, bad = X.counts(bits, turn, 300, held)
    assert (good == (chosen[:, 0] | chosen[:, 3]) * 1 + chosen[:, 600]).all() and (bad == chosen[:, 3] * 1 + chosen[:, 4]).all()


def test_samples_are_even_and_texts_have_their_own():
    one, other = (X.masks(k, 700, 5000, 42)[1:] - 0.5 for k in ("one", "other"))
    assert X.masks("one", 700, 5000, 42)[0].all()
    for x, y in ((one, one), (other, other), (one, other)):
        product = 4 * x.T @ y / len(x)
        off = product - np.diag(np.diag(product))
        assert abs(off).max() < 7 / np.sqrt(len(x)) and abs(off.std() * np.sqrt(len(x)) - 1) < 0.05
    assert abs(one.mean(0)).max() < 0.05 and abs((one * other).mean()) < 0.01
    signs = np.sign((one * other).mean(0))
    assert abs(signs.mean()) < 0.2  # a word is in the same samples of both texts, or in the others, by chance


def test_many_texts_take_little_more_than_a_few():
    sizes = [1000] * 96
    began = time.perf_counter()
    _, alone = shared_and_alone(922, 1000, sizes, 5000)
    all_, began = time.perf_counter() - began, time.perf_counter()
    for chosen, y in alone[:6]:
        X.ridge(chosen, y, X.nearness(chosen.mean(1), 0.25))
    assert all_ < (time.perf_counter() - began) * len(sizes) / 6 / 2


def test_explained_rows_are_those_of_each_text(spark):
    """More texts of a class than are fitted at once, several classes, more words than samples, odd keys."""
    rng = random.Random(2)
    words = ["strong", "loss", "the", "Risk,", "growth", "x", "gain-loss", "up", "profit", "weak!"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in [*[3, 9, 30] * 60, 140, 200, 90, 60, 61, 300]]
    rows = spark.createDataFrame([(None if i == 5 else str(i), t) for i, t in enumerate(texts)], "k string, t string")
    got = {}
    for r in X.explain(rows, "k", "t", samples=60).collect():
        got.setdefault(r.k, []).append((r.token, r.weight))
    assert len(got) == len(texts)
    scored = {r.k: r for r in keyword_scorer(rows, "t").collect()}
    for i in (0, 7, 170, 180, 181, 183, 184, 185):
        own = texts[i].split()
        chosen = X.masks(str(i), len(own), 60, 42)
        copies = spark.createDataFrame([(j, " ".join(w for w, c in zip(own, mask, strict=True) if c)) for j, mask in enumerate(chosen)], "j int, t string")
        label = scored[str(i)].sentiment_label
        y = np.array([r.s for r in keyword_scorer(copies, "t").selectExpr("j", f"score_{label} s").orderBy("j").collect()])
        want = X.weighed(chosen, y, 10, 0.25)
        assert len(want) == len(got[str(i)])
        assert np.allclose([w for _, w in want], [w for _, w in got[str(i)]], atol=1e-9)
        assert sorted(own[j] for j, w in want[:3]) == sorted(t for t, _ in got[str(i)][:3])

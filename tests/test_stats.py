import numpy as np
import pandas as pd
import pytest

from finstrata.functions import tails
from finstrata.operators import evaluation as V
from finstrata.operators import market as M
from finstrata.operators import stats as T


@pytest.mark.parametrize(("r", "n", "p"), [(0.2408, 88, 0.023803), (0.2998, 88, 0.00455), (0.2315, 85, 0.033041), (0.0293, 83, 0.792467), (0.0154, 89, 0.886279), (-0.0992, 69, 0.417408), (0.1617, 87, 0.134688)])
def test_correlation_tail_matches_published_pairs(r, n, p):
    assert tails.correlation_p(r, n) == pytest.approx(p, abs=6e-4)


def test_mcnemar_tails():
    assert tails.binomial_p(22, 71) == pytest.approx(0.0018204049356112858, rel=1e-9)
    assert tails.chi2_1_p(9.52112676056338) == pytest.approx(0.0020311983018945767, rel=1e-9)


def test_mcnemar_operator(spark):
    rows = [("a", "a", "b")] * 22 + [("a", "b", "a")] * 49 + [("a", "a", "a")] * 129
    x = V.mcnemar(spark.createDataFrame(rows, "truth string, first string, second string")).first()
    assert (x.b, x.c, x.discordant) == (22, 49, 71)
    assert x.exact_p == pytest.approx(0.0018204049356112858) and x.chi2 == pytest.approx(9.52112676056338) and x.chi2_p == pytest.approx(0.0020311983018945767)


def test_kappa_of_published_agreement(spark):
    rows = [("p", "p")] * 70 + [("n", "n")] * 70 + [("u", "u")] * 59 + [("u", "p")]
    x = V.kappa(spark.createDataFrame(rows, "first string, second string")).first()
    assert (x.n, x.kappa, x.se) == (200, 0.9925, 0.0075)


def test_beta_and_columns(spark):
    assert M.price_column() == "returns"
    assert M.price_column("auto", "sentiment_leads_1d", "spy_beta_residual") == "forward_1d_excess_return"
    assert M.price_column("returns", "sentiment_leads_1d") == "forward_1d_return"
    with pytest.raises(ValueError):
        M.price_column("volume")


def test_constant_series_have_no_correlation(spark):
    rows = spark.createDataFrame([("A", i, 1.0, float(i)) for i in range(8)] + [("B", i, float(i), 2.0 * i) for i in range(8)], "ticker string, date int, x double, y double")
    got = {r.ticker: r.pearson_r for r in M.correlation(rows, "x", "y").collect()}
    assert got == {"A": None, "B": 1.0}
    assert {r.ticker for r in M.rolling_correlation(rows, "x", "y", 5).collect()} == {"B"}


def test_spearman_shares_ranks(spark):
    x, y = [1, 2, 2, 3, 5, 4, 4, 9], [2, 1, 4, 4, 6, 5, 8, 7]
    rows = spark.createDataFrame([("A", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "ticker string, date int, x double, y double")
    want = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert M.spearman(rows, "x", "y").first().spearman_r == pytest.approx(want, abs=1e-4)


def test_adf_tells_a_walk_from_noise():
    random = np.random.default_rng(1)
    noise = random.normal(size=400)
    assert T.adf(noise)[1] < 0.01
    assert T.adf(noise.cumsum())[1] > 0.05
    assert T.adf(np.ones(30)) is None and T.adf(np.arange(5.0)) is None


def test_granger_finds_the_direction(spark):
    random = np.random.default_rng(2)
    x = random.normal(size=300)
    y = np.concatenate([[0.0], 0.8 * x[:-1]]) + 0.3 * random.normal(size=300)
    rows = spark.createDataFrame([("A", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "ticker string, date int, net_sentiment double, returns double")
    got = T.granger_by_ticker(rows, most=2).toPandas()
    assert (got[got.direction == "sentiment_to_returns"].p_value < 1e-6).all()
    assert (got[got.direction == "returns_to_sentiment"].p_value > 0.01).all()


def test_scores(spark):
    rows = spark.createDataFrame([("p", "p"), ("p", "n"), ("n", "n"), ("n", "n"), ("u", "p")], "truth string, predicted string")
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in V.scores(rows, ("p", "n", "u")).collect()}
    assert got == {"p": (0.5, 0.5, 0.5, 2), "n": (0.6667, 1.0, 0.8, 2), "u": (0.0, 0.0, 0.0, 1)}
    assert V.overall(rows, ("p", "n", "u")).first().macro_f1 == 0.4333


def test_bootstrap_surrounds_the_accuracy(spark):
    rows = spark.createDataFrame([("p", "p")] * 80 + [("n", "p")] * 20 + [("n", "n")] * 100, "truth string, predicted string")
    x = V.bootstrap(rows, 100).first()
    assert 0.82 < x.low < 0.9 < x.high < 0.97 and abs(x.mean - 0.9) < 0.02


def test_bootstrap_draws_as_often_as_the_reference(spark):
    rows = spark.createDataFrame([("p", "p"), ("n", "p")], "truth string, predicted string")
    assert V.bootstrap(rows).first().replicates == 1000

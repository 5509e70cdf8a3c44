"""Tests on series: p-values, stationarity, Granger causality. A ticker's series is one group, of a row for each day."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstrata.functions.tails import adf_p, correlation_p, f_p


def _correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else round(correlation_p(a, int(b)), 6) for a, b in zip(r, n, strict=True)], dtype="float64")


def p_value(r: str, n: str) -> Column:
    """Two-sided p of a column of correlations, to six digits."""
    return F.pandas_udf(_correlation_p, "double")(F.col(r).cast("double"), F.col(n).cast("long"))


def with_p(correlations: DataFrame, r: str = "pearson_r", alpha: float = 0.05) -> DataFrame:
    return correlations.withColumn("p_value", p_value(r, "n")).withColumn("significant", F.col("p_value") < alpha)


def squares(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """(coefficients, residual sum of squares) of a least-squares fit."""
    found = np.linalg.lstsq(x, y, rcond=None)[0]
    return found, float(((y - x @ found) ** 2).sum())


def adf(x: np.ndarray) -> tuple[float, float, int] | None:
    """(statistic, p, lags) of the augmented Dickey-Fuller test with a constant; lags by AIC over a common sample. None for under
    12 points or a constant series."""
    n = len(x)
    if n < 12 or np.ptp(x) == 0:
        return None
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    steps = np.diff(x)

    def design(lags: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        y = steps[first:]
        columns = [x[first:-1]] + [steps[first - i : -i] for i in range(1, lags + 1)] + [np.ones(len(y))]
        return y, np.stack(columns, 1)

    def criterion(lags: int) -> float:
        y, z = design(lags, most)
        return len(y) * math.log(max(squares(y, z)[1], 1e-300) / len(y)) + 2 * z.shape[1]

    lags = min(range(most + 1), key=criterion)
    y, z = design(lags, lags)
    found, rest = squares(y, z)
    variance = rest / max(len(y) - z.shape[1], 1) * np.linalg.pinv(z.T @ z)[0, 0]
    if variance <= 0:
        return None
    stat = float(found[0] / math.sqrt(variance))
    return stat, adf_p(stat), lags


def granger(y: np.ndarray, x: np.ndarray, lags: int) -> tuple[float, float]:
    """(F, p) of the test that x's lags add nothing to y's own."""
    n = len(y)
    own = np.stack([y[lags - i : n - i] for i in range(1, lags + 1)] + [np.ones(n - lags)], 1)
    other = np.stack([x[lags - i : n - i] for i in range(1, lags + 1)], 1)
    target = y[lags:]
    _, without = squares(target, own)
    _, with_x = squares(target, np.hstack([own, other]))
    df = n - lags - 2 * lags - 1
    if df <= 0 or with_x <= 0:
        return 0.0, 1.0
    f = (without - with_x) / lags / (with_x / df)
    return f, f_p(f, lags, df)


ADF = "ticker string, series string, n int, stat double, p_value double, lags int, stationary boolean"
GRANGER = "ticker string, direction string, lag int, n int, f_stat double, p_value double, significant boolean, differenced string"


def adf_by_ticker(merged: DataFrame, columns: tuple[str, ...] = ("net_sentiment", "returns")) -> DataFrame:
    """The ADF test of each ticker's series; nulls where it can't be done."""

    def tested(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("date"), []
        for c in columns:
            x = rows[c].dropna().to_numpy(float)
            stat, p, lags = adf(x) or (None, None, None)
            out.append((key[0], c, len(x), stat and round(stat, 4), None if p is None else round(p, 6), lags, None if p is None else p < 0.05))
        return pd.DataFrame(out, columns=[f.split()[0] for f in ADF.split(", ")])

    return merged.select("ticker", "date", *columns).groupBy("ticker").applyInPandas(tested, ADF)


def granger_by_ticker(merged: DataFrame, x: str = "net_sentiment", y: str = "returns", most: int = 5) -> DataFrame:
    """Both directions, lags 1 to ``most``. A series that isn't stationary is differenced first. Needs most + 10 rows."""

    def tested(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")[[x, y]].dropna()
        out = []
        if len(rows) >= most + 10:
            series, changed = {}, []
            for c in (x, y):
                values = rows[c].to_numpy(float)
                if (found := adf(values)) and found[1] >= 0.05:
                    values, changed = np.diff(values), [*changed, c]
                series[c] = values
            n = min(map(len, series.values()))
            a, b = series[x][-n:], series[y][-n:]
            if n >= most + 10:
                for name, target, cause in (("sentiment_to_returns", b, a), ("returns_to_sentiment", a, b)):
                    for lag in range(1, most + 1):
                        f, p = granger(target, cause, lag)
                        out.append((key[0], name, lag, n, round(f, 4), round(p, 6), p < 0.05, ",".join(changed)))
        return pd.DataFrame(out, columns=[f.split()[0] for f in GRANGER.split(", ")])

    return merged.select("ticker", "date", x, y).groupBy("ticker").applyInPandas(tested, GRANGER)


def correlation_panel(pearson: DataFrame, spearman: DataFrame, granger_rows: DataFrame, rolling: DataFrame) -> DataFrame:
    """A row for each ticker with all of its statistics; those that it lacks are null."""
    least = granger_rows.filter((F.col("direction") == "sentiment_to_returns") & (F.col("lag") <= 2)).groupBy("ticker").agg(F.min("p_value").alias("granger_p_min"))
    out = with_p(pearson).select("ticker", "n", "pearson_r", F.col("p_value").alias("pearson_p"))
    ranks = with_p(spearman, "spearman_r").select("ticker", "spearman_r", F.col("p_value").alias("spearman_p"))
    spread = rolling.select("ticker", F.col("mean").alias("rolling_mean"), F.col("std").alias("rolling_std"))
    return out.join(ranks, "ticker", "left").join(least, "ticker", "left").join(spread, "ticker", "left")

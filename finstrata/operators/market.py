"""Price series and their join with daily sentiment; everything runs for all tickers in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.functions.columns import half_up
from finstrata.operators.aggregates import daily_sentiment

BY_DATE = ("ticker", "date")


def series() -> object:
    return Window.partitionBy("ticker").orderBy("date")


def pearson(x: str, y: str, window=None) -> Column:
    """Correlation that is null, never an error, for a constant or too short side."""
    over = (lambda c: c.over(window)) if window is not None else (lambda c: c)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = over(F.stddev_pop(a)) * over(F.stddev_pop(b))
    return F.when(spread > 1e-12, F.try_divide(over(F.covar_pop(a, b)), spread))


def daily_returns(prices: DataFrame) -> DataFrame:
    """close / the day's before - 1; a series' first day has none and is left out."""
    return prices.withColumn("returns", F.col("close") / F.lag("close").over(series()) - 1).filter("returns is not null")


def moving_averages(prices: DataFrame, sizes: tuple[int, ...] = (5, 20)) -> DataFrame:
    """sma_n: the mean of n rows up to this one; null until there are n."""
    out = prices
    for n in sizes:
        frame = series().rowsBetween(-(n - 1), 0)
        out = out.withColumn(f"sma_{n}", F.when(F.count("close").over(frame) == n, half_up(F.avg("close").over(frame), 4)))
    return out


def merged_series(recs: DataFrame, prices: DataFrame, trailing: int = 5, benchmark: str | None = "SPY") -> DataFrame:
    """Daily sentiment on trading days, with what follows from it.

    trailing_net_sentiment: mean net of up to ``trailing`` (1 to 30) merged rows. forward_1d_return: the next row's. With a
    benchmark, spy_returns, beta (mean-removed, one for the whole series; 1 where it can't be told), and excess returns.
    """
    width = min(max(trailing, 1), 30)
    returns = daily_returns(prices)
    daily = daily_sentiment(recs) if "net_sentiment" not in recs.columns else recs
    out = daily.join(returns, list(BY_DATE))
    out = out.withColumn("trailing_net_sentiment", F.avg("net_sentiment").over(series().rowsBetween(-(width - 1), 0)))
    if benchmark:
        spy = returns.filter(F.col("ticker") == benchmark).select("date", F.col("returns").alias("spy_returns"))  # one row a day
        whole = Window.partitionBy("ticker")
        spread = F.var_pop("spy_returns").over(whole)
        beta = F.when((spread >= 1e-16) & (F.count("*").over(whole) >= 2), F.covar_pop("returns", "spy_returns").over(whole) / spread).otherwise(1.0)
        out = out.join(spy, "date").withColumn("beta", beta).withColumn("excess_returns", F.col("returns") - F.col("beta") * F.col("spy_returns"))
        out = out.withColumn("forward_1d_excess_return", F.lead("returns").over(series()) - F.col("beta") * F.lead("spy_returns").over(series()))
    return out.withColumn("forward_1d_return", F.lead("returns").over(series()))


def time_series(merged: DataFrame) -> DataFrame:
    """merged_series() as it is shown: dates as text, prices to two digits, returns to six, sentiment to four."""
    digits = {"close": 2, "returns": 6, "spy_returns": 6, "excess_returns": 6, "forward_1d_return": 6, "forward_1d_excess_return": 6, "avg_score": 4, "net_sentiment": 4, "trailing_net_sentiment": 4, "positive_ratio": 4, "negative_ratio": 4, "neutral_ratio": 4}
    names = {"forward_1d_excess_return": "forward_excess_return", "avg_score": "avg_sentiment_score"}
    return merged.select("ticker", F.date_format("date", "yyyy-MM-dd").alias("date"), "mention_count", *(half_up(F.col(c), d).alias(names.get(c, c)) for c, d in digits.items()))


def price_column(metric: str = "auto", align: str = "same_day", adjustment: str = "none") -> str:
    """The column that a correlation's options mean; decided before anything runs."""
    excess = adjustment == "spy_beta_residual"
    if align not in ("same_day", "sentiment_leads_1d") or adjustment not in ("none", "spy_beta_residual"):
        raise ValueError(f"align {align!r} or adjustment {adjustment!r} isn't known")
    ahead = align == "sentiment_leads_1d"
    if metric == "auto":
        metric = "excess_returns" if excess else "returns"
    if metric in ("close", "forward_1d_return", "forward_1d_excess_return"):
        return metric
    if metric == "returns":
        return "forward_1d_return" if ahead else "returns"
    if metric == "excess_returns":
        return "forward_1d_excess_return" if ahead else "excess_returns"
    raise ValueError(f"price metric {metric!r} isn't known")


def sentiment_column(metric: str = "net_sentiment") -> str:
    return "trailing_net_sentiment" if metric == "net_sentiment" else metric


def correlation(merged: DataFrame, x: str, y: str, least: int = 5) -> DataFrame:
    """For each ticker: n, pearson_r (null under ``least`` pairs or for a constant side) and its strength in words."""
    r = merged.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy("ticker").agg(F.count("*").alias("n"), pearson(x, y).alias("r"))
    r = r.withColumn("r", F.when(F.col("n") >= least, F.col("r")))
    size = F.abs("r")
    words = F.when(F.col("r").isNull(), None).when(size >= 0.7, "strong").when(size >= 0.4, "moderate").when(size >= 0.2, "weak").otherwise("negligible")
    return r.select("ticker", "n", half_up(F.col("r"), 4).alias("pearson_r"), words.alias("strength"))


def average_rank(column: str) -> Column:
    """Rank of a value in its ticker, ties sharing the mean of theirs."""
    return F.rank().over(Window.partitionBy("ticker").orderBy(column)) + (F.count("*").over(Window.partitionBy("ticker", column)) - 1) / 2


def spearman(merged: DataFrame, x: str, y: str, least: int = 5) -> DataFrame:
    ranked = merged.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("rx", average_rank(x)).withColumn("ry", average_rank(y))
    out = ranked.groupBy("ticker").agg(F.count("*").alias("n"), pearson("rx", "ry").alias("r"))
    return out.select("ticker", "n", half_up(F.when(F.col("n") >= least, F.col("r")), 4).alias("spearman_r"))


def lag_sweep(merged: DataFrame, x: str, y: str, most: int = 5, least: int = 5) -> DataFrame:
    """r for each lag from -most to most; a positive lag pairs a day's sentiment with later returns. Short series have no rows.

    All lags come from one window over a ticker's days; no join.
    """
    lags = range(-most, most + 1)
    later = F.array(*(F.struct(F.lit(k).alias("lag"), F.lead(y, k).over(series()).alias("y"), F.lead(F.lit(True), k).over(series()).alias("there")) for k in lags))
    rows = merged.withColumn("rows", F.count("*").over(Window.partitionBy("ticker"))).withColumn("later", later).filter(F.col("rows") >= most + 5)
    pairs = rows.select("ticker", F.col(x).alias("x"), F.explode("later").alias("l")).select("ticker", "x", "l.*").filter("there")
    out = pairs.groupBy("ticker", "lag").agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n"), pearson("x", "y").alias("r"))
    return out.select("ticker", "lag", "n", half_up(F.when(F.col("n") >= least, F.col("r")), 4).alias("r"))


def best_lag(sweep: DataFrame) -> DataFrame:
    """The lag with the largest |r| of each ticker; of equal ones the smallest lag."""
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc(F.abs("r")), "lag"))
    return sweep.filter("r is not null").withColumn("k", rank).filter("k = 1").drop("k")


def rolling_correlation(merged: DataFrame, x: str, y: str, window: int = 14) -> DataFrame:
    """r of each full window of rows, and the window's first day; needs window + 2 rows."""
    rows = merged.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("rows", F.count("*").over(Window.partitionBy("ticker"))).filter(F.col("rows") >= window + 2)
    frame = series().rowsBetween(-(window - 1), 0)
    out = rows.select("ticker", F.col("date").alias("window_end"), F.min("date").over(frame).alias("window_start"), F.count("*").over(frame).alias("n"), pearson(x, y, frame).alias("r"))
    return out.filter((F.col("n") == window) & F.col("r").isNotNull()).select("ticker", "window_start", "window_end", half_up(F.col("r"), 4).alias("r"))


def rolling_summary(rolling: DataFrame) -> DataFrame:
    return rolling.groupBy("ticker").agg(
        F.count("*").alias("windows"), half_up(F.avg("r"), 4).alias("mean"), half_up(F.stddev_pop("r"), 4).alias("std"), F.min("r").alias("least"), F.max("r").alias("most"),
        F.count_if(F.col("r") > 0).alias("positive"), F.count_if(F.col("r") < 0).alias("negative"),
    )


def out_of_sample(merged: DataFrame, x: str, y: str, ratio: float = 0.7, least: int = 5) -> DataFrame:
    """r of the first int(n * ratio) rows and of the others, with the first day of these."""
    if not 0.05 < ratio < 0.95:
        raise ValueError("ratio must lie between 0.05 and 0.95")
    whole = Window.partitionBy("ticker")
    rows = merged.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("rn", F.row_number().over(series())).withColumn("rows", F.count("*").over(whole))
    rows = rows.withColumn("part", F.when(F.col("rn") <= F.floor(F.col("rows") * ratio), "train").otherwise("test"))
    out = rows.groupBy("ticker", "part").agg(F.count("*").alias("n"), pearson(x, y).alias("r"), F.min("date").alias("first"))
    out = out.withColumn("r", half_up(F.col("r"), 4)).groupBy("ticker").agg(
        *(F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}") for p in ("train", "test") for c in ("n", "r")), F.max(F.when(F.col("part") == "test", F.col("first"))).alias("split_date")
    )
    return out.filter((F.col("train_n") >= least) & (F.col("test_n") >= least))


def overview(correlations: DataFrame, least: int = 5, alpha: float = 0.05) -> DataFrame:
    """All tickers ranked by |r|, with the Bonferroni threshold of so many tests."""
    tested = correlations.filter((F.col("n") >= least) & F.col("pearson_r").isNotNull())  # a row for each ticker
    tests = tested.agg(F.count("*").alias("tests"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.abs("pearson_r")), "ticker"))
    return tested.join(F.broadcast(tests)).select(rank.alias("rank"), "ticker", "n", "pearson_r", (F.lit(alpha) / F.col("tests")).alias("bonferroni_alpha"))


def scatter_fit(merged: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of returns in percent on sentiment (slope 0 for a constant one), and points by quadrant."""
    pts = merged.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select("ticker", F.col(x).alias("x"), (F.col(y) * 100).alias("y"))
    spread = F.var_pop("x") * F.count("*")
    out = pts.groupBy("ticker").agg(
        F.count("*").alias("n"), F.when(spread < 1e-14, 0.0).otherwise(F.try_divide(F.covar_pop("x", "y"), F.var_pop("x"))).alias("slope"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.count_if((F.col("x") >= 0) & (F.col("y") >= 0)).alias("up_up"), F.count_if((F.col("x") >= 0) & (F.col("y") < 0)).alias("up_down"),
        F.count_if((F.col("x") < 0) & (F.col("y") >= 0)).alias("down_up"), F.count_if((F.col("x") < 0) & (F.col("y") < 0)).alias("down_down"),
    )
    return out.select("ticker", "n", half_up(F.col("slope"), 4).alias("slope"), half_up(F.col("my") - F.col("slope") * F.col("mx"), 4).alias("intercept"), "up_up", "up_down", "down_up", "down_down")


def window_bounds(prices: DataFrame, days: int | None = None) -> DataFrame:
    """(ticker, start_at, end_at): from the first trading day's first second to the last one's last, of the last ``days`` days if given."""
    last = F.max("date").over(Window.partitionBy("ticker"))
    inside = prices if days is None else prices.withColumn("last", last).filter(F.col("date") > F.date_sub("last", days))
    at = lambda c: c.cast("timestamp_ntz")
    return inside.groupBy("ticker").agg(at(F.min("date")).alias("start_at"), (at(F.date_add(F.max("date"), 1)) - F.expr("interval 1 second")).alias("end_at"))


def inside_window(recs: DataFrame, bounds: DataFrame) -> DataFrame:
    """The rows of each ticker within its bounds, which are inclusive."""
    return recs.join(bounds, "ticker").filter(F.col("published_at").between(F.col("start_at"), F.col("end_at")))

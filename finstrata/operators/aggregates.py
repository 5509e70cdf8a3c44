"""Aggregations over the fact table (ticker, sentiment_label, sentiment_score, data_source, published_at)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finstrata.functions.columns import count_of, half_up, net, percent
from finstrata.functions.lexicons import CHANNELS, EMOTIONS, LABELS


def counts() -> list:
    return [F.count("*").alias("total"), *(count_of("sentiment_label", x).alias(x) for x in LABELS)]


def stock_rows(recs: DataFrame) -> DataFrame:
    return recs.filter("ticker is not null")


def trailing_days(recs: DataFrame, days: int) -> DataFrame:
    """Rows of the last ``days`` days, counted back from the newest row in scope."""
    newest = recs.agg(F.max("published_at").alias("newest"))  # one row
    return recs.join(F.broadcast(newest), F.col("published_at") >= F.col("newest") - F.expr(f"interval {int(days)} days")).drop("newest")


def label_distribution(recs: DataFrame, *keys: str) -> DataFrame:
    """Counts and percentages of the labels; labels that aren't known count in no label, and not in the percentages' total."""
    known = reduce(lambda a, b: a + b, (F.col(x) for x in LABELS))
    return recs.groupBy(*keys).agg(*counts()[1:]).withColumn("total", known).select(*keys, "total", *LABELS, *(percent(F.col(x), F.col("total")).alias(f"{x}_pct") for x in LABELS))


def top_stocks(recs: DataFrame, limit: int = 10) -> DataFrame:
    return stock_rows(recs).groupBy("ticker").agg(*counts()).orderBy(F.desc("total"), "ticker").limit(limit)


def distinct_tickers(recs: DataFrame) -> DataFrame:
    return recs.agg(F.countDistinct("ticker").alias("tickers"))


def date_range(recs: DataFrame) -> DataFrame:
    return recs.agg(F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))


def recent_activity(recs: DataFrame, windows: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    newest = recs.agg(F.max("published_at").alias("newest"))
    return recs.join(F.broadcast(newest)).agg(*(F.count_if(F.col("published_at") >= F.col("newest") - F.expr(f"interval {d} days")).alias(f"last_{d}") for d in windows))


def daily_trend(recs: DataFrame) -> DataFrame:
    return recs.groupBy(F.to_date("published_at").alias("day")).agg(*counts()).select("day", "total", half_up(net(F.col("positive"), F.col("negative"), F.col("total")), 4).alias("net"))


def source_comparison(recs: DataFrame) -> DataFrame:
    """Counts and percentages of each channel; all three are there."""
    channels = recs.sparkSession.createDataFrame([(c,) for c in CHANNELS], "data_source string")
    found = recs.groupBy("data_source").agg(*counts())
    return channels.join(found, "data_source", "left").na.fill(0).select("data_source", "total", *LABELS, *(percent(F.col(x), F.col("total")).alias(f"{x}_pct") for x in LABELS))


def source_disagreement(recs: DataFrame, least: int = 3) -> DataFrame:
    """For each day the range and population deviation of the channels' net sentiments; channels with fewer rows don't count."""
    by = recs.filter(F.col("data_source").isin(*CHANNELS)).groupBy(F.to_date("published_at").alias("day"), "data_source").agg(*counts())
    by = by.withColumn("net", F.when(F.col("total") >= least, half_up(net(F.col("positive"), F.col("negative"), F.col("total")), 4)))
    several = F.count("net") >= 2
    return by.groupBy("day").agg(
        F.sum("total").alias("total_mentions"),
        F.count("net").alias("channels"),
        F.when(several, half_up(F.max("net") - F.min("net"), 4)).alias("net_range"),
        F.when(several, half_up(F.stddev_pop("net"), 4)).alias("net_std"),
    )


def ticker_aggregate(recs: DataFrame) -> DataFrame:
    return stock_rows(recs).groupBy("ticker").agg(*counts(), half_up(F.avg("sentiment_score"), 4).alias("avg_score"))


def compare_tickers(recs: DataFrame, tickers: list[str]) -> DataFrame:
    """ticker_aggregate() of the tickers asked for, in that order; zeros for those that aren't there."""
    asked = recs.sparkSession.createDataFrame(list(enumerate(tickers)), "position int, ticker string")
    found = ticker_aggregate(recs.filter(F.col("ticker").isin(*tickers)))
    return asked.join(found, "ticker", "left").na.fill(0).select("position", "ticker", "total", *LABELS, "avg_score").orderBy("position")


def emotion_distribution(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts and percentages (of all rows) of each emotion, null being mixed; the top one, of equal ones the first."""
    label = F.coalesce("emotion_label", F.lit("mixed"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(label == e).alias(e) for e in EMOTIONS))
    most = F.greatest(*EMOTIONS)
    top = reduce(lambda otherwise, e: F.when(F.col(e) == most, e).otherwise(otherwise), reversed(EMOTIONS), F.lit(None).cast("string"))
    return out.select(*keys, "total", *EMOTIONS, *(percent(F.col(e), F.col("total")).alias(f"{e}_pct") for e in EMOTIONS), F.when(most > 0, top).alias("top_emotion"))


def trending(recs: DataFrame, hours: int = 24, least: int = 5, limit: int = 10) -> DataFrame:
    newest = recs.agg(F.max("published_at").alias("newest"))
    recent = stock_rows(recs).join(F.broadcast(newest), F.col("published_at") >= F.col("newest") - F.expr(f"interval {int(hours)} hours"))
    return recent.groupBy("ticker").agg(F.count("*").alias("mentions")).filter(F.col("mentions") >= least).orderBy(F.desc("mentions"), "ticker").limit(limit)


def global_stats(recs: DataFrame) -> DataFrame:
    return recs.agg(F.count("*").alias("total"), F.countDistinct("ticker").alias("tickers"), F.max("published_at").alias("last_updated"))


def daily_sentiment(recs: DataFrame) -> DataFrame:
    """For each ticker and day: mentions, average score, shares of the labels, net sentiment."""
    out = stock_rows(recs).groupBy("ticker", F.to_date("published_at").alias("date")).agg(*counts(), F.avg("sentiment_score").alias("avg_score"))
    shares = [half_up(F.col(x) / F.col("total"), 6).alias(f"{x}_ratio") for x in LABELS]
    return out.select("ticker", "date", F.col("total").alias("mention_count"), half_up(F.col("avg_score"), 6).alias("avg_score"), *shares, net(F.col("positive"), F.col("negative"), F.col("total")).alias("net_sentiment"))


def recent_summary(recs: DataFrame, ticker: str, limit: int = 100) -> DataFrame:
    """Counts, percentages and the average score of a ticker's newest rows."""
    newest = recs.filter(F.col("ticker") == ticker).orderBy(F.desc("published_at"), "id").limit(limit)
    out = newest.agg(*counts(), half_up(F.avg("sentiment_score"), 3).alias("avg_score"))
    return out.select("total", *LABELS, *(percent(F.col(x), F.col("total")).alias(f"{x}_pct") for x in LABELS), "avg_score")


def data_signature(recs: DataFrame) -> DataFrame:
    """For each ticker 48 digits of a hash that changes with its rows' count and span, and, if rows say when they came
    (ingested_at), with the last of these times."""
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    came = [stamp(F.max("ingested_at"))] if "ingested_at" in recs.columns else []
    parts = F.concat_ws("|", F.count("*").cast("string"), stamp(F.min("published_at")), stamp(F.max("published_at")), *came)
    return stock_rows(recs).groupBy("ticker").agg(F.substring(F.sha2(parts, 256), 1, 48).alias("signature"))


def label_by_source(recs: DataFrame) -> DataFrame:
    return recs.groupBy(F.coalesce("sentiment_label", F.lit("neutral")).alias("label"), F.coalesce("data_source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


def longest_gap(recs: DataFrame, start: str, end: str) -> DataFrame:
    """For each ticker the longest run of days without a mention in a window, its edges included; gaps between days, no calendar."""
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    days = stock_rows(recs).select("ticker", F.to_date("published_at").alias("day")).filter(F.col("day").between(low, high)).distinct()
    after = F.lead("day").over(Window.partitionBy("ticker").orderBy("day"))
    gap = F.datediff(F.coalesce(after, F.date_add(high, 1)), "day") - 1
    return days.withColumn("gap", gap).groupBy("ticker").agg(F.count("*").alias("days_with_mentions"), F.greatest(F.max("gap"), F.datediff(F.min("day"), low)).alias("longest_gap"))


def stock_quality(recs: DataFrame, start: str, end: str) -> DataFrame:
    """For each ticker: totals, shares, coverage, longest gap, flags (in a fixed order), confidence score and label."""
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = stock_rows(recs).filter(F.to_date("published_at").between(low, high))
    channel = F.coalesce("data_source", F.lit("unknown"))
    by = inside.groupBy("ticker").agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce("sentiment_label", F.lit("neutral")) == "neutral").alias("neutral"),
        *(F.count_if(channel == c).alias(f"n_{c}") for c in CHANNELS),
    )
    x = by.join(longest_gap(recs, start, end), "ticker").withColumn("calendar_days", F.datediff(high, low) + 1)
    neutral = F.col("neutral") / F.greatest("total", F.lit(1))
    most = F.greatest(*(F.col(f"n_{c}") for c in CHANNELS))
    coverage = F.col("days_with_mentions") / F.col("calendar_days")
    heavy, skew = neutral >= 0.58, (most / F.col("total") >= 0.82) & (F.col("total") >= 8)
    sparse = (F.col("calendar_days") >= 14) & (coverage < 0.25) & (F.col("total") >= 5)
    quiet = (F.col("longest_gap") >= 14) & (F.col("calendar_days") >= 21)
    size = F.when(F.col("total") < 5, "very_thin_sample").when(F.col("total") < 15, "thin_sample").when(F.col("total") < 40, "moderate_sample")
    start_score = F.when(F.col("total") < 5, 0.28).when(F.col("total") < 15, 0.48).when(F.col("total") < 40, 0.72).otherwise(1.0)
    score = start_score
    for rule, factor in ((heavy, 0.92), (skew, 0.86), (sparse, 0.82), (quiet, 0.9)):
        score = score * F.when(rule, factor).otherwise(1.0)
    flags = F.concat_ws(",", size, F.when(heavy, "neutral_heavy"), F.when(skew, "channel_skew"), F.when(sparse, "sparse_calendar_coverage"), F.when(quiet, "long_quiet_period"))
    x = x.withColumn("score", half_up(score, 2))
    label = F.when(F.col("score") >= 0.72, "high").when(F.col("score") >= 0.42, "medium").otherwise("low")
    return x.select("ticker", "total", half_up(neutral, 4).alias("neutral_share"), "days_with_mentions", "calendar_days", half_up(coverage, 4).alias("coverage"), "longest_gap", flags.alias("flags"), "score", label.alias("confidence"))


def selected(recs: DataFrame, source: str | None = None, sentiment: str | None = None, ticker: str | None = None, stocks_only: bool = False, documents_only: bool = False, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows that pass the filters, days inclusive. The filters reach the scan."""
    for column, value in (("data_source", source), ("sentiment_label", sentiment), ("ticker", ticker)):
        if value is not None:
            recs = recs.filter(F.col(column) == value)
    if start is not None:
        recs = recs.filter(F.col("published_at") >= F.lit(start).cast("date").cast("timestamp_ntz"))
    if end is not None:
        recs = recs.filter(F.col("published_at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    if stocks_only:
        recs = stock_rows(recs)
    if documents_only:
        recs = recs.filter("ticker is null")
    return recs


def newest_first(recs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return recs.orderBy(F.desc("published_at"), "id").offset(offset).limit(limit)


def predictions_page(recs: DataFrame, limit: int, offset: int = 0, **filters) -> DataFrame:
    """A page of the rows that selected() lets pass, newest first."""
    return newest_first(selected(recs, **filters), limit, offset)


def numbered_page(recs: DataFrame, page: int, size: int = 20, **filters) -> DataFrame:
    """A page, from 1, with the number of rows on all pages, and whether more follow."""
    rows = selected(recs, **filters)
    total = rows.agg(F.count("*").alias("total"))  # one row
    found = newest_first(rows, size, (page - 1) * size).join(F.broadcast(total))
    return found.withColumn("has_more", F.col("total") > page * size)


def mention_page(recs: DataFrame, ticker: str, limit: int = 50, offset: int = 0, source: str | None = None) -> DataFrame:
    """A ticker's newest rows from an offset on, and how many it has in all."""
    rows = selected(recs, ticker=ticker, source=source)
    return newest_first(rows, limit, offset).join(F.broadcast(rows.agg(F.count("*").alias("total_count"))))


def find_records(recs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with these ids."""
    return recs.join(ids.select("id"), "id", "left_semi")


def with_company(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """Adds company_name; a ticker that the dimension doesn't have names itself."""
    return rows.join(dimension.select("ticker", "company_name"), "ticker", "left").withColumn("company_name", F.coalesce("company_name", "ticker"))


def statistics(recs: DataFrame) -> DataFrame:
    """All of the statistics page's counts of the labels from one scan: (section, key), section being all, source, ticker or day."""
    base = stock_rows(recs).groupBy(F.to_date("published_at").cast("string").alias("day"), "ticker", F.coalesce("data_source", F.lit("unknown")).alias("source")).agg(*counts())
    sums = [F.sum(c).alias(c) for c in ("total", *LABELS)]
    keys = ("source", "ticker", "day")
    found = base.groupingSets([[], *([F.col(k)] for k in keys)], *(F.col(k) for k in keys)).agg(*sums)
    section = F.coalesce(*(F.when(F.col(k).isNotNull(), k) for k in keys), F.lit("all"))
    return found.select(section.alias("section"), F.coalesce(*keys, F.lit("")).alias("key"), "total", *LABELS)


def run_summary(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, sample deviation (0 of one), least, most and number of values."""
    return rows.groupBy(*keys).agg(
        half_up(F.avg(value), 6).alias("mean"), half_up(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n")
    )


def prediction_stats(rows: DataFrame) -> DataFrame:
    """By label and channel: rows, mean confidence, first and last time."""
    return rows.groupBy("sentiment_label", "data_source").agg(F.count("*").alias("n"), half_up(F.avg("sentiment_score"), 4).alias("mean_confidence"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))

from datetime import datetime

from finstrata.operators import aggregates as A

SCHEMA = "id string, ticker string, sentiment_label string, sentiment_score double, data_source string, published_at timestamp_ntz"


def rows(spark, *of):
    return spark.createDataFrame([(str(i), *x) for i, x in enumerate(of)], SCHEMA)


def test_stock_rows_only(spark):
    at = datetime(2026, 1, 1)
    recs = A.stock_rows(rows(spark, (None, "positive", 0.7, "news", at), ("AAPL", "positive", 0.7, "news", at), ("MSFT", "negative", 0.7, "reddit", at)))
    x = A.label_distribution(recs).first()
    assert (x.total, x.positive_pct, x.negative_pct, x.neutral_pct) == (2, 50.0, 50.0, 0.0)
    assert [r.ticker for r in A.top_stocks(recs).collect()] == ["AAPL", "MSFT"]
    assert {r.data_source: r.total for r in A.source_comparison(recs).collect()} == {"news": 1, "reddit": 1, "twitter": 0}


def test_anchor_is_the_newest_row_in_scope(spark):
    recs = rows(spark, ("TSLA", "positive", 0.7, "reddit", datetime(2026, 1, 1)), ("TSLA", "negative", 0.7, "reddit", datetime(2026, 1, 10)), ("TSLA", "positive", 0.7, "news", datetime(2026, 4, 1)))
    scope = A.trailing_days(recs.filter("data_source = 'reddit'"), 7)
    assert A.label_distribution(scope).first().total == 1
    x = A.daily_trend(scope).first()
    assert (str(x.day), x.total, x.net) == ("2026-01-10", 1, -1.0)
    y = A.recent_activity(scope).first()
    assert (y.last_1, y.last_7, y.last_30) == (1, 1, 1)


def test_disagreement(spark):
    at = datetime(2026, 1, 1)
    of = lambda source, pos, neg, n: [("T", "positive", 0.7, source, at)] * pos + [("T", "negative", 0.7, source, at)] * neg + [("T", "neutral", 0.7, source, at)] * (n - pos - neg)
    x = A.source_disagreement(rows(spark, *of("reddit", 2, 0, 10), *of("news", 0, 4, 10), *of("twitter", 1, 0, 10))).first()
    assert (x.net_range, x.channels, x.total_mentions) == (0.6, 3, 30)
    assert abs(x.net_std - 0.2625) < 1e-4
    x = A.source_disagreement(rows(spark, *of("reddit", 2, 0, 10), *of("news", 0, 1, 2))).first()
    assert (x.net_range, x.net_std, x.channels, x.total_mentions) == (None, None, 1, 12)


def test_empty(spark):
    none = rows(spark).limit(0)
    assert A.label_distribution(none).first().total == 0
    assert A.top_stocks(none).count() == A.daily_trend(none).count() == 0
    assert [r.total for r in A.source_comparison(none).collect()] == [0, 0, 0]


def test_quality_flags_and_gap(spark):
    recs = rows(spark, *[("T", "neutral", 0.7, "news", datetime(2026, 1, d)) for d in (3, 4, 4, 4)])
    x = A.stock_quality(recs, "2026-01-01", "2026-01-30").first()
    assert (x.total, x.days_with_mentions, x.longest_gap, x.calendar_days) == (4, 2, 26, 30)
    assert x.flags == "very_thin_sample,neutral_heavy,long_quiet_period"
    assert (x.score, x.confidence) == (0.23, "low")


def test_compare_keeps_the_order_asked_for(spark):
    recs = rows(spark, ("A", "positive", 0.5, "news", datetime(2026, 1, 1)))
    assert [(r.ticker, r.total) for r in A.compare_tickers(recs, ["Z", "A"]).orderBy("position").collect()] == [("Z", 0), ("A", 1)]


def test_emotion_distribution_sums_null_and_mixed(spark):
    rows_ = spark.createDataFrame([("fear",), (None,), ("mixed",), ("scepticism",)], "emotion_label string")
    x = A.emotion_distribution(rows_).first()
    assert (x.total, x.mixed, x.fear, x.mixed_pct, x.top_emotion) == (4, 2, 1, 50.0, "mixed")

from pyspark.sql import functions as F

from finstrata.functions.scoring import ModelScorer, batch_summary
from finstrata.operators import explain as X
from finstrata.operators import preprocess as P


def test_presets(spark):
    rows = spark.createDataFrame([("The Stocks are not good, up 5%!",), (None,)], "text string")
    got = P.preprocess(rows, ("text",), "full").collect()
    assert got[0].text_tokens == ["stock", "not", "good", "up", "5"] and got[1].text_tokens == []
    assert P.preprocess(rows, ("text",), "finbert").first().text_processed == "The Stocks are not_good up 5%"
    x = P.preprocess_stats(P.preprocess(rows, ("text",), "minimal"), ("text",)).first()
    assert (x.total_records, x.total_tokens, x.avg_tokens_per_record) == (2, 7, 3.5)


def test_sink_and_checks(spark, tmp_path):
    rows = spark.createDataFrame([("a text that is long enough", 0.5, "AAPL"), ("short", 2.0, "TOOLONGTICKER")], "text string, sentiment_score double, ticker string")
    assert [r.v for r in rows.select(P.violations(rows).alias("v")).collect()] == [[], ["text", "score", "ticker"]]
    P.write_preprocessed(rows, str(tmp_path / "o"), ("text",))
    assert spark.read.json(str(tmp_path / "o")).filter("source_type = 'news'").count() == 2
    assert [r.g for r in spark.createDataFrame([("",), ("a",), ("a" * 20_000,), ("a" * 60_000,)], "t string").select(P.guard(F.col("t")).alias("g")).collect()] == ["empty", "ok", "long", "too_long"]


def test_annotation_and_csv(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "k int, text string")
    assert sorted((r.idx, r.text) for r in P.annotation_task(rows, "k").collect()) == [(i, f"text {i}") for i in range(50)]
    csv = spark.createDataFrame([("shares surge", "1767312000000", "x1"), (" ", None, "x2")], "body string, timestamp string, id string")
    x = P.classify_column(csv, "body", "2026-01-01T00:00:00").collect()
    assert len(x) == 1 and x[0].sentiment_label == "positive" and str(x[0].published_at).startswith("2026-01-02")


def test_metadata_leaves_nulls_out(spark):
    rows = spark.createDataFrame([("a", None, '{"x": 1}')], "k string, v string, j string")
    assert P.metadata(rows, ("k", "v"), {"j": "struct<x:int>"}).first().metadata == '{"k":"a","j":{"x":1}}'


def test_model_scorer_keeps_failures_apart(spark):
    def make():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError
            return [(0.7, 0.2, 0.1)] * len(texts)

        return model

    rows = spark.createDataFrame([("good",), ("bad",), ("",), (None,), ("fine",)], "text string")
    got = ModelScorer(make)(rows)
    assert [(r.sentiment_label, r.score_error) for r in got.collect()] == [("positive", None), (None, "ValueError"), (None, None), (None, None), ("positive", None)]
    x = batch_summary(got).first()
    assert (x.total, x.positive, x.failed) == (5, 2, 1)


def test_explanation_finds_the_words_that_matter(spark):
    rows = spark.createDataFrame([(1, "we saw a surge in the report")], "k long, text string")
    weights = X.explain(rows, "k", "text", samples=120)
    assert weights.orderBy(F.desc(F.abs("weight"))).first().token == "surge"
    assert X.summary(weights).count() == 7


def test_annotation_numbers_hold_when_ranges_are_put_together(spark):
    rows = spark.range(20_000).selectExpr("id * 7919 % 20000 AS k", "array_join(transform(sequence(1, 30), i -> md5(cast(id * 31 + i AS string))), '') AS text").repartition(16)
    found = P.annotation_task(rows, "k").select("idx").toPandas()["idx"]
    assert sorted(found) == list(range(20_000))

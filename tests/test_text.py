import pytest
from pyspark.sql import functions as F

from finstrata.functions import sentiment as S
from finstrata.functions import text as X


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "options", "want"),
    [
        ("See https://a.com/x now", {}, "see now"),
        ("mail me@x.org please", {}, "mail please"),
        ("hi @bobé there", {}, "hi there"),
        ("#BuyTheDip ok", {}, "buy the dip ok"),
        ("up 5% to $10.50!", {"keep_financial": True}, "up 5% to $10.50"),
        ("It is not good.", {"negations": True}, "it is not_good"),
        ("isn't good and no", {"negations": True}, "isnt good and no"),
        ("paid 5k and 3.2M", {"numbers": True}, "paid and"),
        ("ABC", {"lower": False}, "ABC"),
        (None, {}, ""),
        ("   ", {}, ""),
    ],
)
def test_normalize_text(spark, text, options, want):
    assert one(spark, text, lambda c: X.normalize_text(c, **options)) == want


def test_movements(spark):
    got = one(spark, "AAPL up 5%, then fell 3.2 % and gained 1$ at $40", X.movements)
    assert [(x.direction, x.raw_direction) for x in got] == [("positive", "up"), ("negative", "fell"), ("positive", "gained")]
    assert one(spark, "nothing", X.movements) == []


def test_clean_news(spark):
    assert one(spark, "<p>Hi</p>  see https://x.y/z [+120 chars] [removed]", X.clean_news) == "Hi see"
    assert one(spark, None, X.clean_news) == ""


def test_tweet_quality(spark):
    rows = [("$NVDA calls", True), ("short", False), ("please follow me for tips now", False), ("# " * 13 + "many tags in here", False), ("a plain post that is long enough", True)]
    got = spark.createDataFrame(rows, "t string, want boolean").select(X.tweet_quality(F.col("t"), F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_keyword_scorer(spark):
    rows = spark.createDataFrame([("Shares surge and rally",), ("crash and loss, then profit",), ("a gain and a loss",), ("nothing",), (None,)], "text string")
    got = [(r.sentiment_label, r.sentiment_score) for r in S.keyword_scorer(rows).collect()]
    assert got == [("positive", 0.9), ("negative", 0.8), ("neutral", 0.5), ("neutral", 0.5), ("neutral", 0.5)]


def test_entropy(spark):
    x = spark.range(1).select(S.entropy(F.lit(1 / 3), F.lit(1 / 3), F.lit(1 / 3)).alias("a"), S.entropy(F.lit(0.97), F.lit(0.02), F.lit(0.01)).alias("b")).first()
    assert x.a > 0.99 and x.b < 0.25


def test_aspects_and_limits(spark):
    rows = spark.createDataFrame([(1, "Q3 revenue missed but user growth and demand held up. " + "Earnings were fine this time. " * 4)], "k long, t string")
    got = S.aspect_rows(rows, "k", "t").orderBy("position").collect()
    assert {x.aspect for x in got} >= {"revenue_earnings", "growth_demand"}
    assert sum(x.aspect == "revenue_earnings" for x in got) == 2


def test_emotion(spark):
    rows = spark.createDataFrame([("panic selloff and crash after downgrade", "negative", 0.9, 0.2), ("quiet", "neutral", 0.4, 0.9)], "t string, l string, s double, h double")
    got = S.with_emotion(S.emotion_scores(rows, F.col("t"), F.col("l"), F.col("s"), F.col("h")), "h").collect()
    assert got[0].emotion_label == "fear" and got[1].emotion_label == "mixed"


def test_sentences(spark):
    assert one(spark, "First sentence here. Second one is here!  no", X.sentences) == ["First sentence here.", "Second one is here!"]
    assert one(spark, "short", X.sentences) == ["short"]
    assert one(spark, None, X.sentences) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Good muffins cost $3.88\nin New York.  Please buy me\ntwo of them.\nThanks.", "Good muffins cost $ 3.88 in New York . Please buy me two of them . Thanks ."),
        ("They'll save and invest more.", "They 'll save and invest more ."),
        ("hi, my name can't hello,", "hi , my name ca n't hello ,"),
        ('He said, "I cannot go" (yet)...', "He said , `` I can not go '' ( yet ) ..."),
        ("it's Tom's; 1,000 at 9:30 -- gonna? wanna!", "it 's Tom 's ; 1,000 at 9:30 -- gon na ? wan na !"),
        ("'Tis the U.S. market", "'T is the U.S. market"),
        (None, ""),
        (" \n", ""),
    ],
)
def test_treebank(spark, text, want):
    assert one(spark, text, X.treebank) == want.split()


@pytest.mark.parametrize("text", ["égains loss", "gainsé loss", "중gains losses중", "profit\u0301s loss", "\u0130loss dividend", "gains_ 2loss fell"])
def test_keyword_words_are_those_of_the_sql(spark, text):
    import duckdb

    from finstrata.plans.oracles import ORACLES

    duck = duckdb.connect()
    duck.execute("create table documents as select 1::bigint as doc_id, ? as text, 'a' as source, 'en' as lang", [text])
    want = duck.execute(ORACLES["emotion_infer"]).fetchall()
    from finstrata.plans.queries import emotional
    from finstrata.functions.sentiment import EMOTIONS

    rows = spark.createDataFrame([(1, text, "en", "a")], "doc_id long, text string, lang string, source string")
    import tempfile

    folder = tempfile.mkdtemp()
    rows.write.parquet(f"{folder}/documents.parquet")
    got = emotional(spark, folder).select("doc_id", "emotion_label", *(f"emotion_{e}" for e in EMOTIONS)).collect()
    assert [tuple(r) for r in got] == want


def test_long_texts_with_negations_end_soon(spark):
    import time

    words = ["a"] * 300_000 + ["not.,", "no", "never!a;", "b", "n't", "nothing", "knot", "c", "no..."]
    started = time.time()
    assert one(spark, "  ".join(words), X.join_negations).split()[300_000:] == ["not_no", "never!a_b", "n't_nothing", "knot", "c", "no..."]
    assert time.time() - started < 30


def test_treebank_steps_have_all_rules_and_miss_no_match():
    import random
    import re

    first, then = X.TREEBANK_STEPS
    assert [r for _, rules in first for r in rules] == list(X.TREEBANK_FIRST) and [r for _, rules in then for r in rules] == list(X.TREEBANK_THEN)
    rng = random.Random(2)
    pieces = [*"\"'`:,.;@#$%&?![](){}<>- a1Z", "``", "''", "--", "...", "n't", "'LL", "CanNot", "d'ye", "gimme", "lemme", "gonna", "Wanna", "gotta", "more'n", " 'tis", " 'Twas "]
    for _ in range(5000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(6)))
        for marks, rules in (*first, *then):
            if any(re.search(pattern, text) for pattern, _ in rules):
                assert re.search(marks, text) if isinstance(marks, str) else any(m in text for m in marks), (text, rules)

import json
import lzma

from pyspark.sql import functions as F

from finstrata.operators import ingest as I
from finstrata.sources import readers as R
from finstrata.sources import stored as S
from finstrata.streaming import jobs


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps([{"id": "1", "title": "A"}, {"id": "2", "text": "B"}]))
    (tmp_path / "y.json").write_text(json.dumps({"posts": [{"id": "3", "title": "C", "selftext": "D"}]}))
    (tmp_path / "y_meta.json").write_text(json.dumps([{"id": "9"}]))
    (tmp_path / "bad.json").write_text("{")
    assert {r.id for r in R.read_json(spark, str(tmp_path)).collect()} == {"1", "2", "3"}
    (tmp_path / "2020_processed.json.xz").write_bytes(lzma.compress(b'[{"title": "x", "v": NaN}]'))
    assert [(r.year, json.loads(r.article)) for r in R.read_xz_years(spark, str(tmp_path)).collect()] == [(2020, {"title": "x", "v": None})]
    (tmp_path / "2021_processed.json.xz").write_bytes(lzma.compress(b' [ {"t": "a]b", "v": [Infinity, -Infinity, 1]} ,') + lzma.compress('\n{"t": "é🙂"}, {}, "x", 12\n] '.encode()))
    (tmp_path / "2022_processed.json.xz").write_bytes(lzma.compress(b"[]"))
    got = sorted((r.year, r.article) for r in R.read_xz_years(spark, str(tmp_path)).collect())
    assert [(y, json.loads(a)) for y, a in got if y == 2021] == [(2021, x) for x in sorted([{"t": "a]b", "v": [None, None, 1]}, {"t": "é🙂"}, {}, "x", 12], key=json.dumps)] and len(got) == 6
    (tmp_path / "p.csv").write_text("text,source,timestamp,label,confidence\nhi,news,2026-01-01,positive,0.5\nhi,news,2026-01-01,odd,0.5\nhi,news,2026-01-01,neutral,x\n")
    assert R.read_predictions(spark, str(tmp_path / "p.csv")).count() == 1
    assert R.demo_seed(spark).count() == 54


def test_an_archive_is_read_in_pieces(tmp_path):
    import tracemalloc

    row = json.dumps({"title": "a title", "maintext": "some words " * 100})
    packed = lzma.compress(("[" + ",".join([row] * 60_000) + "]").encode(), preset=0)
    tracemalloc.start()
    n = sum(1 for _ in R.articles(packed))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < 20 << 20 < 60_000 * len(row)


def test_records_of_a_mixed_folder_by_their_own_keys(spark, tmp_path):
    from finstrata.operators import preprocess as P

    (tmp_path / "in").mkdir()
    rows = [{"selftext": "a", "subreddit": "s"}, {"text": "b", "author_id": "1"}, {"title": "c", "source_id": None}, {"subreddit": "no body"}, {"title": "d", "retweet_count": 0}, {}, {"url_to_image": "x"}]
    (tmp_path / "in" / "a.json").write_text(json.dumps(rows))
    (tmp_path / "in" / "Tweets_1.json").write_text(json.dumps({"items": [{"selftext": "a", "subreddit": "s"}]}))
    raw = R.read_raw_json(spark, str(tmp_path / "in"))
    kinds = {(r.file.rsplit("/")[-1], r.ordinal): r.kind for r in raw.withColumn("kind", P.source_of(F.col("record"), F.col("file"))).collect()}
    assert [kinds["a.json", i] for i in range(7)] == ["reddit", "twitter", "news", None, "twitter", None, "news"] and kinds["Tweets_1.json", 0] == "twitter"


def test_dedupe_articles_is_the_loop_in_order(spark):
    import random

    random.seed(3)
    rows = [(i, random.choice([None, "", *"abcdefgh"]), random.choice(["T1", "t1", "T2", "T3", "T4", "T5", None])) for i in range(60)]
    urls, titles, want = set(), set(), []
    for i, url, title in rows:
        t = (title or "").lower()
        if (url and url in urls) or t in titles:
            continue
        urls.add(url)
        titles.add(t)
        want.append(i)
    got = I.dedupe_articles(spark.createDataFrame(rows, "ordinal int, url string, title string")).select("ordinal").collect()
    assert sorted(r.ordinal for r in got) == want


def test_posts_last_wins_hints_first(spark):
    rows = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, "h1", "y"), ("a", 3, "h2", "z"), ("b", 1, None, "w")], "id string, ordinal int, hints string, v string")
    assert sorted((r.id, r.v, r.hints) for r in I.dedupe_posts(rows, hints="hints").collect()) == [("a", "z", "h1"), ("b", "w", None)]


def test_import_and_idempotent_insert(spark, tmp_path):
    raw = spark.createDataFrame([("1", "Apple shares surge", "news", "2026-01-02"), ("2", "Nothing here", "news", "1767312000"), ("3", None, "news", None), ("1", "Apple shares surge", "news", "2026-01-02")], "id string, text string, source string, published_at string")
    rows = I.import_records(raw, ["AAPL"], "2026-01-01T00:00:00")
    got = {r.ticker: r for r in rows.collect()}
    assert set(got) == {"AAPL", None} and got["AAPL"].mentioned_as == "Apple" and got["AAPL"].sentiment_label == "positive" and got[None].emotion_label is None
    assert str(got[None].published_at).startswith("2026-01-02")
    path = str(tmp_path / "t")
    assert (S.insert_if_absent(rows, path), S.insert_if_absent(rows, path)) == (2, 0)
    assert S.read(spark, path).count() == 2
    assert I.import_records(raw, ["AAPL"], "2026-01-01T00:00:00", document_fallback=False).count() == 1


def test_prune_purge_upsert(spark):
    rows = spark.createDataFrame([(str(i), i // 2) for i in range(10)], "id string, published_at int")
    kept, gone = I.prune_oldest(rows, 3)
    assert sorted(r.id for r in gone.collect()) == ["0", "1", "2"] and kept.count() == 7
    assert I.prune_oldest(rows, 0)[0].count() == 10
    assert I.purge(spark.createDataFrame([(1,), (None,)], "x int"), F.col("x") == 1).count() == 1
    table, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(tuple(r) for r in I.upsert(table, new, ["k"]).collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_streams(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    schema = "id string, text string, source string, published_at string"
    (landing / "a.json").write_text('{"id": "1", "text": "Tesla crash", "source": "news", "published_at": "2026-01-02"}\n')
    run = lambda: jobs.import_stream(spark, str(landing), schema, str(tmp_path / "out"), str(tmp_path / "cp"), ["TSLA"], "2026-01-01T00:00:00").awaitTermination(120)
    run()
    (landing / "b.json").write_text('{"id": "2", "text": "Tesla rally", "source": "news", "published_at": "2026-01-03"}\n')
    run()
    assert S.read(spark, str(tmp_path / "out")).count() == 2
    events = spark.readStream.schema("id string, sentiment_label string, published_at timestamp").json(str(tmp_path / "ev")) if (tmp_path / "ev").mkdir() is None else None
    (tmp_path / "ev" / "1.json").write_text("".join(json.dumps({"id": str(i), "sentiment_label": "positive", "published_at": f"2026-01-0{1 + i % 2}T10:00:00"}) + "\n" for i in range(4)))
    query = jobs.trend_stream(jobs.distinct_events(events), late=None).writeStream.format("memory").queryName("trend").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_stock_files(spark, tmp_path):
    from finstrata.operators import entities as E

    (tmp_path / "a.json").write_text(json.dumps({"stocks": {"AAPL": {"ticker": "AAPL", "company_name": "Apple Inc.", "common_names": ["Apple", "AAPL"]}, "x": {"company_name": "X Corp", "cik": 3}}, "metadata": {"total_stocks": 2}}))
    (tmp_path / "b.json").write_text(json.dumps({"0": {"cik_str": 1, "ticker": "msft", "title": "MICROSOFT CORP"}, "1": {"cik_str": 2, "ticker": "T", "title": "AT&T INC."}}))
    got = [(r.at, r.ticker, r.company_name, r.common_names) for r in R.read_stocks(spark, str(tmp_path / "a.json")).collect()]
    assert got == [(0, "AAPL", "Apple Inc.", ["Apple", "AAPL"]), (1, "X", "X Corp", [])]
    table = R.read_stocks(spark, str(tmp_path / "b.json"))
    assert {(r.ticker, r.short_name) for r in E.dimension(table).collect()} == {("MSFT", "MICROSOFT"), ("T", "AT&T")}


def test_hints_of_articles_in_order(spark):
    from finstrata.operators import entities as E

    rows = spark.createDataFrame([(1, ["b", "zz"], [("c", "b"), (None, "d")], ["a", "e", "f"]), (2, None, None, None)], "k long, m array<string>, n array<struct<company_key: string, normalized: string>>, r array<string>")
    universe = spark.createDataFrame([(t,) for t in "ABCDEF"], "ticker string")
    got = {r.k: r.hints for r in E.article_hints(rows, "k", F.col("m"), F.col("n"), F.col("r"), universe, 2).collect()}
    assert got == {1: ["B", "C", "D", "A", "E"], 2: []}


def test_pruning_against_a_sort(spark):
    import random

    rng = random.Random(5)
    rows = [(f"k{i}", f"2026-01-0{rng.randrange(1, 4)} {rng.randrange(10, 13)}:0{rng.randrange(3)}:00") for i in range(120)]
    frame = spark.createDataFrame(rows, "id string, t string").select("id", F.col("t").cast("timestamp_ntz").alias("published_at"))
    order = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    for n in (0, 1, 7, 60, 119, 120, 500):
        kept, gone = I.prune_oldest(frame, n)
        assert {r.id for r in gone.collect()} == set(order[:n]) and {r.id for r in kept.collect()} == set(order[n:])

"""From raw records to fact rows: normalising, deduplicating, importing, and the table's sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.functions.columns import first_text, record_id
from finstrata.functions.sentiment import Scorer, emotion_scores, entropy, keyword_scorer, rationale, scored_aspects, with_emotion
from finstrata.functions.text import clean_news, clean_tweet, tags
from finstrata.operators.names import detect_tickers
from finstrata.plans.tables import settle

DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd MMM yyyy", "dd MMM yyyy HH:mm:ss Z")


def pick(rows: DataFrame, *names: str) -> Column:
    """The first of these columns that isn't blank; columns that aren't there are passed over."""
    there = [F.col(f"`{n}`").cast("string") for n in names if n in rows.columns]
    return first_text(*there) if there else F.lit(None).cast("string")


def parse_time(text: Column) -> Column:
    """Unix seconds (or milliseconds, beyond 1e12), ISO, or one of DATE_FORMATS; null if it is none of them."""
    number = text.cast("string").try_cast("double")
    seconds = F.timestamp_seconds(F.when(number > 1e12, number / 1000).otherwise(number))
    return F.coalesce(seconds, text.try_cast("timestamp"), *(F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), F.lit(f)) for f in DATE_FORMATS)).cast("timestamp_ntz")


def normalize_records(rows: DataFrame, now: str) -> DataFrame:
    """text, source, source_id, data_source, published_at of records of any kind; rows without text go.

    ``now`` is the time of records that have none that can be read.
    """
    has = lambda c: pick(rows, c).isNotNull()
    title, body = pick(rows, "title"), pick(rows, "selftext")
    text = F.when(title.isNotNull() & body.isNotNull(), F.concat_ws("\n\n", title, body)).otherwise(F.coalesce(title, pick(rows, "text", "clean_title", "headline", "content", "clean_content", "description", "body", "raw_text")))
    channel = F.coalesce(F.lower(pick(rows, "data_source")), F.when(has("subreddit"), "reddit").when(has("author_id"), "twitter").when(has("source_name") | has("clean_title"), "news"))
    times = [parse_time(F.col(c)) for c in ("created_utc", "published_at", "publishedAt", "created_at", "timestamp") if c in rows.columns]
    return rows.select(
        text.alias("text"), F.substring(F.coalesce(F.lower(pick(rows, "source_name", "subreddit", "source")), F.lit("unknown")), 1, 64).alias("source"), F.coalesce(pick(rows, "source_id", "id", "url"), F.lit("")).alias("source_id"),
        channel.alias("data_source"), F.coalesce(*times, F.lit(now).cast("timestamp_ntz")).alias("published_at"),
    ).filter("text is not null")


def normalize_article(rows: DataFrame) -> DataFrame:
    """Flat columns of a news article (source is a struct), and its three cleaned texts."""
    return rows.select(
        F.lit("news").alias("data_source"), F.col("source.id").alias("source_id"), F.col("source.name").alias("source_name"), "author", "title", "description", "url", F.col("publishedAt").alias("published_at"), "content",
        *(clean_news(F.col(c)).alias(f"clean_{c}") for c in ("title", "description", "content")),
    )


def normalize_tweet(rows: DataFrame) -> DataFrame:
    """Flat columns of a post from the API (public_metrics is a struct); missing metrics are 0."""
    metrics = ("retweet_count", "reply_count", "like_count")
    return rows.select("id", F.lit("twitter").alias("data_source"), clean_tweet(F.col("text")).alias("text"), F.col("text").alias("raw_text"), "author_id", "created_at", *(F.coalesce(F.col(f"public_metrics.{m}"), F.lit(0)).alias(m) for m in metrics))


def normalize_scraped(rows: DataFrame) -> DataFrame:
    """Flat columns of a scraped post (user is a struct, cashtags an array); its own tags count first, else those of its text."""
    number = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    own = F.array_distinct(F.filter(F.transform(F.coalesce("cashtags", F.array().cast("array<string>")), lambda t: F.upper(F.regexp_replace(F.trim(t), r"^\$+", ""))), lambda t: t != ""))
    hints = F.when(F.size(own) > 0, own).otherwise(tags(F.col("rawContent")))
    return rows.select(
        F.coalesce(F.col("id").try_cast("long"), F.lit(0)).alias("id"), F.lit("twitter").alias("data_source"), clean_tweet(F.col("rawContent")).alias("text"), F.coalesce("rawContent", F.lit("")).alias("raw_text"), hints.alias("hint_tickers"),
        F.col("user.id").cast("string").alias("author_id"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), number("retweetCount").alias("retweet_count"), number("replyCount").alias("reply_count"), number("likeCount").alias("like_count"),
        number("quoteCount").alias("quote_count"), "lang",
    )


def normalize_table_tweet(rows: DataFrame) -> DataFrame:
    """Flat columns of a row (Date, Tweet, Stock Name) of a table of posts: the stock's name is the first hint; ids are hashes of the content."""
    raw, stock = F.trim(F.coalesce("Tweet", F.lit(""))), F.upper(F.trim(F.coalesce("Stock Name", F.lit(""))))
    hints = F.when(stock != "", F.array_distinct(F.concat(F.array(stock), tags(raw)))).otherwise(tags(raw))
    zero = [F.lit(0).alias(c) for c in ("retweet_count", "reply_count", "like_count", "quote_count")]
    none = lambda name: F.lit(None).cast("string").alias(name)
    return rows.select(F.abs(F.xxhash64("Date", "Tweet", "Stock Name") % 10**12).alias("id"), F.lit("twitter").alias("data_source"), clean_tweet(raw).alias("text"), raw.alias("raw_text"), hints.alias("hint_tickers"), none("author_id"), F.nullif(F.trim("Date"), F.lit("")).alias("created_at"), *zero, none("lang"))


def cleaned_name(name: Column, otherwise: str) -> Column:
    """A publisher's name in one line of 80 characters at most."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit(otherwise)), r"\s+", " ")), 1, 80)


def content_id(*parts: Column) -> Column:
    """32 hex digits of the parts' SHA-256."""
    return F.substring(F.sha2(F.concat(*parts).cast("binary"), 256), 1, 32)


def headline_records(rows: DataFrame, universe: list[str], shortest: int = 12) -> DataFrame:
    """Records of a headline table: cleaned titles of ``shortest`` characters or more, an id from URL and title, a hint if the stock is known."""
    url = F.coalesce(pick(rows, "url"), F.lit(""))
    title = clean_news(F.coalesce(pick(rows, "headline", "title", "text"), F.lit("")))
    symbol = F.upper(F.regexp_replace(F.trim(F.coalesce(pick(rows, "stock", "ticker"), F.lit(""))), r"^\$+", ""))
    rows = rows.withColumns({"_title": title, "_url": url, "_symbol": symbol}).filter(F.length("_title") >= shortest)
    return rows.select(
        F.lit("news").alias("data_source"), cleaned_name(pick(rows, "publisher", "source"), "hf_financial_news").alias("source_name"), content_id(F.col("_url"), F.lit("\n"), F.substring("_title", 1, 200)).alias("source_id"),
        F.col("_title").alias("title"), F.nullif(F.substring("_url", 1, 500), F.lit("")).alias("url"), F.when(F.col("_symbol").isin(universe), F.array("_symbol")).alias("hint_tickers"),
    )


def archive_records(rows: DataFrame, english_only: bool = True, longest: int = 12_000) -> DataFrame:
    """Records of archived articles: in English if asked for (an unknown language passes), not too short, bodies cut at ``longest``."""
    if english_only:
        rows = rows.filter(F.coalesce(F.lower("language").isin("en", "eng"), F.lit(True)))
    rows = rows.withColumns({"_title": clean_news(F.coalesce(pick(rows, "title", "title_rss"), F.lit(""))), "_body": clean_news(F.coalesce(pick(rows, "maintext", "description"), F.lit("")))})
    rows = rows.filter(~((F.length("_title") < 6) & (F.length("_body") < 30)))
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(F.col(c))
    url, file = F.coalesce(pick(rows, "url"), F.lit("")), F.coalesce(pick(rows, "filename"), F.lit(""))
    return rows.select(
        F.lit("news").alias("data_source"), cleaned_name(pick(rows, "news_outlet", "source_domain"), "yahoo_finance").alias("source_name"), content_id(F.substring(F.when(url != "", url).otherwise(file), 1, 800)).alias("source_id"),
        F.when(F.col("_title") != "", F.col("_title")).otherwise(cut("_body", 240)).alias("title"), cut("_body", longest).alias("selftext"), F.nullif(F.substring(url, 1, 500), F.lit("")).alias("url"),
    )


def dedupe_posts(rows: DataFrame, key: str = "id", ordinal: str = "ordinal", hints: str | None = None) -> DataFrame:
    """One row for each id: the last, with the first hints that aren't null."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ordinal)))
    if hints:
        rows = rows.withColumn(hints, F.first(hints, ignorenulls=True).over(Window.partitionBy(key).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.withColumn("_k", last).filter("_k = 1").drop("_k")


def dedupe_articles(rows: DataFrame, url: str = "url", title: str = "title", ordinal: str = "ordinal") -> DataFrame:
    """Keeps an article unless one kept before it has its URL, or its title without case. A blank URL matches nothing, a blank title
    matches other blank titles. Ordinals are unique.

    This is what a loop in order does. In rounds: a row that is the first open one of both its URL and its title is kept, then
    rows that share a key with a kept one are dropped. The first rows of keys are found by an aggregate and joined by ordinal, so
    a key that many rows have is no task's burden. Each round keeps the first open row at least; long chains of alternating
    keys take more rounds.
    """
    from finstrata.plans.tables import settle

    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    open_ = settle(rows.withColumn("_url", blank(F.col(url))).withColumn("_title", F.coalesce(F.lower(title), F.lit(""))))
    kept = None
    while not open_.isEmpty():
        for c in ("_url", "_title"):
            first = open_.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min(ordinal).alias(f"_first{c}")).drop(c)
            open_ = open_.join(first, F.col(ordinal) == F.col(f"_first{c}"), "left")
        x = settle(open_.withColumn("_keep", (F.col("_url").isNull() | F.col("_first_url").isNotNull()) & F.col("_first_title").isNotNull()).drop("_first_url", "_first_title"))
        won = x.filter("_keep")
        kept = won if kept is None else kept.unionByName(won)
        open_ = x.filter("not _keep")
        for c in ("_url", "_title"):
            open_ = open_.join(won.select(F.col(c).alias("_w")).distinct(), F.col(c) == F.col("_w"), "left_anti")
        open_ = settle(open_.drop("_keep"))
    return (open_ if kept is None else kept.drop("_keep")).drop("_url", "_title")


def import_records(rows: DataFrame, universe: list[str], now: str, scorer: Scorer = keyword_scorer, document_fallback: bool = True) -> DataFrame:
    """Raw records to fact rows: normalise, score, enrich, one row for each ticker; without any, a document row (or none)."""
    docs = normalize_records(rows, now).withColumn("doc", record_id("r", F.col("source"), F.col("source_id"), F.col("text"))).dropDuplicates(["doc"])
    docs = settle(docs)  # read several times
    scored = scorer(docs, "text")
    shares = [F.col(f"score_{x}") for x in ("positive", "negative", "neutral")]
    scored = scored.withColumn("sentiment_uncertainty", entropy(*shares))
    scored = scored.withColumn("rationale", rationale(F.col("sentiment_label"), F.col("sentiment_score"), *shares, F.col("sentiment_uncertainty")))
    scored = scored.join(scored_aspects(docs, "doc", "text", scorer), "doc", "left")
    scored = emotion_scores(scored, F.col("text"), F.col("sentiment_label"), F.col("sentiment_score"), F.col("sentiment_uncertainty"), F.col("aspects"), tuple(shares))
    scored = with_emotion(scored, "sentiment_uncertainty")
    found = detect_tickers(docs, "doc", "text", universe).drop("position")
    out = scored.join(found, "doc", "left" if document_fallback else "inner")
    stock = F.col("ticker").isNotNull()
    return out.select(
        F.when(stock, record_id("stock", F.col("source"), F.col("source_id"), F.col("ticker"), F.col("mentioned_as"))).otherwise(record_id("doc", F.col("source"), F.col("source_id"), F.lit(""))).alias("id"),
        "text", "ticker", F.coalesce("mentioned_as", F.lit("")).alias("mentioned_as"), "sentiment_label", "sentiment_score", "score_positive", "score_negative", "score_neutral", "sentiment_uncertainty", "rationale",
        F.to_json(F.coalesce("aspects", F.expr("cast(array() as array<struct<aspect:string,snippet:string,label:string,score:double>>)"))).alias("aspects_json"),
        F.when(stock, F.col("emotion_label")).alias("emotion_label"), "source", "data_source", "source_id", "published_at",
    )


def new_rows(rows: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key isn't there yet, each key once."""
    return rows.dropDuplicates([key]).join(existing.select(key).distinct(), key, "left_anti")


def upsert(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table after rows replaced those of the same keys."""
    return existing.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def prune_oldest(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes): the n oldest by (published_at, id) go. Counts by hour tell the hour in which the n-th is; of that
    hour's rows alone the first are taken in order, however large n is."""
    order, times = F.struct("published_at", "id"), rows.schema["published_at"].dataType.typeName().startswith("timestamp")
    hour = F.date_trunc("hour", "published_at") if times else F.col("published_at")
    hours = rows.groupBy(hour.alias("_hour")).agg(F.count("*").alias("_n"))  # a row for each hour
    earlier = Window.orderBy(F.asc_nulls_first("_hour")).rowsBetween(Window.unboundedPreceding, -1)
    within = hours.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).filter(F.col("_before") < n)
    last = within.agg(F.max(F.struct("_before", "_hour")).alias("_l")).select("_l.*")
    there = rows.join(F.broadcast(last), hour.eqNullSafe(F.col("_hour")) & F.col("_before").isNotNull()).select("published_at", "id", "_before")
    first = there.withColumn("_k", F.row_number().over(Window.orderBy("published_at", "id"))).filter(F.col("_k") <= n - F.col("_before"))
    cut = first.agg(F.max(order).alias("cut"))
    marked = rows.join(F.broadcast(cut)).withColumn("old", F.coalesce(order <= F.col("cut"), F.lit(False))).drop("cut")
    return marked.filter("not old").drop("old"), marked.filter("old").drop("old")


def prune_preview(gone: DataFrame) -> DataFrame:
    return gone.agg(F.count("*").alias("rows"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))


def purge(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows of which the condition doesn't hold, or can't be told."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def backfill(rows: DataFrame, column: str, value: Column, where: Column) -> DataFrame:
    return rows.withColumn(column, F.when(F.col(column).isNull() & where, value).otherwise(F.col(column)))


def export(rows: DataFrame, path: str, form: str = "json", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> DataFrame:
    """Writes rows as JSON, CSV or Parquet, in place of what is there or beside it, and returns one row of metadata: their number and
    sources. sources.stored keeps tables that change in whole steps."""
    rows.write.mode(mode).partitionBy(*partition_by).format(form).option("header", True).save(path)
    return rows.agg(F.count("*").alias("rows"), F.sort_array(F.collect_set("source")).alias("sources"))


def stratified_sample(rows: DataFrame, key: str, per_label: int = 12, in_all: int = 36, cut: int = 260) -> DataFrame:
    """Up to ``per_label`` rows of each label, in hash order, then others until there are ``in_all``; texts are cut."""
    order = F.xxhash64(key)
    x = rows.withColumn("k", F.row_number().over(Window.partitionBy("sentiment_label").orderBy(order, key)))
    chosen = x.orderBy(F.when(F.col("k") <= per_label, 0).otherwise(1), order, key).limit(in_all)
    return chosen.withColumn("text", F.substring("text", 1, cut)).drop("k")


def excerpts(rows: DataFrame, text: str, key: str, prefix: int = 80) -> DataFrame:
    """One row for each beginning of a text: that with the smallest key. Beginnings are summed up before rows meet."""
    rows = rows.withColumn("_start", F.substring(text, 1, prefix))
    first = rows.groupBy("_start").agg(F.min(key).alias("_key")).withColumnRenamed("_start", "_of")
    found = rows.join(first, F.col("_start").eqNullSafe(F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    return found.dropDuplicates(["_start", "_key"]).drop("_start", "_of", "_key")

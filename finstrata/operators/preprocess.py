"""Preprocessing of raw records by preset, checks of records, and projections for people and services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstrata.functions.columns import half_up
from finstrata.functions.text import lemmatize, normalize_text, remove_stop_words, tokens

# What each preset does, and the text fields of each kind of source.
PRESETS = {
    "minimal": {"stop_words": False, "lemmas": False, "normalize": {}},
    "standard": {"stop_words": True, "lemmas": False, "normalize": {}},
    "full": {"stop_words": True, "lemmas": True, "normalize": {}},
    "finbert": {"stop_words": False, "lemmas": False, "normalize": {"lower": False, "keep_financial": True, "negations": True}},
}
SOURCE_FIELDS = {"reddit": ("title", "selftext"), "twitter": ("text",), "news": ("title", "description", "content")}
# Limits of a record's fields.
SHORTEST_TEXT, LONGEST_TEXT, LONGEST_TICKER, LONGEST_CONTEXT = 15, 2000, 10, 500
WARN_CHARS, MOST_CHARS = 10_000, 50_000


def source_type(rows: DataFrame, path: Column | None = None) -> Column:
    """reddit, twitter or news: by the file's path, else by the columns that a kind of record has."""
    by_path = None
    for kind in SOURCE_FIELDS:
        if path is not None:
            by_path = F.coalesce(by_path, F.when(F.lower(path).contains(kind), kind)) if by_path is not None else F.when(F.lower(path).contains(kind), kind)
    by_columns = "reddit" if "subreddit" in rows.columns else "twitter" if "author_id" in rows.columns else "news"
    return F.coalesce(by_path, F.lit(by_columns)) if by_path is not None else F.lit(by_columns)


def source_of(record: Column, path: Column | None = None) -> Column:
    """reddit, twitter or news, for each record by itself: by its file's path, else by the keys that its JSON has; null if they don't tell."""
    keys = F.json_object_keys(record)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    kind = F.when(has("selftext") & has("subreddit"), "reddit").when(has("retweet_count") | has("author_id"), "twitter").when(has("source_id") | has("url_to_image"), "news")
    if path is None:
        return kind
    low = F.lower(path)
    return F.when(low.contains("reddit"), "reddit").when(low.contains("twitter") | low.contains("tweet"), "twitter").when(low.contains("news"), "news").otherwise(kind)


def preprocess(rows: DataFrame, fields: tuple[str, ...], preset: str = "standard", stop_words: tuple[str, ...] = ()) -> DataFrame:
    """Adds <field>_tokens and <field>_processed for each text field."""
    how = PRESETS[preset]
    for f in fields:
        words = tokens(normalize_text(F.col(f), **how["normalize"]))
        if how["stop_words"]:
            words = remove_stop_words(words, stop_words)
        if how["lemmas"]:
            words = lemmatize(words)
        rows = rows.withColumn(f"{f}_tokens", words).withColumn(f"{f}_processed", F.array_join(f"{f}_tokens", " "))
    return rows


def preprocess_stats(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Records, tokens, and tokens a record."""
    n = sum((F.size(f"{f}_tokens") for f in fields), F.lit(0))
    x = rows.agg(F.count("*").alias("total_records"), F.coalesce(F.sum(n), F.lit(0)).alias("total_tokens"))
    return x.withColumn("avg_tokens_per_record", half_up(F.coalesce(F.try_divide(F.col("total_tokens").cast("double"), "total_records"), F.lit(0.0)), 2))


def write_preprocessed(rows: DataFrame, path: str, fields: tuple[str, ...], preset: str = "standard") -> DataFrame:
    """Writes preprocessed records as JSON by source type, and returns preprocess_stats()."""
    done = preprocess(rows.withColumn("source_type", source_type(rows)), fields, preset)
    done.write.mode("overwrite").partitionBy("source_type").json(path)
    return preprocess_stats(done, fields)


def violations(rows: DataFrame) -> Column:
    """The names of the limits that a record (text, sentiment_score, ticker, context) breaks; empty if none."""
    size = F.length(F.coalesce("text", F.lit("")))
    broken = [F.when(~size.between(SHORTEST_TEXT, LONGEST_TEXT), "text"), F.when(~F.coalesce(F.col("sentiment_score").between(0, 1), F.lit(False)), "score")]
    if "ticker" in rows.columns:
        broken.append(F.when(F.length("ticker") > LONGEST_TICKER, "ticker"))
    if "context" in rows.columns:
        broken.append(F.when(F.length("context") > LONGEST_CONTEXT, "context"))
    return F.array_compact(F.array(*broken))


def guard(text: Column) -> Column:
    """ok, long (worth a warning), or why a text can't be scored: empty, too_long."""
    size = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(size == 0, "empty").when(size > MOST_CHARS, "too_long").when(size > WARN_CHARS, "long").otherwise("ok")


def metadata(rows: DataFrame, columns: tuple[str, ...], parsed: dict[str, str]) -> DataFrame:
    """Adds metadata: a JSON object of the columns that aren't null, and of JSON columns (name -> type) as what they hold."""
    return rows.withColumn("metadata", F.to_json(F.struct(*columns, *(F.from_json(c, kind).alias(c) for c, kind in parsed.items()))))


def annotation_task(rows: DataFrame, order: str, text: str = "text") -> DataFrame:
    """(idx, text) without labels, idx being the row's place in the order, from 0.

    Places are added up from counts by range of the order, so no task sees all rows. Ranges are written first: read twice, a plan may put
    them together in different ways, and their numbers wouldn't agree.
    """
    from pyspark.sql import Window

    from finstrata.plans.tables import settle

    dealt = settle(rows.select(F.col(order).alias("o"), F.col(text).alias("text")).repartitionByRange("o").withColumn("part", F.spark_partition_id()))
    dealt = dealt.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("o", "text")))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(before.select(F.col("part").alias("p"), "before"), F.col("part") == F.col("p")).select((F.col("before") + F.col("at") - 1).alias("idx"), "text")


def classify_column(rows: DataFrame, text: str, now: str, times: tuple[str, ...] = ("timestamp", "created_at", "date", "published_at"), ids: tuple[str, ...] = ("id", "source_id", "url")) -> DataFrame:
    """Document rows from any text column of a CSV: the first usable time and id, and the default scorer's label."""
    from finstrata.functions.columns import record_id
    from finstrata.functions.sentiment import keyword_scorer
    from finstrata.operators.ingest import parse_time, pick

    at = [parse_time(F.col(c)) for c in times if c in rows.columns]
    key = F.coalesce(pick(rows, *ids), F.md5(F.col(text).cast("binary")))
    out = rows.filter(F.length(F.trim(text)) > 0).select(record_id("doc", F.lit("csv"), key, F.lit("")).alias("id"), F.col(text).alias("text"), F.coalesce(*at, F.lit(now).cast("timestamp_ntz")).alias("published_at"))
    return keyword_scorer(out, "text").select("id", "text", "sentiment_label", "sentiment_score", "published_at")

"""Readers of landed files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys under which an object file may hold its records, by precedence.
ENVELOPES = ("items", "records", "data", "posts", "articles", "tweets")
#: Fields that records of any kind may have; all are read as text.
FIELDS = """id title selftext author subreddit score num_comments created_utc url text author_id created_at description content publishedAt
published_at source_id source_name data_source clean_title clean_description clean_content raw_text body headline timestamp date hint_tickers source""".split()
RECORD = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])


def read_json(spark: SparkSession, directory: str) -> DataFrame:
    """The records of all JSON files below a directory but *_meta.json: a list's, or those of an object's first list.

    A file that can't be read has none. Returns FIELDS, file, and ordinal (the record's place in its file).
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(directory)
    files = files.withColumn("file", F.col("_metadata.file_path")).filter(~F.col("file").endswith("_meta.json"))
    rows = T.ArrayType(RECORD)
    plain = F.from_json("value", rows)
    held = F.from_json("value", T.StructType([T.StructField(k, rows) for k in ENVELOPES]))
    found = F.when(F.ltrim("value").startswith("["), plain).otherwise(F.coalesce(*(held[k] for k in ENVELOPES)))
    return files.select("file", F.posexplode(found).alias("ordinal", "r")).filter("r is not null").select("r.*", "file", "ordinal")


def read_raw_json(spark: SparkSession, directory: str) -> DataFrame:
    """(file, ordinal, record): like read_json(), each record as JSON with the keys that it has itself."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(directory)
    files = files.withColumn("file", F.col("_metadata.file_path")).filter(~F.col("file").endswith("_meta.json"))
    rows = T.ArrayType(T.StringType())
    held = F.from_json("value", T.StructType([T.StructField(k, rows) for k in ENVELOPES]))
    found = F.when(F.ltrim("value").startswith("["), F.from_json("value", rows)).otherwise(F.coalesce(*(held[k] for k in ENVELOPES)))
    return files.select("file", F.posexplode(found).alias("ordinal", "record")).filter("record is not null")


def read_stocks(spark: SparkSession, path: str) -> DataFrame:
    """(at, ticker, company_name, common_names): the stocks of a JSON file, in its order, for entities.dimension(). It maps tickers to
    stocks under the key ``stocks``, or, as it is published, numbers to (ticker, title)."""
    stock, published = "struct<ticker: string, company_name: string, common_names: array<string>>", "struct<ticker: string, title: string>"
    files = spark.read.option("wholetext", True).text(path)
    saved = F.from_json("value", f"stocks map<string, {stock}>")["stocks"]
    own = F.transform(F.map_entries(saved), lambda e: F.struct(F.coalesce(e["value"]["ticker"], e["key"]).alias("ticker"), e["value"]["company_name"].alias("company_name"), e["value"]["common_names"].alias("common_names")))
    other = F.transform(F.map_values(F.from_json("value", f"map<string, {published}>")), lambda v: F.struct(v["ticker"].alias("ticker"), v["title"].alias("company_name"), F.lit(None).cast("array<string>").alias("common_names")))
    rows = files.select(F.posexplode(F.when(saved.isNotNull(), own).otherwise(other)).alias("at", "s")).filter("s.ticker is not null")
    return rows.select(F.col("at").cast("long").alias("at"), F.upper("s.ticker").alias("ticker"), "s.company_name", F.coalesce("s.common_names", F.array().cast("array<string>")).alias("common_names"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; all columns are text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_tweets_csv(spark: SparkSession, path: str, keywords: list[str], limit: int | None = None) -> DataFrame:
    """Rows (Date, Tweet, Stock Name) with any of the keywords, in file order; ids are hashes of the content."""
    rows = read_csv(spark, path).withColumn("ordinal", F.monotonically_increasing_id())
    low = F.lower("Tweet")
    if keywords:
        rows = rows.filter(F.exists(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.contains(low, k)))
    rows = rows.select(F.xxhash64("Date", "Tweet", "Stock Name").alias("id"), F.lit("twitter").alias("data_source"), F.col("Tweet").alias("text"), F.col("Date").alias("created_at"), F.array(F.col("Stock Name")).alias("hint_tickers"), "ordinal")
    return rows.orderBy("ordinal").limit(limit) if limit else rows


def articles(content: bytes, at_once: int = 1 << 20) -> Iterator[str]:
    """The elements of an xz-packed JSON array, each as JSON; NaN and infinities are null. It is unpacked and read a piece at a time: what
    is held is the packed bytes, one piece, and the element that it ends in."""
    import codecs
    import io
    import json
    import lzma

    decoder, text = json.JSONDecoder(parse_constant=lambda _: None), codecs.getincrementaldecoder("utf-8")()
    held, at, begun = "", 0, False
    with lzma.open(io.BytesIO(content)) as file:
        while piece := file.read(at_once):
            held, at = held[at:] + text.decode(piece), 0
            while True:
                while at < len(held) and held[at] in " \t\r\n," or not begun and held[at : at + 1] == "[":
                    begun |= held[at] == "["
                    at += 1
                if at == len(held) or held[at] == "]":
                    break
                try:
                    value, end = decoder.raw_decode(held, at)
                except json.JSONDecodeError:
                    break  # goes on in the next piece
                if end == len(held):  # a number might go on
                    break
                yield json.dumps(value)
                at = end
    if held[at:].strip() != "]":
        raise ValueError(f"the array ends in {held[at : at + 80]!r}")


def read_xz_years(spark: SparkSession, directory: str) -> DataFrame:
    """(year, article): the articles of YYYY_processed.json.xz, as JSON; see articles()."""

    def opened(batches: Iterator) -> Iterator:
        import re
        from itertools import batched

        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                found = re.search(r"(\d{4})_processed", path.as_py())
                year = int(found[1]) if found else None
                for some in batched(articles(content.as_py()), 1000):
                    yield pa.RecordBatch.from_pydict({"year": pa.array([year] * len(some), pa.int32()), "article": pa.array(some, pa.string())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_processed.json.xz").load(directory)
    return files.select("path", "content").mapInArrow(opened, "year int, article string")


def read_predictions(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Prediction rows of a CSV or JSON file by its ending; rows that aren't valid are left out, or, if strict, raise."""
    rows = spark.read.json(path, multiLine=True) if path.endswith(".json") else read_csv(spark, path)
    rows = rows.withColumn("confidence", F.expr("try_cast(confidence as double)"))
    why = invalid(rows)
    if strict:
        return rows.filter(F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("invalid prediction: "), why)).cast("boolean")).otherwise(True))
    return rows.filter(why.isNull())


def invalid(rows: DataFrame) -> Column:
    """Why a row is no valid prediction; null if it is one."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(blank("text"), "text")
        .when(blank("source"), "source")
        .when(~F.coalesce(F.col("label"), F.lit("")).isin("positive", "negative", "neutral"), "label")
        .when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "confidence")
        .when(F.expr("try_cast(timestamp as timestamp)").isNull(), "timestamp")
    )


def demo_seed(spark: SparkSession) -> DataFrame:
    """54 rows: 12 templates in four cycles, 13 days apart, and 6 documents."""
    labels, sources, tickers = ("positive", "negative", "neutral"), ("reddit", "news", "twitter"), ("AAPL", "TSLA", "NVDA", "MSFT")
    templates = spark.createDataFrame([(i, tickers[i % 4], labels[i % 3], sources[(i // 2) % 3]) for i in range(12)], "t int, ticker string, sentiment_label string, data_source string")
    cycles = spark.range(4).select(F.col("id").cast("int").alias("cycle"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("t"))
    at = lambda days: F.expr(f"timestamp_ntz '2026-01-01 12:00:00' + make_dt_interval({days})")
    stocks = cycles.join(F.broadcast(templates), "t").select(F.concat_ws("_", F.lit("demo"), "cycle", "t").alias("id"), "ticker", "sentiment_label", F.lit(0.75).alias("sentiment_score"), "data_source", at("cycle * 13 + t").alias("published_at"))
    documents = spark.range(6).select(F.concat(F.lit("demo_doc_"), F.col("id").cast("string")).alias("id"), F.lit(None).cast("string").alias("ticker"), F.lit("neutral").alias("sentiment_label"), F.lit(0.6).alias("sentiment_score"), F.lit("news").alias("data_source"), at("cast(id as int)").alias("published_at"))
    return stocks.unionByName(documents)

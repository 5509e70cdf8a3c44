"""Streams: files that land are imported once each, and a trend is kept by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from finstrata.functions.columns import count_of, half_up, net
from finstrata.operators.ingest import import_records
from finstrata.sources.stored import insert_if_absent, rows_in


def import_stream(spark: SparkSession, landing: str, schema, table_path: str, checkpoint: str, universe: list[str], now: str, form: str = "json", files_per_batch: int = 100, most: int | None = None) -> StreamingQuery:
    """Imports the files of a folder in micro-batches and ends when there are no more, or when the table has ``most`` rows.

    The checkpoint remembers what was read; replayed batches add nothing, as a row's id comes from its content. Each batch becomes
    part of the table as a whole, and the table's list counts its rows, so the limit holds over restarts too.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(landing)

    def flush(batch: DataFrame, _: int) -> None:
        if most is None or rows_in(spark, table_path) < most:
            insert_if_absent(import_records(batch, universe, now), table_path, most=most)

    query = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while most is not None and query.isActive:
        if rows_in(spark, table_path) >= most:
            query.stop()
        query.awaitTermination(1)
    return query


def distinct_events(events: DataFrame, key: str = "id", time: str = "published_at", late: str = "1 day") -> DataFrame:
    """Each key once, as long as repeats come within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def trend_stream(events: DataFrame, time: str = "published_at", late: str | None = "2 days", width: str = "1 day") -> DataFrame:
    """The daily trend by event time; a day is final once the watermark has passed it. late: None if the stream has a watermark."""
    days = (events.withWatermark(time, late) if late else events).groupBy(F.window(time, width))
    out = days.agg(F.count("*").alias("total"), count_of("sentiment_label", "positive").alias("positive"), count_of("sentiment_label", "negative").alias("negative"))
    return out.select(F.to_date("window.start").alias("day"), "total", half_up(net(F.col("positive"), F.col("negative"), F.col("total")), 4).alias("net"))

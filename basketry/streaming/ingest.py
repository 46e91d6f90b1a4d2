"""Receipts as a stream: new files of a folder to daily item counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.sources import receipts
from basketry.streaming.history import first_arrivals


def receipt_stream(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.readStream.schema("value string").text(path, wholetext=True)
    return receipts.events(receipts.parse(raw.select(F.col("_metadata.file_name").alias("source"), "value")))


def without_copies(parsed: DataFrame, keep: str | None = None) -> DataFrame:
    """Parsed receipts without those that came in another file already: of receipts with one date, time and multiset of items one stays. On a stream that is one of the first batch to bring it, known for good, or with keep (such as "30 days") for that time from then, whatever the receipt's date: older receipts come out whenever they arrive. keep needs a session with a RocksDB state store, see history.state_session. Receipts without a date go."""
    line = F.transform("items", lambda i: F.concat_ws("|", i["item"], i["qty"].cast("string")))
    signature = F.sha2(F.array_join(F.array_sort(line), "\n"), 256)
    day = F.coalesce(F.try_to_timestamp("date", F.lit("M/d/yyyy")), F.try_to_timestamp("date", F.lit("M/d/yy")))
    dated = parsed.withColumns({"_at": day, "_signature": signature, "_time": F.coalesce("time", F.lit(""))}).where("_at IS NOT NULL")
    keys = ["_at", "_time", "_signature"]
    alone = first_arrivals(dated, keys, keep) if parsed.isStreaming and keep else dated.dropDuplicates(keys)
    return alone.drop(*keys)


def daily_counts(events: DataFrame, late: str | None = None) -> DataFrame:
    """Purchases of each item and day. Without `late`, every event counts whenever it comes, and state grows with items and days; with it, days older than the watermark are final and what comes for them is lost."""
    timed = events.withColumn("ts", F.col("d").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    return timed.groupBy(F.window("ts", "1 day"), "item").agg(F.sum("qty").alias("qty"))

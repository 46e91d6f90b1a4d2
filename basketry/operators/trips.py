"""Trips: gaps between them, receipts, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trip_gaps(dates: DataFrame) -> DataFrame:
    """Of distinct trip dates d (few, so one ordered window is fine): days since the last trip, and the mean of the gaps so far."""
    w = Window.orderBy("d")
    gap = F.coalesce(F.datediff("d", F.lag("d").over(w)), F.lit(0))
    rows = dates.select("d").distinct().withColumn("gap", gap)
    return rows.withColumn("avg_gap", F.coalesce(F.avg(F.nullif("gap", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))


def drop_copied_receipts(lines: DataFrame) -> DataFrame:
    """Of (source, d, t, item, qty): of sources with the same date, time and multiset of lines only the smallest stays; rows without a date go."""
    signature = F.concat_ws("|", F.col("d").cast("string"), "t", "item", F.col("qty").cast("string"))
    dated = lines.where("d IS NOT NULL")
    each = dated.groupBy("d", "t", "source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(signature)), "\n"), 256).alias("signature"))
    keep = each.groupBy("d", "t", "signature").agg(F.min("source").alias("source")).select("source").distinct()
    return dated.join(keep, "source", "left_semi")


def reconcile(expected: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """Left join with an indicator: left_only or both."""
    marked = found.withColumn("_found", F.lit(True))
    return expected.join(marked, on, "left").withColumn("indicator", F.when(F.col("_found"), "both").otherwise("left_only")).drop("_found")

"""How regularly items are bought."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def habit_features(days: DataFrame, items: DataFrame | None = None, tau: float = 120.0) -> DataFrame:
    """Of (item_id, d), a row per purchase day: per item the share of trips with it (habitFrequency), its span in the timeline (habitSpan) and how recent it is (habitDecay, exp(-days / tau)). With items (item_id), those never bought are 0, 0, 0. A timeline of no days counts as one."""
    line = days.agg(F.countDistinct("d").alias("trips"), F.greatest(F.lit(1), F.datediff(F.max("d"), F.min("d"))).alias("line"), F.max("d").alias("last_d"))
    own = days.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).crossJoin(F.broadcast(line))
    out = own.select(
        "item_id",
        (F.col("n") / F.col("trips")).alias("habitFrequency"),
        (F.datediff("high", "low") / F.col("line")).alias("habitSpan"),
        F.exp(-F.datediff("last_d", "high") / F.lit(tau)).alias("habitDecay"),
    )
    if items is None:
        return out
    return items.select("item_id").distinct().join(out, "item_id", "left").na.fill(0.0)


def total_purchases(panel: DataFrame, label: str = "buy") -> DataFrame:
    """(item_id, n): purchases of each item of a panel. An item without any is an error."""
    totals = panel.groupBy("item_id").agg(F.count_if(F.col(label) == 1).alias("n"))
    checked = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("no purchase of item "), F.col("item_id").cast("string"))).cast("long"))
    return totals.select("item_id", checked.alias("n"))

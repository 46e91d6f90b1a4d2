"""Training panels and predictions, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import calendar as C
from basketry.operators import panel, recency as R


def features(rows: DataFrame) -> DataFrame:
    """The features of a panel (item_id, d, buy); training and prediction share them."""
    g = R.with_ewma_gap(R.with_gaps(rows), name="ewma_gap")
    g = g.select("item_id", "d", "buy", R.days_since_exclusive().alias("since"), R.average_gap().alias("avg_gap"), "ewma_gap", R.purchases_so_far().alias("n"), *(R.frequency(w).alias(f"freq_{w}") for w in (7, 30)))
    season = C.school_season_index(F.col("d"))
    return g.select("*", R.log_feature(F.col("since")).alias("since_log"), R.due_ratio(F.col("since"), F.col("avg_gap")).alias("due"), R.supply_level(F.col("since"), F.col("avg_gap")).alias("supply"), F.weekday("d").alias("dow"), season.alias("season"))


def training_panel(days: DataFrame) -> DataFrame:
    return features(panel.negative_samples(days))


def predictions(days: DataFrame, start: str, n: int) -> DataFrame:
    """Scores of every item on n days from start: each day's row is the last of its own history, so days don't feed each other."""
    history = panel.negative_samples(days).select("item_id", "d", "buy")
    bought = R.with_gaps(history)
    state = bought.groupBy("item_id").agg(F.max(F.when(F.col("buy") == 1, F.col("d"))).alias("last_d"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("avg_gap"))
    on = F.explode(F.sequence(F.lit(start).cast("date"), F.date_add(F.lit(start).cast("date"), n - 1))).alias("d")
    rows = state.select("*", on).withColumn("since", F.datediff("d", "last_d"))
    return rows.select("item_id", "d", "since", F.round(R.due_ratio(F.col("since"), F.col("avg_gap")), 6).alias("due"))

"""Events to dense item-by-day panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEGATIVE = "_neg_sample_"


def union_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def item_days(events: DataFrame) -> DataFrame:
    """One row per item and day with the quantity, so that windows over days see no peers."""
    return events.groupBy("item_id", "d").agg(F.sum("qty").cast("long").alias("qty"))


def negative_samples(days: DataFrame) -> DataFrame:
    """A row for every observed day from each item's first purchase on, with its number (day); buy is 1 where it was bought.

    What is broadcast is the calendar of observed days, in one row.
    """
    first = days.groupBy("item_id").agg(F.min("d").alias("first_d"))
    observed = days.select("d").distinct().agg(F.array_sort(F.collect_list("d")).alias("observed"))
    since = F.filter("observed", lambda x: x >= F.col("first_d"))
    grid = first.crossJoin(F.broadcast(observed)).select("item_id", F.explode(since).alias("d"))
    return grid.join(days, ["item_id", "d"], "left").select("item_id", "d", F.unix_date("d").alias("day"), "qty", F.when(F.col("qty").isNull(), 0).otherwise(1).alias("buy"), F.when(F.col("qty").isNull(), NEGATIVE).otherwise("event").alias("source"))


def full_calendar(days: DataFrame, length: int = 365) -> DataFrame:
    """Every item on each of the last `length` days up to the last event's; events before are left out."""
    end = days.agg(F.max("d").alias("end"))
    calendar = end.select(F.explode(F.sequence(F.date_sub("end", length - 1), F.col("end"))).alias("d"))
    grid = days.select("item_id").distinct().crossJoin(F.broadcast(calendar))
    return grid.join(days, ["item_id", "d"], "left").select("item_id", "d", F.unix_date("d").alias("day"), "qty", F.when(F.col("qty").isNull(), 0).otherwise(1).alias("buy"))


def cross_grid(days: DataFrame) -> DataFrame:
    return days.select("item_id").distinct().crossJoin(days.select("d").distinct())


def synthetic_purchases(averages: DataFrame, start: str, stop: str, fuzz: int = 2, seed: int = 7) -> DataFrame:
    """Of (item_id, gap): a purchase every gap days, moved by up to fuzz days at random."""
    dates = F.expr(f"explode(sequence(date'{start}', date'{stop}', make_interval(0, 0, 0, cast(greatest(1, round(gap)) AS int))))")
    rows = averages.where("gap > 0").select("item_id", dates.alias("day"))
    return rows.select("item_id", F.date_add("day", (F.floor(F.rand(seed) * (2 * fuzz + 1)) - fuzz).cast("int")).alias("d"), F.lit(1).alias("buy"), F.lit("_synthetic_").alias("source"))


def synthetic_purchases_of(averages: DataFrame, start: str, n: int, fuzz: int = 3, seed: int = 7) -> DataFrame:
    """Of (item_id, gap): n purchases from start on, every gap days, moved by up to fuzz days at random."""
    number = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("n")
    rows = averages.where("gap > 0").select("item_id", "gap", number) if n > 0 else averages.select("item_id", "gap", F.lit(0).alias("n")).limit(0)
    day = F.date_add(F.lit(start).cast("date"), F.floor(F.col("n") * F.col("gap")).cast("int"))
    return rows.select("item_id", F.date_add(day, (F.floor(F.rand(seed) * (2 * fuzz + 1)) - fuzz).cast("int")).alias("d"), F.lit(1).alias("buy"), F.lit("_synthetic_").alias("source"))

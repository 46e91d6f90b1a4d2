"""Recency, gaps and frequencies. All windows of an item are in the order of `day`, a number, so they share one shuffle and one sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dated(rows: DataFrame) -> DataFrame:
    """Adds day, the number of d, which the windows need."""
    return rows if "day" in rows.columns else rows.withColumn("day", F.unix_date("d"))


def item():
    return Window.partitionBy("item_id").orderBy("day")


def so_far():
    return item().rowsBetween(Window.unboundedPreceding, 0)


def before():
    return item().rowsBetween(Window.unboundedPreceding, -1)


def bought() -> Column:
    return F.col("buy") == 1


def last_purchase(window) -> Column:
    return F.last(F.when(bought(), F.col("d")), ignorenulls=True).over(window)


def with_gaps(panel: DataFrame) -> DataFrame:
    """Adds day, prev (the purchase before this row) and gap (days since it, on purchases)."""
    return dated(panel).withColumn("prev", last_purchase(before())).withColumn("gap", F.when(bought(), F.datediff("d", "prev")))


def days_since_exclusive(never: int = 0) -> Column:
    return F.coalesce(F.datediff("d", last_purchase(before())), F.lit(never))


def days_since_inclusive(never: int = 0) -> Column:
    return F.coalesce(F.datediff("d", last_purchase(so_far())), F.lit(never))


def average_gap() -> Column:
    """Needs gap."""
    return F.coalesce(F.avg("gap").over(so_far()), F.lit(0.0))


def with_ewma_gap(rows: DataFrame, alpha: float = 0.3, name: str = "ewma") -> DataFrame:
    """Adds the exponentially weighted gap, in order: the first gap, then alpha of the new and the rest of the old; 0 before. Needs gap.

    It is worked out on purchases alone, each from so many gaps before it that what is left
    out weighs less than a double can tell, and carried on to the rows until the next one:
    work is in proportion to the rows, however long an item's history is.
    """
    gaps = 1 if alpha == 1 else math.ceil(math.log(1e-18) / math.log(1 - alpha))
    near = F.collect_list(F.col("gap").cast("double")).over(item().rowsBetween(1 - gaps, 0))
    folded = F.aggregate(near, F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x).otherwise(alpha * x + (1 - alpha) * acc))
    at = rows.where("gap IS NOT NULL").select("item_id", F.col("day").alias("_last"), folded.alias(name))
    last = F.last(F.when(bought(), F.col("day")), ignorenulls=True).over(so_far())
    joined = rows.withColumn("_last", last).join(at, ["item_id", "_last"], "left")
    return joined.select(*rows.columns, F.coalesce(name, F.lit(0.0)).alias(name))


def purchases_so_far() -> Column:
    return F.sum("buy").over(so_far()).cast("long")


def frequency(days: int, exclusive: bool = False) -> Column:
    """Purchases from `days` days ago to today; exclusive: strictly between. Needs day."""
    w = item().rangeBetween(-(days - 1), -1) if exclusive else item().rangeBetween(-days, 0)
    return F.coalesce(F.sum("buy").over(w), F.lit(0)).cast("long")


def latest(panel: DataFrame) -> DataFrame:
    """Each item's last row; rows of items and days are single."""
    last = panel.groupBy("item_id").agg(F.max_by(F.struct(*panel.columns), "d").alias("last"))
    return last.select(*(F.col("last")[c].alias(c) for c in panel.columns))


def ratio(a: Column, b: Column) -> Column:
    """0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def due_ratio(days: Column, average: Column, cap: float = 3.0) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(0.0), ratio(days, average)))


def supply_level(days: Column, average: Column) -> Column:
    used = F.when(average > 0, days.cast("double") / average).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - used))


def log_feature(c: Column) -> Column:
    return F.when(c.isNotNull(), F.log1p(F.greatest(c.cast("double"), F.lit(0.0))))

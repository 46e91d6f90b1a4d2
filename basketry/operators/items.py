"""Item dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: list[str], lead: list[Column]) -> DataFrame:
    """Adds n, the rows' number from 0 by the columns of `order`, without bringing them to one task.

    The order must begin with the order of the lead columns: rows are numbered within each
    group of equal leads, and only the groups' sizes are summed up in one.
    """
    names = [f"_lead{i}" for i in range(len(lead))]
    rows = rows.select("*", *(c.alias(x) for c, x in zip(lead, names)))
    before = F.coalesce(F.sum("_size").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_size"))
    begins = sizes.select(*(F.col(x).alias(f"{x}_") for x in names), before.alias("_begin"))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*names).orderBy(*order)) - 1)
    same = [F.col(x).eqNullSafe(F.col(f"{x}_")) for x in names]
    joined = own.join(begins, same)
    return joined.select(*(c for c in rows.columns if c not in names), (F.col("_begin") + F.col("_own")).cast("long").alias("n"))


def item_ids(events: DataFrame) -> DataFrame:
    """(item, item_id): ids from 0 in the order of first appearance, then by name. A dimension: one row per item."""
    first = events.groupBy("item").agg(F.min("d").alias("first_d"))
    return numbered(first, ["first_d", "item"], [F.col("first_d"), F.substring("item", 1, 2)]).select("item", F.col("n").alias("item_id"))


def map_known(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds item_id; items that the dictionary lacks are dropped."""
    return events.join(dictionary, "item")


def unseen(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    return events.join(dictionary, "item", "left_anti").select("item").distinct()


def mapped_with_losses(events: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """map_known, and what it dropped: (item, rows)."""
    lost = events.join(dictionary, "item", "left_anti").groupBy("item").agg(F.count(F.lit(1)).alias("rows"))
    return map_known(events, dictionary), lost


def with_names(rows: DataFrame, dictionary: DataFrame, name: str = "item", unknown: str | None = None) -> DataFrame:
    """Adds the item's name by item_id; `unknown` where the dictionary lacks it. A column of that name is replaced."""
    names = dictionary.select("item_id", F.col("item").alias("_name"))
    joined = rows.drop(name).join(names, "item_id", "left")
    return joined.withColumn(name, F.coalesce("_name", F.lit(unknown).cast("string"))).drop("_name")

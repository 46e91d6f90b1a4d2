"""Counts, dictionaries, first rows and reports in wide form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.items import numbered


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first by `order`. A minimum of structs, so it is combined before the shuffle; order the rows by enough columns to leave no ties."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*keys, *(F.col("_first")[c].alias(c) for c in (*order, *rest))).select(*df.columns)


def append_ids(dictionary: DataFrame, items: DataFrame, allow_new: bool = True) -> DataFrame:
    """The dictionary (item, item_id) with ids for items that it lacks, from its highest id on, by name; without allow_new such an item is an error. A row per item, not per event."""
    fresh = items.select("item").where("item IS NOT NULL").distinct().join(dictionary, "item", "left_anti")
    if not allow_new:
        if (one := fresh.first()) is not None:
            raise ValueError(f"items that the dictionary lacks, such as {one['item']!r}")
        return dictionary.select("item", F.col("item_id").cast("long"))
    top = dictionary.agg(F.coalesce(F.max("item_id"), F.lit(-1)).cast("long").alias("top"))
    added = numbered(fresh, ["item"], [F.substring("item", 1, 3)]).crossJoin(F.broadcast(top))
    return dictionary.select("item", F.col("item_id").cast("long")).unionByName(added.select("item", (F.col("top") + 1 + F.col("n")).alias("item_id")))


def vocabulary_check(dictionary: DataFrame) -> DataFrame:
    """(size, contiguous): whether ids run from 0 without a gap."""
    size = F.count_distinct("item_id")
    return dictionary.agg(size.alias("size"), (F.coalesce(F.max("item_id"), F.lit(-1)) + 1 == size).alias("contiguous"))


def unmapped(events: DataFrame, dictionary: DataFrame, key: str = "item") -> DataFrame:
    """(rows, missing): how many events have no entry."""
    marked = events.join(dictionary.select(key).distinct().withColumn("_known", F.lit(1)), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_known").isNull()).alias("missing"))


def join_filled(left: DataFrame, right: DataFrame, on: str, fill: float = 0.0) -> DataFrame:
    """Left join; the right side's columns are `fill` where nothing matches."""
    own = [c for c in right.columns if c != on]
    return left.join(right, on, "left").select(*left.columns, *(F.coalesce(F.col(c), F.lit(fill).cast(right.schema[c].dataType)).alias(c) for c in own))


def side_by_side(ranked: DataFrame, column: str, values: list, cell: str, rank: str = "rank") -> DataFrame:
    """A row per rank and a column per value. Values are given, so no pass is needed to find them."""
    return ranked.groupBy(rank).pivot(column, values).agg(F.first(cell))


def days_since_wide(bought: DataFrame, items: list[str]) -> DataFrame:
    """Of (d, item): a row per day, with the days since each item was last bought; 0 before the first time."""
    per_day = bought.groupBy("d").pivot("item", items).agg(F.max("d"))
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    since = lambda c: F.coalesce(F.datediff("d", F.last(F.col(f"`{c}`"), ignorenulls=True).over(w)), F.lit(0))
    return per_day.select("d", *(since(c).cast("long").alias(f"since_{c}") for c in items))


def money(c: Column) -> Column:
    """'$1,234.50' to 1234.5; null where that is no number."""
    return F.regexp_replace(c, "[$,]", "").try_cast("double")


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def at_time(date: Column, time: Column, form: str = "M/d/yyyy h:mm a") -> Column:
    """A timestamp of a date's and a time's text; null where they are none."""
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit(form))


#: Columns that a report in wide form has at most.
WIDEST = 5000


def category_flags(rows: DataFrame, key: str, categories: str, known: list[str] | None = None) -> DataFrame:
    """Of (key, categories: array): a row per key with a 0/1 column is_<category> for each known one, in order. Known ones are those given, which grow by what the rows hold: a dimension, found in a pass of its own. More than WIDEST are an error: use sparse_flags for them."""
    each = rows.select(key, F.explode(categories).alias("category")).where("category IS NOT NULL").select(key, F.replace(F.lower("category"), F.lit(" "), F.lit("_")).alias("category"))
    found = each.select("category").distinct().limit(WIDEST + 1).collect()
    names = sorted({*(known or []), *(r[0] for r in found)})
    if len(names) > WIDEST:
        raise ValueError(f"more than {WIDEST} categories would be as many columns; use sparse_flags")
    held = each.groupBy(key).agg(F.collect_set("category").alias("_held"))
    joined = rows.select(key).distinct().join(held, key, "left")
    return joined.select(key, *(F.coalesce(F.array_contains("_held", c), F.lit(False)).cast("int").alias(f"is_{c}") for c in names))


def index_of(rows: DataFrame, categories: str, before: DataFrame | None = None) -> DataFrame:
    """(item, item_id): a place for each category of the arrays, by name from 0. With the index of an earlier version, its places stay and new categories follow, by name; keep each version to read vectors by it."""
    each = rows.select(F.explode(categories).alias("item")).where("item IS NOT NULL").distinct()
    before = rows.sparkSession.createDataFrame([], "item string, item_id long") if before is None else before
    return append_ids(before, each)


def sparse_flags(rows: DataFrame, key: str, categories: str, index: DataFrame) -> DataFrame:
    """Of (key, categories: array): a row per key, with the places in the index that it holds, in order: a one-hot vector over any number of categories. Categories that the index lacks are left out; keys without any have an empty list."""
    each = rows.select(key, F.explode_outer(categories).alias("item")).distinct().join(index, "item", "left")
    return each.groupBy(key).agg(F.array_sort(F.collect_list("item_id")).alias("held"))


def columns_of_type(df: DataFrame, *kinds: str) -> list[str]:
    """Names of the columns whose type is one of the kinds, such as double or string; "number" stands for all numbers."""
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    wanted = tuple(x for k in kinds for x in (numbers if k == "number" else (k,)))
    return [c for c, t in df.dtypes if t.split("(")[0] in wanted]


def distinct_elements(df: DataFrame, column: str) -> DataFrame:
    """(column): the different elements of an array column."""
    return df.select(F.explode(column).alias(column)).distinct()


def first_in_order(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order: a top-n report, not a sample."""
    return df.orderBy(*order).limit(n)


def inspected(df: DataFrame, keys: list[str], flags: list[str], shown: list[str]) -> DataFrame:
    """What one looks at of a wide frame: keys, items (names of the flags that are 1), and values (name to value of the columns to show)."""
    items = F.array_compact(F.array(*(F.when(F.col(c) == 1, F.lit(c)) for c in flags)))
    values = F.map_from_arrays(F.array(*(F.lit(c) for c in shown)), F.array(*(F.col(c).cast("string") for c in shown)))
    return df.select(*keys, items.alias("items"), values.alias("values"))

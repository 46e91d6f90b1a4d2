"""Joins by time: the nearest row before or after, and points within periods.

Neither lists pairs that don't match: an as-of join is a union of both sides, one sort and
a value carried along; an interval join meets points and periods in buckets of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bucket of the interval join that has more than one in so many of all points is split.
FULL = 1000
#: Each level of the interval join has buckets so many times as wide as the one below.
STEP = 16


def _number(df: DataFrame, time: str) -> Column:
    """A time as a number: days of a date, microseconds of a timestamp, numbers as they are."""
    kind = df.schema[time].dataType.simpleString()
    if kind == "date":
        return F.unix_date(time).cast("long")
    return F.unix_micros(F.col(time).cast("timestamp")) if kind.startswith("timestamp") else F.col(time)


def _no_clash(left: DataFrame, names: list[str]) -> None:
    if clash := [c for c in names if c in left.columns]:
        raise ValueError(f"both sides have columns {clash}")


def as_of(left: DataFrame, right: DataFrame, time: str, by: tuple[str, ...] = (), direction: str = "backward", strict: bool = False, tolerance: float | None = None, bucket: float | None = None, right_time: str | None = None) -> DataFrame:
    """Every left row with the columns of the right row of the same keys (`by`) whose time is nearest: at or before it (backward), at or after it (forward), or either (nearest, of equal distances the one before); strict leaves out equal times.

    With tolerance, right rows that are further away don't match; it and bucket are in days
    for dates, microseconds for timestamps, else in the time's own unit. The right time
    comes as <time>_right, or under its own name, which right_time gives. Of right rows of
    one time the largest by their other columns is taken. Null times and keys match nothing.

    One shuffle by the keys and one sort carry the values. Where there are no keys, or one
    may hold much of the rows, give bucket, a width of time: rows are then dealt by keys and
    bucket, and the last value of earlier buckets comes from a table with a row for each.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"direction must be backward, forward or nearest, not {direction!r}")
    if not by and bucket is None:
        raise ValueError("without keys all rows would be sorted in one task: give a bucket")
    other = right_time or time
    shown = right_time or f"{time}_right"
    own = [c for c in right.columns if c not in (*by, other)]
    _no_clash(left, [*own, shown])
    if shown in own:
        raise ValueError(f"the right side has a column {shown} already")
    if direction == "nearest":
        return _nearest(left, right, time, by, strict, tolerance, bucket, other, shown, own)
    # Forward is backward in time that runs the other way.
    sign = 1 if direction == "backward" else -1
    known = right.where(F.col(other).isNotNull())
    for k in by:
        known = known.where(F.col(k).isNotNull())
    value = F.struct((sign * _number(right, other)).alias("at"), F.col(other).alias("time"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(own)))
    r_rows = known.select(*by, value["at"].alias("_t"), F.lit(int(strict)).alias("_side"), value.alias("_r"))
    l_rows = left.select(*by, (sign * _number(left, time)).alias("_t"), F.lit(int(not strict)).alias("_side"), F.lit(None).cast(r_rows.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    rows = l_rows.unionByName(r_rows, allowMissingColumns=True)
    keys = list(by)
    if bucket is not None:
        rows = rows.withColumn("_bucket", F.floor(F.col("_t") / F.lit(bucket)))
        keys.append("_bucket")
    order = Window.partitionBy(*keys).orderBy("_t", "_side", F.col("_r").asc_nulls_first())
    carried = rows.withColumn("_near", F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_l IS NOT NULL")
    if bucket is not None:
        each = rows.groupBy(*keys).agg(F.max("_r").alias("_last"))
        over = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        earlier = each.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.last("_last", ignorenulls=True).over(over).alias("_earlier")).where("_earlier IS NOT NULL")
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        carried = carried.join(earlier, same, "left").withColumn("_near", F.coalesce("_near", "_earlier"))
    fits = F.col("_t").isNotNull() & F.col("_near").isNotNull()
    if tolerance is not None:
        fits = fits & (F.col("_t") - F.col("_near.at") <= F.lit(tolerance))
    out = carried.select("_l", F.when(fits, F.col("_near")).alias("_near"))
    return out.select("_l.*", F.col("_near.time").alias(shown), *(F.col(f"_near.c{i}").alias(c) for i, c in enumerate(own)))


def _nearest(left, right, time, by, strict, tolerance, bucket, other, shown, own) -> DataFrame:
    out = left
    for name, direction in (("_before", "backward"), ("_after", "forward")):
        side = right.select(*by, F.col(other).alias(name), F.struct(F.lit(True).alias("there"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(own))).alias(f"{name}_row"))
        out = as_of(out, side, time, by, direction, strict, tolerance, bucket, right_time=name)
    at, before, after = (_number(out, c) for c in (time, "_before", "_after"))
    first = F.col("_after").isNull() | (F.col("_before").isNotNull() & (at - before <= after - at))
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return out.select(*left.columns, pick("_before", "_after").alias(shown), *(pick(f"_before_row.c{i}", f"_after_row.c{i}").alias(c) for i, c in enumerate(own)))


def within(points: DataFrame, periods: DataFrame, time: str, start: str, end: str, width: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Every point with every period of the same keys that holds it, ends included: the points' columns, then the periods' (but for the keys).

    Points and periods meet in buckets of time, then the bounds are checked. `width` is that
    of the narrowest buckets, in days for dates and microseconds for timestamps; about the
    usual length of a period is good. Longer periods go to wider buckets, so each has 17 at
    most, and each point is listed once for every width in use. A bucket that holds more
    than a thousandth of all points is split into parts that meet all its periods. Null
    times and keys match nothing, nor does a period that ends before it starts.
    """
    own = [c for c in periods.columns if c not in by]
    _no_clash(points, own)
    s, e = _number(periods, start), _number(periods, end)
    span = F.greatest((e - s).cast("double"), F.lit(float(width)))
    level = F.greatest(F.lit(0), F.ceil(F.log(span / F.lit(float(width))) / F.log(F.lit(float(STEP))) - 1e-9)).cast("int")
    wide = lambda l: F.lit(float(width)) * F.pow(F.lit(float(STEP)), l)
    spans = periods.where(s <= e).withColumn("_level", level)
    spans = spans.select("*", F.explode(F.sequence(F.floor(s / wide(F.col("_level"))).cast("long"), F.floor(e / wide(F.col("_level"))).cast("long"))).alias("_bucket"))
    # There are few widths: each is 16 times the one before.
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())
    listed = points.where(F.col(time).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    listed = listed.withColumn("_bucket", F.floor(_number(points, time) / wide(F.col("_level"))).cast("long"))
    keys = [*by, "_level", "_bucket"]
    sizes = listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most = listed.count() // FULL + 1
    # Not more than FULL rows, whatever the input.
    full = F.broadcast(sizes.where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = listed.withColumn("_id", F.monotonically_increasing_id()).join(full, keys, "left").withColumn("_part", F.pmod("_id", parts).cast("int"))
    copies = spans.join(full, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = dealt.drop("_parts", "_id").join(copies.drop("_parts"), [*keys, "_part"])
    inside = _number(points, time).between(_number(periods, start), _number(periods, end))
    return met.where(inside).select(*points.columns, *own)

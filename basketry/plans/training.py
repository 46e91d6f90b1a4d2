"""From purchase events to model inputs and back: names, ids, panel, features, encoding, prediction rows.

A training row and a prediction row come from the same expressions, and a prediction row of
any date is the state of its history before it: the panel is built once for all dates.
Features of an item share one shuffle by item; features of a date are taken on distinct
dates, of which there are few whatever the number of events, and joined by date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import calendar as C
from basketry.functions import names as N
from basketry.operators import items, normalize, panel, recency as R, trips

#: Cyclical columns and their periods.
PERIODS = {"month_cyc_feat": 12, "day_cyc_feat": 31, "dow_cyc_feat": 7}
ZONE = "America/Chicago"


def with_clean_names(events: DataFrame) -> DataFrame:
    """Excluded items go; prefixes go, then names are cleaned and made canonical. Work is done once for each distinct name. Null names are an error."""
    normalize.require_no_nulls(events.select("item"))
    known = events.select("item").distinct()
    named = known.where(~N.contains_any(F.col("item"))).select("item", N.canonicalize(N.clean_item_name(N.strip_prefixes(F.col("item")))).alias("name"))
    return events.join(named, "item").withColumn("item", F.col("name")).drop("name")


def with_ids(events: DataFrame, dictionary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Events with item_id, and the dictionary: the one given, whose unknown items are dropped, or a new one."""
    dictionary = items.item_ids(events) if dictionary is None else dictionary
    return items.map_known(events, dictionary), dictionary


def _derived(since: Column, average: Column) -> list[Column]:
    return [
        since.alias("daysSinceThisItemLastPurchased_raw"),
        R.log_feature(since).alias("daysSinceThisItemLastPurchased_log_feat"),
        R.supply_level(since, average).alias("itemSupplyLevel_feat"),
        R.due_ratio(since, average).alias("item_due_ratio_feat"),
    ]


def item_features(rows: DataFrame) -> DataFrame:
    """Of a panel (item_id, d, qty, buy): each row with what is known of its item by then."""
    known = R.with_ewma_gap(R.with_gaps(rows)).select(
        "item_id", "d", "qty", "buy", R.days_since_exclusive().alias("since"), R.average_gap().alias("average"), "ewma", R.purchases_so_far().alias("itemPurchaseCount_raw")
    )
    return known.select(
        "item_id", "d", "qty", F.col("buy").alias("didBuy_target"), *_derived(F.col("since"), F.col("average")),
        F.col("average").alias("avgDaysBetweenItemPurchases_feat"), F.col("ewma").alias("expectedDaysBetweenPurchases_ewma_feat"), "itemPurchaseCount_raw",
    )


def date_features(d: Column) -> list[Column]:
    start, end = C.days_until_annual(d, C.SCHOOL_START), C.days_until_annual(d, C.SCHOOL_END)
    return [
        start.alias("daysUntilSchoolStart_raw"), R.log_feature(start).alias("daysUntilSchoolStart_log_feat"),
        end.alias("daysUntilSchoolEnd_raw"), R.log_feature(end).alias("daysUntilSchoolEnd_log_feat"),
        C.school_season_index(d).alias("schoolSeasonIndex_feat"), C.is_dst(d, ZONE).alias("isDayLightSavingsTime_feat"),
        F.year(d).alias("year_feat"), F.month(d).alias("month_cyc_feat"), F.dayofmonth(d).alias("day_cyc_feat"), F.weekday(d).alias("dow_cyc_feat"),
        F.dayofyear(d).alias("doy_feat"), F.quarter(d).alias("quarter_feat"),
    ]


def _with_dates(dates: DataFrame, weather: DataFrame | None) -> DataFrame:
    out = dates.select("*", *date_features(F.col("d")))
    return out if weather is None else out.join(weather, "d", "left")


def training_frame(days: DataFrame, weather: DataFrame | None = None, calendar_days: int | None = None, drop_first: bool = False) -> DataFrame:
    """A row per item and day from its first purchase on (or, with calendar_days, per item and each of the last days), with all features. drop_first leaves out rows of items with exactly one purchase so far. Weather is (d, columns); days without have nulls."""
    rows = panel.negative_samples(days) if calendar_days is None else panel.full_calendar(days, calendar_days)
    rows = item_features(rows.select("item_id", "d", "day", "qty", "buy"))
    rows = rows.where("itemPurchaseCount_raw != 1") if drop_first else rows
    visits = trips.trip_gaps(days.select("d")).select("d", F.col("gap").alias("daysSinceLastTrip_raw"), F.col("avg_gap").alias("avgDaysBetweenTrips_feat"))
    dates = _with_dates(rows.select("d").distinct().join(visits, "d", "left"), weather)
    return rows.join(dates, "d")


def prediction_frame(days: DataFrame, dates: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """A row per known item and date asked for (later than the history), with the training frame's features but no label."""
    state = item_features(panel.negative_samples(days).select("item_id", "d", "day", "qty", "buy"))
    keep = ["avgDaysBetweenItemPurchases_feat", "expectedDaysBetweenPurchases_ewma_feat", "itemPurchaseCount_raw"]
    state = state.groupBy("item_id").agg(F.max(F.when(F.col("didBuy_target") == 1, F.col("d"))).alias("last_d"), F.max_by(F.struct(*keep), "d").alias("s")).select("item_id", "last_d", "s.*")
    last = trips.trip_gaps(days.select("d")).agg(F.max("d").alias("last_trip"), F.max_by("avg_gap", "d").alias("avgDaysBetweenTrips_feat"))
    asked = _with_dates(dates.select("d").distinct(), weather).crossJoin(F.broadcast(last))
    asked = asked.withColumn("daysSinceLastTrip_raw", F.datediff("d", "last_trip")).drop("last_trip")
    rows = state.crossJoin(asked)
    return rows.select(*(c for c in rows.columns if c != "last_d"), *_derived(F.datediff("d", "last_d"), F.col("avgDaysBetweenItemPurchases_feat")))


def fit_encoding(frame: DataFrame) -> dict:
    """Means and deviations of the numeric features that aren't 0/1 alone, and periods of cyclical ones. Keep it with the model, with the names of the inputs."""
    features = [c for c in frame.columns if c.endswith("_feat")]
    cyclical = {c: PERIODS[c] for c in features if c.endswith("_cyc_feat")}
    plain = [c for c in features if c not in cyclical]
    binary = {r["column"] for r in normalize.binary_columns(frame, plain).collect() if r["is_binary"]} if plain else set()
    stats = normalize.fit(frame, [c for c in plain if c not in binary]) if len(binary) < len(plain) else {}
    inputs = [f"{c}_norm" for c in stats] + [f"{c}_{k}_norm" for c in cyclical for k in ("sin", "cos")] + sorted(binary)
    return {"stats": stats, "periods": cyclical, "inputs": inputs}


def encode(frame: DataFrame, encoding: dict) -> DataFrame:
    """The frame with its features replaced by what a model takes; raw columns go. Nulls become 0 after scaling, the mean."""
    waves = [x.alias(f"{c}_{k}_norm") for c, period in encoding["periods"].items() for k, x in zip(("sin", "cos"), normalize.sin_cos(F.col(c), period))]
    out = normalize.apply(frame.select("*", *waves).drop(*encoding["periods"], *(c for c in frame.columns if c.endswith("_raw"))), encoding["stats"])
    return out.na.fill(0.0, [f"{c}_norm" for c in encoding["stats"]])


def feature_names(frame: DataFrame) -> list[str]:
    """The names of scaled features, without those of raw columns."""
    return [c for c in frame.columns if c.endswith("_norm") and not c.endswith("_raw_norm")]


def target_name(frame: DataFrame) -> str:
    """The one column that is to be learned; none or several are an error."""
    found = [c for c in frame.columns if c.endswith("_target")]
    if len(found) != 1:
        raise ValueError(f"one column must end in _target, not {found}")
    return found[0]


def require_no_raw(columns: list[str]) -> list[str]:
    if bad := [c for c in columns if c.endswith("_raw") or c.endswith("_raw_norm")]:
        raise ValueError(f"raw columns among the features: {bad}")
    return columns

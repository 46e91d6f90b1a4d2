"""The whole way from named events to encoded rows, on rows made here."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.operators import panel
from basketry.plans import training as T

DAY = dt.date(2024, 3, 1)


@pytest.fixture(scope="module")
def events(spark):
    rows = [("SEG-Whole Pizza", 0, 1), ("whole pizza 2 ct", 4, 2), ("Sour Cream", 2, 1), ("Sour Cream", 10, 1), ("Birthday hat", 1, 1)]
    return spark.createDataFrame([(n, DAY + dt.timedelta(d), q) for n, d, q in rows], "item string, d date, qty int")


def test_names_and_ids(spark, events):
    named = T.with_clean_names(events)
    assert sorted(r["item"] for r in named.collect()) == ["pizza", "pizza", "sour-cream", "sour-cream"]
    mapped, dictionary = T.with_ids(named)
    assert {tuple(r) for r in dictionary.collect()} == {("pizza", 0), ("sour-cream", 1)}
    again, _ = T.with_ids(named, dictionary.where("item_id = 1"))
    assert {r.item_id for r in again.collect()} == {1} and mapped.count() == 4
    with pytest.raises(ValueError):
        T.with_clean_names(events.withColumn("item", F.lit(None).cast("string")))


def test_frames_and_encoding(spark, events):
    days = panel.item_days(T.with_ids(T.with_clean_names(events))[0])
    frame = T.training_frame(days)
    rows = {(r.item_id, (r.d - DAY).days): r for r in frame.collect()}
    assert sorted(rows) == [(0, 0), (0, 2), (0, 4), (0, 10), (1, 2), (1, 4), (1, 10)]
    assert [rows[0, x].daysSinceThisItemLastPurchased_raw for x in (0, 2, 4, 10)] == [0, 2, 4, 6]
    assert [rows[0, x].avgDaysBetweenTrips_feat for x in (0, 2, 4)] == [0, 2, 2] and [rows[0, x].isDayLightSavingsTime_feat for x in (4, 10)] == [0, 1]
    assert T.training_frame(days, drop_first=True).count() == 3 and T.training_frame(days, calendar_days=5).count() == 10
    encoding = T.fit_encoding(frame)
    encoded = T.encode(frame, encoding)
    assert set(encoding["inputs"]) <= set(encoded.columns) and not [c for c in encoded.columns if c.endswith("_raw")]
    assert encoded.agg(F.sum("doy_feat_norm")).first()[0] == pytest.approx(0)
    ahead = T.prediction_frame(days, spark.createDataFrame([(DAY + dt.timedelta(12),)], "d date"))
    got = {r.item_id: r for r in ahead.collect()}
    assert [got[i].daysSinceThisItemLastPurchased_raw for i in (0, 1)] == [8, 2] and got[0].daysSinceLastTrip_raw == 2
    assert set(encoding["inputs"]) <= set(T.encode(ahead, encoding).columns)


def test_nothing(spark, events):
    days = panel.item_days(T.with_ids(T.with_clean_names(events.limit(0)))[0])
    frame = T.training_frame(days)
    assert frame.count() == 0
    assert T.encode(frame, T.fit_encoding(frame)).count() == 0

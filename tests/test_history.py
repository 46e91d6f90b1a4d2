"""Receipts and purchases as streams: any order of arrival gives the batch's result, nothing is lost, and a run goes on after a stop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from basketry.sources import receipts
from basketry.streaming import history, ingest

EVENTS = "item_id long, d date, qty int"
COLUMNS = ["item_id", "first_d", "last_d", "purchases", "qty", "avg_gap", "ewma"]


def rounded(df):
    return {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(COLUMNS).collect()}


def events(rng):
    days = [dt.date(2030, 1, 1) + dt.timedelta(d) for d in range(200)]
    rows = [(i, rng.choice(days), rng.randint(1, 3)) for i in range(6) for _ in range(i * 8)]
    return [*rows, (1, None, 2), (None, days[0], 1), (2, days[5], None), (7, days[3], 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = events(rng)
    rng.shuffle(rows)
    own = history.state_session(spark)
    place = str(tmp_path / "in")
    for part in (rows[:40], rows[40:90], rows[90:]):
        # A run, a stop, and a new start from the same checkpoint each time.
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(place)
        stream = own.readStream.schema(EVENTS).parquet(place)
        history.write_updates(history.histories(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = history.latest_histories(spark.read.parquet(str(tmp_path / "out")))
    assert rounded(got) == rounded(history.batch_histories(spark.createDataFrame(rows, EVENTS)))


def test_late_day_amends_the_gaps():
    assert history.folded([1, 4, 5], 0.3) == (1, 5, 3, 0.3 * 1 + 0.7 * 3)
    assert history.folded([1], 0.3) == (1, 1, 1, None)


def test_reminders(spark, tmp_path):
    own = history.state_session(spark)
    place, day = str(tmp_path / "in"), dt.date(2020, 1, 1)
    spark.createDataFrame([(1, day, 1), (1, day + dt.timedelta(4), 1), (2, day, 1)], EVENTS).coalesce(1).write.parquet(place)
    run = lambda: history.write_updates(history.histories(own.readStream.schema(EVENTS).parquet(place), reminders=True), str(tmp_path / "out"), str(tmp_path / "state"), timed=True, most_seconds=60)
    run()
    spark.createDataFrame([(3, day, 1)], EVENTS).coalesce(1).write.mode("append").parquet(place)
    run()
    due = spark.read.parquet(str(tmp_path / "out")).where("due").collect()
    assert {(r.item_id, r.last_d, r.avg_gap) for r in due} == {(1, day + dt.timedelta(4), 4.0)}


def receipt(date, item):
    return f"{date} at 9:09 PM\nReg You Pay\n{item} $7.99 $6.99 B\nTotal number of items sold = 1"


@pytest.mark.parametrize("keep", [None, "30 days"])
def test_old_receipts_and_copies(spark, tmp_path, keep):
    """A receipt of January that comes after one of June is there; a copy isn't, whenever it comes."""
    own = history.state_session(spark)
    (tmp_path / "in").mkdir()
    batches = [{"june.txt": receipt("6/4/2030", "Oil")}, {"jan.txt": receipt("1/4/2030", "Oil")}, {"copy.txt": receipt("6/4/30", "Oil"), "a.txt": receipt("6/4/2030", "Salt"), "b.txt": receipt("6/4/2030", "Salt"), "none.txt": "x"}]
    for files in batches:
        for name, text in files.items():
            (tmp_path / "in" / name).write_text(text)
        raw = own.readStream.schema("value string").text(str(tmp_path / "in"), wholetext=True)
        parsed = receipts.parse(raw.select(F.col("_metadata.file_name").alias("source"), "value"))
        alone = receipts.events(ingest.without_copies(parsed, keep))
        history.write_updates(alone, str(tmp_path / "out"), str(tmp_path / "state"), mode="append", timed=bool(keep), most_seconds=60)
    got = {(r.source, str(r.d), r["item"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    one = ({"a.txt"} if keep else {"a.txt", "b.txt"}) & {s for s, _, _ in got}
    assert len(one) == 1 and got == {("june.txt", "2030-06-04", "oil"), ("jan.txt", "2030-01-04", "oil"), (*one, "2030-06-04", "salt")}
    batch = ingest.without_copies(receipts.parse(receipts.read_receipts(spark, str(tmp_path / "in"))))
    assert batch.count() == 3


def test_counts_lose_nothing(spark, tmp_path):
    place = str(tmp_path / "in")
    schema = "item string, d date, qty int"
    for d in (dt.date(2030, 6, 1), dt.date(2030, 1, 1)):
        spark.createDataFrame([("a", d, 2)], schema).coalesce(1).write.mode("append").parquet(place)
        history.write_updates(ingest.daily_counts(spark.readStream.schema(schema).parquet(place)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {(str(r.window.start)[:10], r.qty) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("2030-06-01", 2), ("2030-01-01", 2)}

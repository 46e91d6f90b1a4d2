"""Files in, files out, streams and experiments, on rows made here."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from basketry.operators import experiments, learn, lookups
from basketry.sources import nested, receipts, tables
from basketry.streaming import ingest

RECEIPT = "9/4/2030 at 9:09 PM\nReg You Pay\nOil $7.99 $6.99 B\nQTY 2 Soup $4.98 $4.98 B\nTotal number of items sold = 3"


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_forecast_and_observations(spark, tmp_path):
    period = lambda t, v, h: {"name": "n", "startTime": t, "temperature": v, "relativeHumidity": {"value": h}, "shortForecast": "s"}
    f = put(tmp_path / "f.json", {"properties": {"periods": [period("2030-01-01T06:00:00-06:00", 50, 10), period("2030-01-01T18:00:00-06:00", 40, None), period("2030-01-02T06:00:00-06:00", 60, 5)]}})
    got = nested.forecast_by_day(nested.read_forecast(spark, f)).orderBy("d").collect()
    assert [tuple(r) for r in got] == [(dt.date(2030, 1, 1), 50.0, 10.0), (dt.date(2030, 1, 2), 60.0, 5.0)]
    o = put(tmp_path / "o.json", {"properties": {"temperature": {"value": 20.5}, "precipitationLastHour": {"value": None}}})
    assert tuple(nested.read_observations(spark, o).first()) == (None, 20.5, 0.0, 0.0)


def test_foods(spark, tmp_path):
    put(tmp_path / "a.json", {"foods": [{"description": "x", "foodCategory": "Dairy and Egg"}, {"description": "y"}]})
    put(tmp_path / "b.json", {"foods": []})
    assert {tuple(r) for r in nested.read_food_categories(spark, str(tmp_path)).collect()} == {("a.json", "dairy_and_egg"), ("b.json", None)}


def test_store_receipts(spark, tmp_path):
    r = {"transactionID": "7", "transactionDateTime": "/Date(86400000)/", "totals": {"gross": 3.5, "grand": "bad"}, "itemsUngrouped": [{"saleItem": {"itemID": "1"}}, {"saleItem": None}]}
    p = put(tmp_path / "r.json", {"Receipts": {"receipts": [r, {"transactionID": "8"}]}})
    one, two = nested.read_store_receipts(spark, p).orderBy("source").select("source", F.unix_seconds("at"), "gross", "grand", "items").collect()
    assert tuple(one) == ("7", 86400, 3.5, None, ["1"]) and tuple(two) == ("8", None, None, None, [])


def test_order_report(spark, tmp_path):
    put(tmp_path / "a.csv", 'Summary,1\n\nmore\nOrder Type,Order ID,Order Date,No. of Shipment,No. of Items,More\nDelivery,"1,2",Jan 1,1,5,z\n\n')
    put(tmp_path / "b.csv", "Summary,1\n")
    got = nested.read_order_report(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("a.csv", "Delivery", "1,2", "Jan 1", "1", "5")]


def test_orders_weather_and_check_list(spark, tmp_path):
    o = put(tmp_path / "o.CSV", "Order Date,Product Description,Product Quantity\n2030-01-02,Great Value Milk,2\n2030-01-02,,x\n")
    assert [tuple(r) for r in tables.read_orders(spark, o).collect()] == [("o.CSV", dt.date(2030, 1, 2), "Milk", 2), ("o.CSV", dt.date(2030, 1, 2), None, None)]
    c = put(tmp_path / "c.csv", 'DateTime , Location,Cost, ItemCount\n2030-01-02 10:00:00,a,"$1,012.34",4 Items\n')
    r = tables.read_check_list(spark, c).first()
    assert (r.location, r.cost, r.itemcount) == ("a", 1012.34, 4)


def test_receipt_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.txt", RECEIPT)
    put(tmp_path / "in" / "b.txt", RECEIPT.replace("Oil", "Salt"))
    batch = receipts.events(receipts.parse(receipts.read_receipts(spark, str(tmp_path / "in"))))
    expected = {("a.txt", "oil", 1), ("a.txt", "soup", 2), ("b.txt", "salt", 1), ("b.txt", "soup", 2)}
    assert {(r.source, r["item"], r.qty) for r in batch.collect()} == expected
    counts = ingest.daily_counts(ingest.receipt_stream(spark, str(tmp_path / "in")))
    run = counts.writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert {(r["item"], r.qty) for r in spark.table("daily").collect()} == {("oil", 1), ("salt", 1), ("soup", 4)}


def test_written_tables_are_read_again(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "item string, item_id long")
    tables.write_tables({"one": df, "two": df.limit(0)}, str(tmp_path / "book"))
    assert spark.read.option("header", True).csv(str(tmp_path / "book/one")).first()["item"] == "a"
    tables.write_json(df, str(tmp_path / "dict"))
    assert tuple(tables.read_dictionary(spark, str(tmp_path / "dict")).first()) == ("a", 1)


def test_grids_and_names():
    assert experiments.grid(a=[1, 2], b=["x"]) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    assert experiments.funnel(8, 5) == [8, 4, 2, 1, 1] and experiments.uniform(4, 2) == [4, 4]
    assert experiments.experiment_name(100, [64, 64], 280, "relu", 0.0001, "7") == "e100_l64-64_ep280_rel_lr0.0001_7"[:31]


def test_search_and_saving(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(400).select(array_to_vector(F.array((F.col("id") % 10).cast("double"))).alias("features"), (F.col("id") % 10 > 4).cast("double").alias("label"))
    model, trials = experiments.search(rows, LogisticRegression(maxIter=5), experiments.grid(regParam=[0.0, 0.5]))
    assert {r.trial for r in trials.collect()} == {0, 1} and all(r.auc > 0.9 for r in trials.collect())
    experiments.save_experiment(str(tmp_path / "e"), model, trials)
    assert LogisticRegressionModel.load(str(tmp_path / "e/model")).numFeatures == 1


def test_next_trip(spark):
    df = spark.createDataFrame([(1, dt.date(2030, 1, 1), 0.9), (1, dt.date(2030, 1, 2), 0.2), (2, dt.date(2030, 1, 1), 0.5)], "item_id long, d date, score double")
    assert {tuple(r) for r in learn.next_trip(df).collect()} == {(1, 0.2, False, 2), (2, 0.5, True, 1)}


def test_lookups_of_nothing(spark):
    none = spark.createDataFrame([], "item string, item_id long")
    one = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "item string")
    assert sorted(map(tuple, lookups.append_ids(none, one).collect())) == [("a", 0), ("b", 1)]
    assert tuple(lookups.vocabulary_check(none).first()) == (0, True)
    assert tuple(lookups.unmapped(one, none).first()) == (4, 4)


@pytest.mark.parametrize("text, value", [("$1,234.50", 1234.5), ("", None), ("x", None), (None, None)])
def test_money(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(lookups.money(F.col("t"))).first()[0] == value

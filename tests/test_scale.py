"""Forms of names and receipts, plans that must hold at any size, numbering without one task, scoring from history to ranks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from basketry.functions import names as N
from basketry.operators import experiments, habits, items, learn, lookups, normalize, panel, recency as R
from basketry.plans import scoring, training
from basketry.sources import receipts, tables
from basketry.streaming import ingest

DAY = dt.date(2024, 3, 1)


def one(spark, f, *xs):
    return [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x string").select(f(F.col("x"))).collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unicode_forms(spark):
    assert one(spark, N.clean_item_name, "Sőr ǎpple ﬁg", "Ⅷ ½ ø x", "Ｍilk ㎏") == ["sor-apple-fig", "viii-x", "milk-kg"]
    assert one(spark, lambda c: N.lacks_all(c, ("Pen+Gear",), ("^toy",)), "a pen+gear b", "Toys", "a toy", None) == [False, False, True, True]


def test_receipt_grammar(spark):
    text = "1/2/30,AT 9:09pm\nstore  manager : A\nReg YouPay\nTAX 1.00 2.00\nMilk 2% $1.00 $0.90\nqty3 Soup  $2.00 $2.00 f\nYou saved $1.00 $1.00\nTotal items sold 2"
    r = receipts.parse(spark.createDataFrame([("a", text)], "source string, value string")).first()
    assert (r.date, r.time, r.manager, r.reported) == ("1/2/30", "9:09pm", "A", 2)
    assert [(i.item, i.qty) for i in r["items"]] == [("milk-2", 1), ("soup", 3), ("you-saved", 1)]
    strict = receipts.parse(spark.createDataFrame([("a", text), ("b", text.replace("YouPay", "You Pay"))], "source string, value string"), strict=True).collect()
    assert [[i.item for i in x["items"]] for x in strict] == [[], ["Milk 2%", "Soup", "You saved"]]


def test_weighted_gaps_of_a_long_history(spark):
    rng, rows, day = random.Random(1), [], 0
    for k in range(700):
        day += rng.randint(1, 3)
        rows.append((1, DAY + dt.timedelta(day), int(k % 2 == 0 or rng.random() < 0.5)))
    got = {r.d: r.ewma for r in R.with_ewma_gap(R.with_gaps(spark.createDataFrame(rows, "item_id long, d date, buy int"))).collect()}
    last, now = None, None
    for _, d, buy in rows:
        if buy:
            if last:
                gap = (d - last).days
                now = gap if now is None else 0.3 * gap + 0.7 * now
            last = d
        assert got[d] == pytest.approx(now or 0.0, rel=1e-14)


def test_plans(spark):
    e = spark.createDataFrame([(k % 5, DAY + dt.timedelta(k % 11), 1) for k in range(60)], "item_id long, d date, qty int")
    rows = panel.negative_samples(panel.item_days(e))
    assert "CartesianProduct" not in plan(rows) and ">=" not in "".join(x for x in plan(rows).split("\n") if "NestedLoopJoin" in x)
    f = R.with_gaps(rows).select("item_id", R.days_since_exclusive(), R.days_since_inclusive(), R.average_gap(), R.purchases_so_far(), R.frequency(7), R.frequency(30))
    windows = plan(f)
    # Two sorts are the join's that fills the panel; all windows share the third.
    assert windows.count("Sort [") <= 3


def test_numbers_without_one_task(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("abé ") for _ in range(rng.randint(0, 4))), DAY + dt.timedelta(rng.randint(0, 3))) for _ in range(400)]
    first = {}
    for item, d in rows:
        first[item] = min(d, first.get(item, d))
    want = {item: n for n, (_, item) in enumerate(sorted((d, item.encode()) for item, d in first.items()))}
    got = items.item_ids(spark.createDataFrame(rows, "item string, d date"))
    assert {r["item"].encode(): r.item_id for r in got.collect()} == want
    more = spark.createDataFrame([("zz",), ("abba",), (rows[0][0],), (None,)], "item string")
    grown = {r["item"]: r.item_id for r in lookups.append_ids(got, more).collect()}
    assert grown["abba"] == grown.get("abba") and grown["zz"] == max(grown.values()) and len(set(grown.values())) == len(grown)
    with pytest.raises(ValueError):
        lookups.append_ids(got, spark.createDataFrame([("never seen",)], "item string"), allow_new=False)
    named = items.with_names(spark.createDataFrame([(0,), (10_000,)], "item_id long"), got, unknown="?").collect()
    assert {r["item"] for r in named if r.item_id == 10_000} == {"?"}


def test_habits_and_totals(spark):
    e = spark.createDataFrame([(1, DAY), (1, DAY + dt.timedelta(10)), (2, DAY + dt.timedelta(5))], "item_id long, d date")
    got = {r.item_id: tuple(r)[1:] for r in habits.habit_features(e, spark.createDataFrame([(1,), (2,), (3,)], "item_id long")).collect()}
    assert got[3] == (0, 0, 0) and got[1] == pytest.approx((2 / 3, 1.0, 1.0)) and got[2][:2] == pytest.approx((1 / 3, 0))
    with pytest.raises(Exception, match="no purchase"):
        habits.total_purchases(spark.createDataFrame([(1, 0)], "item_id long, buy int")).collect()


def test_small_things(spark, tmp_path):
    assert normalize.apply_to_value(3.0, "v", {"v": (1.0, 2.0)}) == 1.0 and normalize.apply_to_value(None, "v", {"v": (1.0, None)}) == 0.0
    foods = spark.createDataFrame([(1, ["Dairy Food", None]), (2, ["Snacks"]), (3, None)], "id int, categories array<string>")
    assert [tuple(r) for r in lookups.category_flags(foods, "id", "categories", ["fish"]).orderBy("id").collect()] == [(1, 1, 0, 0), (2, 0, 0, 1), (3, 0, 0, 0)]
    assert lookups.columns_of_type(foods, "number") == ["id"] and lookups.distinct_elements(foods.limit(2), "categories").count() == 3
    assert panel.synthetic_purchases_of(spark.createDataFrame([(1, 2.5)], "item_id long, gap double"), "2024-01-01", 4).count() == 4
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text('{"item": "x", "item_id": 1}\n{"item": null, "item_id": 2}\n')
    with pytest.raises(Exception, match="lacks"):
        tables.read_dictionary(spark, str(tmp_path / "d")).collect()
    assert tables.read_dictionary(spark, str(tmp_path / "d"), strict=False).count() == 1
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a.csv").write_text('Order Date,Product Description,Product Quantity\n2024-01-02,"Great Value Milk, Fat Free",2\n')
    (tmp_path / "o" / "b.CSV").write_text("Product Quantity,Other,Order Date,Product Description\r\n1,x,2024-01-03,Eggs\r\n")
    assert sorted((r.source, str(r.date), r["item"], r.qty) for r in tables.read_orders(spark, str(tmp_path / "o")).collect()) == [("a.csv", "2024-01-02", "Milk, Fat Free", 2), ("b.CSV", "2024-01-03", "Eggs", 1)]
    with pytest.raises(ValueError):
        training.target_name(foods)
    with pytest.raises(ValueError):
        training.require_no_raw(["a_raw"])
    assert experiments.experiment_name(100, [64], 2, "relu", 0.1, "7").startswith("e100")


def test_splits(spark):
    df = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(2000)], "id long, y int")
    a, b = learn.split_stratified(df, "y")
    assert a.count() + b.count() == 2000 and a.intersect(b).count() == 0
    shares = {r.y: r.n for r in a.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(shares[0] / 1800 - 0.8) < 0.05 and abs(shares[1] / 200 - 0.8) < 0.2
    with pytest.raises(ValueError):
        learn.perceptron_scores(df, [], "y", solver="adam")


def test_scoring_with_a_kept_model(spark, tmp_path):
    e = spark.createDataFrame([(k, DAY + dt.timedelta(d)) for k in range(6) for d in range(k, 60, k + 2)], "item_id long, d date").withColumn("qty", F.lit(1))
    days = panel.item_days(e)
    model, encoding = scoring.fit(training.training_frame(days), trees=3)
    scoring.save(spark, str(tmp_path / "m"), model, encoding)
    again = scoring.load(spark, str(tmp_path / "m"))
    asked = spark.createDataFrame([(DAY + dt.timedelta(61),), (DAY + dt.timedelta(70),)], "d date")
    first, second = (scoring.ranked(scoring.scores(*m, days, asked)).orderBy("d", "rank").collect() for m in ((model, encoding), again))
    assert first == second and len(first) == 12 and [r["rank"] for r in first] == [1, 2, 3, 4, 5, 6] * 2
    assert all(0 <= r.score <= 1 for r in first) and len({r.score for r in first}) > 1


def test_a_stream_without_copied_receipts(spark, tmp_path):
    text = "1/2/2030 at 9:09 PM\nReg You Pay\nMilk $1.00 $1.00\nMilk $1.00 $1.00\nTotal items sold 2"
    for name, t in (("a", text), ("b", text), ("c", text.replace("9:09", "9:10")), ("d", text.replace("Milk $1.00 $1.00\nMilk", "Milk $1.00 $1.00\nEggs")), ("e", "no date")):
        (tmp_path / f"{name}.txt").write_text(t)
    raw = spark.readStream.schema("value string").text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_name").alias("source"), "value")
    alone = ingest.without_copies(receipts.parse(raw))
    run = alone.writeStream.format("memory").queryName("alone").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    run.awaitTermination(120)
    got = receipts.events(spark.table("alone")).collect()
    assert sorted((str(r.d), r.t, r["item"]) for r in got) == sorted([("2030-01-02", "9:09 PM", "milk")] * 3 + [("2030-01-02", "9:10 PM", "milk")] * 2 + [("2030-01-02", "9:09 PM", "eggs")])
    assert ingest.without_copies(receipts.parse(spark.read.text(str(tmp_path / "*.txt"), wholetext=True).select(F.lit("x").alias("source"), "value"))).count() == 3


def test_sparse_flags_of_a_growing_vocabulary(spark):
    first = spark.createDataFrame([(1, ["b", "a", None, "a"]), (2, []), (3, None), (1, ["c"])], "k int, c array<string>")
    index = lookups.index_of(first, "c")
    assert {tuple(r) for r in index.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.k, tuple(r.held)) for r in lookups.sparse_flags(first, "k", "c", index).collect()} == {(1, (0, 1, 2)), (2, ()), (3, ())}
    second = spark.createDataFrame([(9, ["aa", "c"])], "k int, c array<string>")
    grown = lookups.index_of(second, "c", index)
    assert {tuple(r) for r in grown.collect()} == {("a", 0), ("b", 1), ("c", 2), ("aa", 3)}
    assert lookups.sparse_flags(second, "k", "c", grown).first().held == [2, 3]


def test_a_million_names_stay_off_the_driver(spark, monkeypatch):
    rows = spark.range(1_000_000).select((F.col("id") % 1000).alias("k"), F.array(F.col("id").cast("string")).alias("c"))
    with monkeypatch.context() as m:
        m.setattr(type(rows), "collect", lambda *_: pytest.fail("brought to the driver"))
        flags = lookups.sparse_flags(rows, "k", "c", lookups.index_of(rows, "c"))
    assert len(flags.schema) == 2 and flags.agg(F.sum(F.size("held"))).first()[0] == 1_000_000

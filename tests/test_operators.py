import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.functions import calendar as C
from basketry.functions import names as N
from basketry.operators import items, normalize, panel, recency as R, trips
from basketry.sources import receipts

DAY = dt.date(2024, 1, 1)


def days(*offsets):
    return [DAY + dt.timedelta(x) for x in offsets]


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(1, d, int(i in (0, 4, 10))) for i, d in enumerate(days(*range(11)))]
    return R.with_gaps(spark.createDataFrame(rows, "item_id long, d date, buy int"))


def test_gaps_by_hand(gaps):
    got = R.with_ewma_gap(gaps, name="w").select("d", "w", R.days_since_exclusive().alias("e"), R.days_since_inclusive().alias("i"), R.average_gap().alias("a"), R.purchases_so_far().alias("n")).orderBy("d").collect()
    assert [r.e for r in got] == [0, 1, 2, 3, 4, 1, 2, 3, 4, 5, 6]
    assert [r.i for r in got] == [0, 1, 2, 3, 0, 1, 2, 3, 4, 5, 0]
    assert [r.a for r in got] == [0] * 4 + [4] * 6 + [5]
    assert [round(r.w, 6) for r in got] == [0] * 4 + [4] * 6 + [4.6]
    assert got[-1].n == 3


def test_frequency_against_a_loop(gaps):
    got = gaps.select("d", "buy", R.frequency(7).alias("f"), R.frequency(7, exclusive=True).alias("x")).orderBy("d").collect()
    for r in got:
        ago = lambda x: (r.d - x.d).days  # noqa: E731, B023
        assert r.f == sum(x.buy for x in got if 0 <= ago(x) <= 7)
        assert r.x == sum(x.buy for x in got if 0 < ago(x) < 7)


def test_ratios(spark):
    df = spark.createDataFrame([(3, 0.0), (1, 4.0), (9, 4.0)], "days int, average double")
    got = df.select(R.supply_level(F.col("days"), F.col("average")).alias("s"), R.due_ratio(F.col("days"), F.col("average")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0), (0.75, 0.25), (0.0, 2.25)]


def test_seasons(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 1),), (dt.date(2024, 6, 10),), (dt.date(2024, 9, 1),)], "d date")
    got = df.select(C.school_season_index(F.col("d")).alias("a"), C.school_season_index_early(F.col("d")).alias("b")).collect()
    assert [r.a * 365 for r in got] == pytest.approx([-167, 10, 93])
    assert [r.b * 365 for r in got] == pytest.approx([-167, -66, 93])


def test_thanksgiving(spark):
    own = [h for n, h in C.federal_holidays(2023, 2025) if n == "Thanksgiving"]
    assert dt.date(2024, 11, 28) in own
    df = spark.createDataFrame([(dt.date(2024, 11, x),) for x in (28, 25)] + [(dt.date(2024, 12, 1),)], "d date")
    assert [r[0] for r in df.select(C.proximity(F.col("d"), C.dates(own), 15, strict=True)).collect()] == pytest.approx([1.0, 0.8, -0.8])


def test_names(spark):
    one = lambda f, *xs: [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x string").select(f(F.col("x"))).collect()]
    assert one(N.clean_item_name, "Café & Bar 2.5 LB 12ct", None, "") == ["cafe-and-bar", "", ""]
    assert one(N.strip_prefixes, "SEG-Milk", "kandl--milk", "great-value-great-value-x") == ["Milk", "milk", "great-value-x"]
    assert one(N.canonicalize, "pork-ribs", "chocolate-bar", "ice-cream", None) == ["ground-beef", "coke", "icecream", None]


def test_panel_and_empty_input(spark):
    e = spark.createDataFrame([(1, days(0)[0], 2), (1, days(0)[0], 1), (2, days(2)[0], 1)], "item_id long, d date, qty int")
    rows = panel.negative_samples(panel.item_days(e)).collect()
    assert sorted((r.item_id, r.d, r.buy) for r in rows) == [(1, days(0)[0], 1), (1, days(2)[0], 0), (2, days(2)[0], 1)]
    assert panel.full_calendar(panel.item_days(e), 3).count() == 6
    assert panel.negative_samples(panel.item_days(e.limit(0))).count() == 0


def test_receipt(spark):
    text = "  09/04/2030 at 9:09 PM\nStore Manager: AA\nYour Cashier: BB\n   Reg      You Pay\n  Oil Spread   $7.99   $6.99  B\nQTY 2  Soup Mix   $4.98   $4.98  B\n You save ($1.00)\n qty-3-Eggs  $3.00   $3.00\nTotal number of items sold = 6\n Junk  $1.00  $1.00"
    got = receipts.parse(spark.createDataFrame([("a", text), ("b", "no header"), ("c", None)], "source string, value string")).collect()
    r = {x.source: x for x in got}
    assert [(i.item, i.qty) for i in r["a"]["items"]] == [("oil-spread", 1), ("soup-mix", 2), ("eggs", 3)]
    assert (r["a"].date, r["a"].manager, r["a"].cashier, r["a"].reported) == ("09/04/2030", "AA", "BB", 6)
    assert r["a"].validation.qtyMatchReported and not r["a"].validation.rowsMatchReported
    assert r["b"]["items"] == [] and not r["b"].validation.qtyMatchReported


def test_copied_receipts(spark):
    rows = [("b", DAY, "1", "x", 1), ("a", DAY, "1", "x", 1), ("c", DAY, "1", "y", 1), ("d", None, "1", "x", 1)]
    got = trips.drop_copied_receipts(spark.createDataFrame(rows, "source string, d date, t string, item string, qty int"))
    assert sorted(r.source for r in got.collect()) == ["a", "c"]


def test_items_and_normalize(spark):
    e = spark.createDataFrame([("b", days(1)[0]), ("a", days(2)[0]), ("b", days(0)[0])], "item string, d date")
    assert sorted(map(tuple, items.item_ids(e).collect())) == [("a", 1), ("b", 0)]
    v = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "id int, v double")
    assert {r.v_norm for r in normalize.apply(v, normalize.fit(v, ["v"])).collect()} == {0.0}
    with pytest.raises(ValueError):
        normalize.require_no_nulls(spark.createDataFrame([(1, None)], "a int, b int"))

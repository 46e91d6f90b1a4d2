"""As-of and interval joins against loops over all rows, and their plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from basketry.functions import calendar as C
from basketry.operators import overtime
from basketry.sources import tables


def sides(rng):
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(30)])) for i in range(80)]
    right = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(0, 30, 2)]), rng.randint(0, 5)) for _ in range(40)]
    return left, right


def by_hand(left, right, keyed, direction, strict, tolerance):
    out = set()
    for i, k, t in left:
        near = []
        for rk, rt, v in right:
            if t is None or rt is None or keyed and (k is None or rk != k) or strict and rt == t:
                continue
            away = t - rt
            if (direction == "backward" and away < 0) or (direction == "forward" and away > 0) or tolerance is not None and abs(away) > tolerance:
                continue
            near.append((-abs(away), away >= 0, v, rt))
        best = max(near, default=None)
        out.add((i, k, t, best[3] if best else None, best[2] if best else None))
    return out


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("strict, tolerance, keyed, bucket", [(False, None, True, None), (True, 3, True, 4), (True, None, False, 5), (False, 1, False, 100)])
def test_as_of(spark, direction, strict, tolerance, keyed, bucket):
    left, right = sides(random.Random(hash((direction, strict, keyed)) % 100))
    l, r = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int")
    r = r if keyed else r.drop("k")
    got = overtime.as_of(l, r, "t", ("k",) if keyed else (), direction, strict, tolerance, bucket)
    assert {tuple(x) for x in got.select("i", "k", "t", "t_right", "v").collect()} == by_hand(left, right, keyed, direction, strict, tolerance)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_as_of_has_one_shuffle(spark):
    l, r = spark.createDataFrame([(1, 2)], "k int, t int"), spark.createDataFrame([(1, 1, 5)], "k int, t int, v int")
    text = plan(overtime.as_of(l, r, "t", ("k",)))
    assert text.count("Exchange") == 1 and "Join" not in text
    with pytest.raises(ValueError):
        overtime.as_of(l, r, "t")
    with pytest.raises(ValueError):
        overtime.as_of(l, r.withColumnRenamed("v", "t_right"), "t", ("k",))


@pytest.mark.parametrize("full", [1, 1000])
def test_within(spark, monkeypatch, full):
    monkeypatch.setattr(overtime, "FULL", full)
    rng, day = random.Random(full), dt.date(2030, 1, 1)
    at = lambda n: None if n is None else day + dt.timedelta(n)
    points = [(i, rng.choice("ab"), rng.choice([None, 7, 7, 7, *range(60)])) for i in range(90)]
    periods = [(j, rng.choice(["a", "b", None]), s, None if rng.random() < 0.05 else s + rng.choice([-1, 0, 1, 3, 40, 700, 20000])) for j, s in enumerate(rng.choices(range(-10, 60), k=40))]
    p = spark.createDataFrame([(i, k, at(t)) for i, k, t in points], "i int, k string, t date")
    q = spark.createDataFrame([(j, k, at(s), at(e)) for j, k, s, e in periods], "j int, k string, s date, e date")
    want = {(i, j) for i, k, t in points for j, k2, s, e in periods if k == k2 and None not in (t, e) and s <= t <= e}
    got = overtime.within(p, q, "t", "s", "e", 2, ("k",))
    rows = [(r.i, r.j) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    free = {(i, j) for i, _, t in points for j, _, s, e in periods if None not in (t, e) and s <= t <= e}
    assert {(r.i, r.j) for r in overtime.within(p.drop("k"), q.drop("k"), "t", "s", "e", 2).collect()} == free
    assert overtime.within(p.limit(0), q, "t", "s", "e", 2, ("k",)).count() == overtime.within(p, q.limit(0), "t", "s", "e", 2, ("k",)).count() == 0


def test_within_without_nested_loops(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p, q = spark.createDataFrame([(1, 5)], "i int, t int"), spark.createDataFrame([(1, 2, 9)], "j int, s int, e int")
        text = plan(overtime.within(p, q, "t", "s", "e", 4))
        assert "NestedLoop" not in text and "Cartesian" not in text and "SortMergeJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_holiday_table(spark):
    years = spark.createDataFrame([(y,) for y in range(1995, 2035)], "y int")
    assert {tuple(r) for r in C.holiday_table(years).collect()} == set(C.federal_holidays(1995, 2034))


def test_orders_of_any_form(spark, tmp_path):
    wide = ",".join(f"c{i}" for i in range(100))
    files = {
        "a.csv": '﻿Order Date,Product Description,Product Quantity\n2030-01-02,"Great Value\nMilk, ""2%""",2\nno date,Tea,x\n',
        "b.CSV": f"{wide}, Product Quantity ,Order Date,Product Description\n{',' * 99},3,2030-01-03,Freshness Guaranteed Bun\n",
        "c.csv": "Order Date,Other\n2030-01-04,z\n",
        "d.txt": "Order Date\n2030-01-05\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = {tuple(r) for r in tables.read_orders(spark, str(tmp_path)).collect()}
    day = lambda n: dt.date(2030, 1, n)
    assert got == {("a.csv", day(2), 'Milk, "2%"', 2), ("a.csv", None, "Tea", None), ("b.CSV", day(3), "Bun", 3), ("c.csv", day(4), None, None)}
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "e.csv").write_text("Order Date,Product Quantity\n" + "2030-01-02,1\n" * 40000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        split = tables.read_orders(spark, str(tmp_path / "big"), quoted_breaks=False)
        assert split.rdd.getNumPartitions() > 3 and split.agg(F.sum("qty")).first()[0] == 40000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

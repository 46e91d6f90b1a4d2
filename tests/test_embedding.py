"""Training with embeddings against a plain run in numpy, and what is learned of items."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import embedding as E
from basketry.operators import learn

FEATURES = ["a", "b"]


def planted(spark, items=40, n=4000):
    """Whether an item sells depends on how it takes to the features, not on its number."""
    rng = random.Random(1)
    taste = {i: (rng.choice([-1, 1]) * 3, rng.choice([-1, 1]) * 3) for i in range(items)}
    rows = []
    for k in range(n):
        i, a, b = rng.randrange(items), rng.uniform(-1, 1), rng.uniform(-1, 1)
        rows.append((i, dt.date(2030, 1, 1) + dt.timedelta(k * 100 // n), a, b, int(rng.random() < 1 / (1 + math.exp(-taste[i][0] * a - taste[i][1] * b)))))
    return spark.createDataFrame(rows, "item_id long, d date, a double, b double, label int")


def by_numpy(rows, start, steps, dim, optimizer, rate, decay, seed):
    """Full-batch training, written out by hand."""
    items = sorted(start)
    at = {x: k for k, x in enumerate(items)}
    table = np.array([start[x] for x in items])
    (w1, b1), (w2, b2) = E.new_layers([dim + 2, 3, 1], seed)
    idx = np.array([at[r[0]] for r in rows])
    x, y = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows], float)
    state = [np.zeros_like(p) for p in (table, w1, b1, w2, b2) for _ in (0, 1)]
    for t in range(1, steps + 1):
        z = np.hstack([table[idx], x])
        pre = z @ w1 + b1
        h = np.maximum(pre, 0)
        p = 1 / (1 + np.exp(-(h @ w2 + b2)[:, 0]))
        e = (p - y)[:, None] / len(rows)
        dh = (e @ w2.T) * (pre > 0)
        dz = dh @ w1.T
        dt_ = np.zeros_like(table)
        np.add.at(dt_, idx, dz[:, :dim])
        params, grads = [table, w1, b1, w2, b2], [dt_, z.T @ dh, dh.sum(0), h.T @ e, e.sum(0)]
        for k, (q, g) in enumerate(zip(params, grads)):
            if optimizer == "sgd":
                q -= rate * g
                continue
            m, v = state[2 * k], state[2 * k + 1]
            m[:], v[:] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7) + rate * decay * q
    return {x: table[at[x]] for x in items}, [(w1, b1), (w2, b2)]


@pytest.mark.parametrize("optimizer, decay", [("adamw", 0.1), ("sgd", 0.0)])
def test_same_as_numpy(spark, optimizer, decay):
    rows = planted(spark, 5, 60)
    model = E.train(rows, FEATURES, "label", dim=2, hidden=(3,), batches=1, rounds=3, rate=0.05, optimizer=optimizer, decay=decay, validation=0.0, patience=9, seed=3)
    start = {r[0]: r[1] for r in rows.select("item_id").distinct().select("item_id", E.new_vector("item_id", 2, 3)).collect()}
    table, layers = by_numpy([(r.item_id, r.a, r.b, r.label) for r in rows.collect()], start, 3, 2, optimizer, 0.05, decay, 3)
    assert {r.item_id for r in model.embeddings.collect()} == set(table)
    for r in model.embeddings.collect():
        assert np.allclose(r.vector, table[r.item_id])
    assert all(np.allclose(a, b) for got, want in zip(model.layers, layers) for a, b in zip(got, want))


def test_planted_embedding(spark):
    rows = planted(spark)
    train, test = learn.split_by_time(rows)
    model = E.train(train, FEATURES, "label", dim=4, hidden=(12,), batches=2, rounds=14, rate=0.08, validation=0.1, patience=3)
    assert 1 < len(model.losses) <= 14 and model.losses[-1][0] < model.losses[0][0]
    got = learn.auc(E.scores(model, test, ["item_id", "label"]), "label")
    trees = learn.auc(learn.boosted_scores(rows, FEATURES, "label", trees=5).join(test.select("item_id", "d").distinct(), ["item_id", "d"], "left_semi"), "label")
    assert got > 0.75 and got > trees + 0.1
    unknown = spark.createDataFrame([(999, 0.1, None)], "item_id long, a double, b double")
    assert 0 < E.scores(model, unknown, ["item_id"]).first().score < 1


def test_no_rows_and_wrong_names(spark):
    rows = planted(spark, 2, 4)
    assert E.train(rows.limit(0), FEATURES, "label", batches=1, rounds=2).losses == []
    with pytest.raises(ValueError):
        E.train(rows, FEATURES, "label", optimizer="other")


def test_item_rate_tells_items_apart(spark):
    rng = random.Random(2)
    often = {i: rng.choice([0.05, 0.9]) for i in range(60)}
    days = [dt.date(2030, 1, 1) + dt.timedelta(k) for k in range(40)]
    rows = spark.createDataFrame([(i, d, rng.random(), int(rng.random() < often[i])) for i in often for d in days], "item_id long, d date, a double, label int")
    rated = learn.with_item_rate(rows, "label")
    first = rated.where(F.col("d") == days[0]).select("item_rate").distinct().collect()
    assert [r[0] for r in first] == [0.0]
    late = rated.where(F.col("d") > days[30]).withColumn("score", F.col("item_rate"))
    assert learn.auc(late, "label") > learn.auc(late.withColumn("score", F.col("item_id").cast("double")), "label") + 0.2


def test_each_item_as_if_alone(spark):
    rows = planted(spark, 20, 600)
    got = {r.item_id: r.weights for r in learn.fit_each_item(rows, FEATURES, "label", steps=6, rate=0.7, decay=0.01).collect()}
    data = [(r.item_id, [1.0, r.a, r.b], r.label) for r in rows.collect()]
    for item in range(20):
        x, y, w = np.array([v for i, v, _ in data if i == item]), np.array([v for i, _, v in data if i == item]), np.zeros(3)
        for _ in range(6):
            w = w - 0.7 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + 0.01 * w)
        assert np.allclose(got[item], w)
    ranked = learn.next_basket(rows, spark.createDataFrame(list(got.items()), "item_id long, weights array<double>"), FEATURES).collect()
    assert len(ranked) == 20 and {r["rank"] for r in ranked} >= {1}


def test_stratified_split_of_odd_labels(spark):
    df = spark.createDataFrame([(i, [None, "x", "y"][i % 3]) for i in range(300)], "i int, label string")
    first, rest = learn.split_stratified(df, "label", 0.8)
    assert {r[0]: r[1] for r in first.groupBy("label").count().collect()} == {None: 80, "x": 80, "y": 80}
    assert first.count() + rest.count() == 300 and first.columns == df.columns

"""The perceptron with an input for every item, against a plain one with wide rows."""

import datetime as dt
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import learn
from basketry.operators import perceptron as P

DAY = dt.date(2024, 1, 1)


def plain(weights, x, y, layers):
    """Mean loss and gradient of a network of wide rows, by the book."""
    parts, at = [], 0
    for a, b in layers:
        parts.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    outs = [x]
    for w, b in parts[:-1]:
        outs.append(1 / (1 + np.exp(-(outs[-1] @ w + b))))
    z = outs[-1] @ parts[-1][0] + parts[-1][1]
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    hit = np.stack([1 - y, y], 1)
    back, grads = (p - hit) / len(y), []
    for k in range(len(parts) - 1, -1, -1):
        grads.append(np.concatenate([(outs[k].T @ back).ravel(), back.sum(0)]))
        if k:
            back = (back @ parts[k][0].T) * outs[k] * (1 - outs[k])
    return -np.log((p * hit).sum(1)).mean(), np.concatenate(grads[::-1]), p[:, 1]


def by_the_book(weights, f, steps):
    """L-BFGS with two pairs."""
    pairs, (loss, g), losses = [], f(weights), []
    for _ in range(steps):
        q, firsts = g.copy(), []
        for s, t in reversed(pairs):
            firsts.append(s @ q / (s @ t))
            q -= firsts[-1] * t
        q *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / math.sqrt(g @ g)
        for (s, t), first in zip(pairs, reversed(firsts)):
            q += (first - t @ q / (s @ t)) * s
        a = 1.0
        while f(weights - a * q)[0] > loss - 1e-4 * a * (g @ q):
            a /= 2
        last, before = weights, g
        weights = weights - a * q
        loss, g = f(weights)
        pairs = [*pairs, (weights - last, g - before)][-2:]
        losses.append(loss)
    return weights, losses


def wide(model, keys):
    """The model as weights of wide rows: the columns' inputs, then a row for each key."""
    vectors = {r["key"]: r["vector"] for r in model.vectors.collect()}
    (w, b), *rest = model.layers
    return np.concatenate([w.ravel(), np.array([vectors[k] for k in keys]).ravel(), b, *(np.concatenate([v.ravel(), c]) for v, c in rest)])


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    made = [(k, DAY + dt.timedelta(d), float(d % 7), float(k), int(rng.random() < (0.15, 0.8, 0.5)[k % 3])) for k in range(9) for d in range(20)]
    made += [(100, DAY, j / 300, 1.0, int(j % 5 == 0)) for j in range(300)]  # more than a block
    made += [(None, DAY, 1.0, 1.0, 1)] * 7 + [(3, DAY, 2.0, 3.0, 0)] * 40
    return spark.createDataFrame(made, "item_id long, d date, a double, b double, y int")


def test_as_with_wide_rows(spark, rows):
    sizes, steps = (4, 3), 5
    start, model = (P.train(rows, ["a", "b"], "y", sizes, steps=n, pairs=2) for n in (0, steps))
    got = rows.collect()
    keys = sorted({"" if r.item_id is None else f"={r.item_id}" for r in got})
    assert len(keys) == 11 and sorted(r["key"] for r in model.vectors.collect()) == keys
    x = np.array([[r.a, r.b, *(float(k == ("" if r.item_id is None else f"={r.item_id}")) for k in keys)] for r in got])
    y = np.array([float(r.y) for r in got])
    layers = [(2 + len(keys), 4), (4, 3), (3, 2)]
    expected, losses = by_the_book(wide(start, keys), lambda w: plain(w, x, y, layers)[:2], steps)
    assert np.allclose(model.losses[1:], losses, atol=1e-9) and model.losses[-1] < model.losses[0]
    assert np.allclose(wide(model, keys), expected, atol=1e-6)
    chances = plain(expected, x, y, layers)[2]
    asked = P.scores(model, rows, ["item_id", "a", "b"]).collect()
    assert len(asked) == len(got)
    known = {(r.item_id, r.a, r.b): c for r, c in zip(got, chances)}
    assert all(abs(known[r.item_id, r.a, r.b] - r.score) < 1e-6 for r in asked)
    # Items not trained on have the input of those without an id.
    one = lambda k: P.scores(model, spark.createDataFrame([(k, 1.0, 1.0)], "item_id long, a double, b double"), ["item_id"]).first().score
    assert one(12345) == one(None) != one(3)


def test_other_settings(spark, rows):
    slow = P.train(rows, ["a"], "y", (3,), steps=3, solver="gd")
    assert slow.losses[0] > slow.losses[1] > slow.losses[-1]
    hashed = P.train(rows, [], "y", (), width=4, steps=2)
    assert {r["key"] for r in hashed.vectors.collect()} <= {"", "0", "1", "2", "3"} and hashed.losses[-1] < hashed.losses[0]
    with pytest.raises(ValueError, match="no rows"):
        P.train(rows.limit(0), ["a"], "y")
    with pytest.raises(Exception, match="a has no number"):
        P.train(rows.withColumn("a", F.lit(None).cast("double")), ["a"], "y", steps=1)


def test_work_does_not_grow_with_items_times_rows(spark):
    """20,000 items of 4 rows: with rows as wide as there are items, one pass would take 1.6e9 products for each unit of a layer."""
    n = 20_000
    rows = spark.range(4 * n).select((F.col("id") % n).alias("item_id"), F.date_add(F.lit(DAY), F.floor(F.col("id") / n).cast("int")).alias("d"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = learn.perceptron_scores(rows, ["a"], "y", steps=3).agg(F.count(F.lit(1)), F.count_distinct("item_id"), F.min("score"), F.max("score")).first()
    finally:
        stop.cancel()
    assert got[0] == 4 * n and got[1] == n and 0 < got[2] <= got[3] < 1

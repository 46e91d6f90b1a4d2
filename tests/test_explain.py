"""Contributions of features against an enumeration of all subsets."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from basketry.operators import explain

NAMES = [f"x{k}" for k in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.random((300, 6)).round(2)
    x[:, 5] = rng.integers(0, 4, 300)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + (x[:, 5] == 2) > 1).astype(float)
    df = spark.createDataFrame([(k, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y))], ["k", *NAMES, "label"])
    df = VectorAssembler(inputCols=NAMES, outputCol="raw").transform(df)
    # The last feature is categorical.
    return VectorIndexer(inputCol="raw", outputCol="features", maxCategories=4).fit(df).transform(df).select("k", "label", "features").cache()


def expected(nodes, i, x, known):
    """The tree's mean below a node, walked from the node itself."""
    node = nodes[i]
    if node["leftChild"] < 0:
        return node["prediction"]
    s, sides = node["split"], (node["leftChild"], node["rightChild"])
    if s["featureIndex"] in known:
        value, values = x[s["featureIndex"]], s["leftCategoriesOrThreshold"]
        left = value <= values[0] if s["numCategories"] < 0 else value in values
        return expected(nodes, sides[0 if left else 1], x, known)
    return sum(nodes[c]["rawCount"] * expected(nodes, c, x, known) for c in sides) / node["rawCount"]


@pytest.mark.parametrize("trainer", [GBTClassifier, GBTRegressor])
def test_against_all_subsets(spark, tmp_path, rows, trainer):
    model = trainer(maxIter=4, maxDepth=5, seed=1, stepSize=0.3).fit(rows)
    margin = vector_to_array("rawPrediction")[1] if trainer is GBTClassifier else F.col("prediction")
    scored = model.transform(rows).select("k", "features", margin.alias("margin"))
    got = {r.k: r for r in explain.with_contributions(scored, model).collect()}
    assert len(got) == 300 and all(abs(r.base + sum(r.contributions) - r.margin) < 1e-9 for r in got.values())
    model.write().save(str(tmp_path / "model"))
    trees = {}
    for r in spark.read.parquet(str(tmp_path / "model/data")).select("treeID", "nodeData.*").collect():
        trees.setdefault(r.treeID, {})[r.id] = r.asDict(recursive=True)
    assert any(n["split"]["numCategories"] > 0 for t in trees.values() for n in t.values())
    worth = lambda x, known: sum(w * expected(trees[k], 0, x, known) for k, w in enumerate(model.treeWeights))
    for r in rows.where("k < 12").collect():
        x = r.features.toArray()
        of = {s: worth(x, s) for n in range(7) for s in map(frozenset, combinations(range(6), n))}
        for i in range(6):
            want = sum(math.factorial(len(s)) * math.factorial(5 - len(s)) / 720 * (of[s | {i}] - of[s]) for s in of if i not in s)
            assert abs(got[r.k].contributions[i] - want) < 1e-9
        assert abs(got[r.k].base - of[frozenset()]) < 1e-9


def test_odd_rows_and_importance(spark, rows, monkeypatch):
    model = GBTClassifier(maxIter=2, maxDepth=2, seed=1).fit(rows)
    few = rows.limit(2).unionByName(rows.limit(1).withColumn("features", F.when(F.lit(False), F.col("features"))))
    got = explain.with_contributions(few.withColumn("tree", F.lit("x")), model).collect()
    assert [r.contributions is None for r in got] == [False, False, True] and {r.tree for r in got} == {"x"}
    assert explain.with_contributions(rows.limit(0), model).count() == 0
    shown = {r.feature: r.importance for r in explain.importance(explain.with_contributions(rows, model), NAMES).collect()}
    assert list(shown) == NAMES and shown["x0"] > 0 and shown["x3"] == 0
    with pytest.raises(ValueError, match="of these names"):
        explain.with_contributions(rows.withColumn("base", F.lit(1)), model)
    monkeypatch.setattr(explain, "MOST_NODES", 3)
    with pytest.raises(ValueError, match="nodes"):
        explain.with_contributions(rows, model)

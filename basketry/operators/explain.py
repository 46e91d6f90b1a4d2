"""What each feature adds to a score of boosted trees: Shapley values, exact, by the trees' own paths.

A feature that isn't known is averaged over: at a split on it both branches count, by the
shares of training rows that went there. Then a leaf is worth its prediction times a factor
for each feature on its path, which is 1 or 0 where the feature is known (the row goes this
way or not) and the product of the branches' shares where it isn't. The Shapley values of
such a product come from the coefficients of a polynomial, one factor for each feature, so
no subsets are enumerated; rows that pass the same splits of a path share the work.

A model of at most MOST_NODES nodes is sent to the workers; a larger one is refused. Rows
whose features are null have null contributions; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.storage import delete, shared_path

#: Nodes of all trees that a model may have: some 200 bytes each.
MOST_NODES = 1_000_000


class Condition(NamedTuple):
    """What a path asks of a feature: not <= low, <= high, and, of a categorical one, to be among the categories; and the share of training rows that go this way at its splits."""

    feature: int
    low: float
    high: float
    categories: tuple[float, ...] | None
    share: float

    def met(self, x: np.ndarray) -> np.ndarray:
        value = x[:, self.feature]
        found = np.ones(len(x), bool)
        if self.low > -math.inf:
            found &= ~(value <= self.low)
        if self.high < math.inf:
            found &= value <= self.high
        return found if self.categories is None else found & np.isin(value, self.categories)


class Leaf(NamedTuple):
    value: float
    path: tuple[Condition, ...]


def leaves_of(nodes: dict[int, dict], weight: float = 1.0) -> list[Leaf]:
    """The leaves of a tree of nodes by their numbers, the root being 0; a feature that a path splits on again has one condition."""
    out, open_ = [], [(0, {})]
    while open_:
        i, path = open_.pop()
        node = nodes[i]
        if node["leftChild"] < 0:
            out.append(Leaf(weight * node["prediction"], tuple(path.values())))
            continue
        feature, values, n = (node["split"][k] for k in ("featureIndex", "leftCategoriesOrThreshold", "numCategories"))
        for side, child in (("left", node["leftChild"]), ("right", node["rightChild"])):
            now = path.get(feature, Condition(feature, -math.inf, math.inf, None, 1.0))
            if n < 0:
                now = now._replace(high=min(now.high, values[0])) if side == "left" else now._replace(low=max(now.low, values[0]))
            else:
                own = {float(k) for k in range(n)} if now.categories is None else {*now.categories}
                now = now._replace(categories=tuple(sorted(own & {*values} if side == "left" else own - {*values})))
            open_.append((child, {**path, feature: now._replace(share=now.share * nodes[child]["rawCount"] / node["rawCount"])}))
    return out


def leaves(model: GBTClassificationModel | GBTRegressionModel, rows: DataFrame) -> list[Leaf]:
    """The leaves of all trees, with the trees' weights, from the model as it is kept."""
    spark = rows.sparkSession
    path = shared_path(spark, "trees")
    model.write().save(path)
    try:
        kept = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
        if (n := kept.count()) > MOST_NODES:
            raise ValueError(f"{n} nodes: more than {MOST_NODES}")
        trees: dict[int, dict[int, dict]] = {}
        for r in kept.select("treeID", "id", "prediction", "rawCount", "leftChild", "rightChild", "split").collect():
            trees.setdefault(r["treeID"], {})[r["id"]] = r.asDict(recursive=True)
    finally:
        delete(spark, path)
    return [leaf for k, weight in enumerate(model.treeWeights) for leaf in leaves_of(trees[k], weight)]


def _of_pattern(leaf: Leaf, known: np.ndarray) -> np.ndarray:
    """Of rows by which of a leaf's conditions they meet (0 or 1): what each of its features adds."""
    d, shares = len(leaf.path), np.array([c.share for c in leaf.path])
    weights = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
    out = np.empty(known.shape)
    for i in range(d):
        terms = np.zeros((len(known), d))
        terms[:, 0] = 1.0
        for j in range(d):
            if j != i:
                terms[:, 1:] = terms[:, 1:] * shares[j] + terms[:, :-1] * known[:, j : j + 1]
                terms[:, 0] *= shares[j]
        out[:, i] = leaf.value * (known[:, i] - shares[i]) * (terms @ weights)
    return out


def contributions_of(found: list[Leaf], x: np.ndarray) -> np.ndarray:
    """What each feature (a column of x) adds to each row's score."""
    out = np.zeros(x.shape)
    for leaf in found:
        if leaf.path and leaf.value:
            met = np.stack([c.met(x) for c in leaf.path], 1)
            _, first, of = np.unique(met @ (1 << np.arange(len(leaf.path), dtype=np.int64)), return_index=True, return_inverse=True)
            out[:, [c.feature for c in leaf.path]] += _of_pattern(leaf, met[first].astype(float))[of.reshape(-1)]
    return out


def with_contributions(rows: DataFrame, model: GBTClassificationModel | GBTRegressionModel, features: str = "features") -> DataFrame:
    """The rows with base (the score when nothing is known) and contributions (what each feature adds) in place of the features: base and contributions sum up to the model's margin, of which a classifier's raw prediction is made."""
    if clash := {"base", "contributions"} & {*rows.columns}:
        raise ValueError(f"columns of these names are there: {sorted(clash)}")
    found = leaves(model, rows)
    base = sum(leaf.value * math.prod(c.share for c in leaf.path) for leaf in found)
    sent = rows.sparkSession.sparkContext.broadcast(found)
    kept = [c for c in rows.columns if c != features]
    slim = rows.select(*kept, F.when(F.col(features).isNotNull(), vector_to_array(features)).alias("contributions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(len(kept))
            there = given.is_valid().to_numpy(zero_copy_only=False)
            x = np.array(given.filter(given.is_valid()).to_pylist(), float)
            added = contributions_of(sent.value, x).tolist() if len(x) else []
            each = iter(added)
            out = pa.array([next(each) if t else None for t in there], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), out], names=[*kept, "contributions"])

    schema = T.StructType([*slim.select(*kept).schema, T.StructField("contributions", T.ArrayType(T.DoubleType()))])
    return slim.mapInArrow(run, schema).withColumn("base", F.lit(float(base)))


def importance(explained: DataFrame, names: list[str]) -> DataFrame:
    """(feature, importance): how much each feature moves the score, on average over the rows."""
    each = explained.agg(*(F.avg(F.abs(F.col("contributions")[k])).alias(f"_{k}") for k in range(len(names))))
    return each.select(F.explode(F.array(*(F.struct(F.lit(name).alias("feature"), F.col(f"_{k}").alias("importance")) for k, name in enumerate(names)))).alias("x")).select("x.*")

"""A network over item embeddings and features, trained in mini-batches by all executors.

An item's embedding is a row of a table, found and amended by key: no driver or task holds
all of them, and items may be as many as rows. The layers above are small and go out with
each step. A step reads one mini-batch, a folder of its own, joins the items' embeddings,
and works out gradients in Arrow batches: each task sums up those of the layers, and those
of items before they are shuffled by item. Tasks' sums for the layers are summed up by a
few tasks before they reach the driver.

Adam and AdamW hold their moments beside the weights; an embedding that a mini-batch
doesn't touch stays as it is, moments included. Training ends when the loss on the rows
held out hasn't fallen for `patience` rounds, and the best round's model is given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.storage import delete, shared_path

OPTIMIZERS = ("adam", "adamw", "sgd")
BETA1, BETA2, EPS = 0.9, 0.999, 1e-7
Layers = list[tuple[np.ndarray, np.ndarray]]


@dataclass
class Model:
    """layers: weights and constants from the inputs (embedding, then features) to one output. embeddings: (item_id, vector). losses: (training, held out) of each round."""

    layers: Layers
    embeddings: DataFrame
    columns: list[str]
    dim: int
    losses: list[tuple[float, float]] = field(default_factory=list)


def new_layers(sizes: list[int], seed: int) -> Layers:
    rng = np.random.default_rng(seed)
    return [(rng.uniform(-1, 1, (a, b)) * math.sqrt(6 / (a + b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]


def new_vector(item: str, dim: int, seed: int) -> Column:
    """Small numbers that the item and the seed decide."""
    part = lambda j: (F.pmod(F.xxhash64(F.col(item), F.lit(j), F.lit(seed)), F.lit(1 << 20)) / (1 << 20) - 0.5) * 0.1
    return F.array(*(part(j) for j in range(dim)))


def forward(layers: Layers, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The chances, and each layer's inputs."""
    inputs = [x]
    for w, b in layers[:-1]:
        inputs.append(np.maximum(inputs[-1] @ w + b, 0))
    z = (inputs[-1] @ layers[-1][0] + layers[-1][1])[:, 0]
    return 1 / (1 + np.exp(-np.clip(z, -60, 60))), inputs


def gradients(layers: Layers, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums over rows of the gradients of all layers in one vector, the gradient of each row's inputs, and the summed loss."""
    p, inputs = forward(layers, x)
    loss = float(-(y * np.log(np.maximum(p, 1e-12)) + (1 - y) * np.log(np.maximum(1 - p, 1e-12))).sum())
    back, parts = (p - y)[:, None], []
    for (w, _), entered in zip(reversed(layers), reversed(inputs)):
        parts.append(np.concatenate([(entered.T @ back).ravel(), back.sum(0)]))
        back = (back @ w.T) * (entered > 0) if entered is not x else back @ w.T
    return np.concatenate(parts[::-1]), back, loss


def _flat(layers: Layers) -> np.ndarray:
    return np.concatenate([np.concatenate([w.ravel(), b]) for w, b in layers])


def _shaped(flat: np.ndarray, layers: Layers) -> Layers:
    out, at = [], 0
    for w, b in layers:
        out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(False).reshape(rows, -1) if rows else np.zeros((0, 0))


_GRADIENTS = "item_id long, g array<double>, n long, loss double"


def _batch(items, g: np.ndarray, n: int, loss: float) -> pa.RecordBatch:
    rows = len(g)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * g.shape[1]), pa.array(g.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), lists, pa.array([n] * rows, pa.int64()), pa.array([loss] * rows)], names=["item_id", "g", "n", "loss"])


def _gradients_of(layers: Layers, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, loss = np.zeros(_flat(layers).size), 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            items = batch.column("item_id").to_numpy()
            x = np.concatenate([_matrix(batch.column("vector"), len(items)), _matrix(batch.column("x"), len(items))], 1)
            g, back, more = gradients(layers, x, batch.column("y").to_numpy())
            total, n, loss = total + g, n + len(items), loss + more
            own, place = np.unique(items, return_inverse=True)
            sums = np.zeros((len(own), dim))
            np.add.at(sums, place, back[:, :dim])
            yield _batch(own, sums, 0, 0.0)
        # A row without an item is a task's sum for the layers.
        yield _batch([None], total[None, :], n, loss)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n, loss = None, 0, 0.0
    for batch in batches:
        if batch.num_rows:
            g = _matrix(batch.column("g"), batch.num_rows).sum(0)
            total = g if total is None else total + g
            n, loss = n + int(batch.column("n").to_numpy().sum()), loss + float(batch.column("loss").to_numpy().sum())
    if total is not None:
        yield _batch([None], total[None, :], n, loss)


def _loss_of(layers: Layers):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.concatenate([_matrix(batch.column(c), batch.num_rows) for c in ("vector", "x")], 1)
                yield _batch([None], np.zeros((1, 1)), batch.num_rows, gradients(layers, x, batch.column("y").to_numpy())[2])

    return run


def _inputs(rows: DataFrame, columns: list[str]) -> Column:
    return F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns)).cast("array<double>")


def _amended(embeddings: DataFrame, grads: DataFrame, dim: int, n: int, step: int, optimizer: str, rate: float, decay: float) -> DataFrame:
    """The table after a step: rows with gradients change."""
    sums = grads.groupBy("item_id").agg(F.array(*(F.sum(F.col("g")[j]) / n for j in range(dim))).alias("g"))
    rows = embeddings.join(sums, "item_id", "left")
    if optimizer == "sgd":
        return rows.select("item_id", F.when(F.col("g").isNull(), F.col("vector")).otherwise(F.zip_with("vector", "g", lambda a, g: a - rate * g)).alias("vector"), "m", "v")
    rows = rows.withColumn("_m", F.zip_with("m", "g", lambda a, g: BETA1 * a + (1 - BETA1) * g)).withColumn("_v", F.zip_with("v", "g", lambda a, g: BETA2 * a + (1 - BETA2) * g * g))
    c1, c2 = 1 - BETA1**step, 1 - BETA2**step
    moved = F.zip_with("_m", "_v", lambda m, v: rate * (m / c1) / (F.sqrt(v / c2) + EPS))
    fresh = F.zip_with("vector", moved, lambda a, d: a - d - rate * decay * a)
    pick = lambda old, new: F.when(F.col("g").isNull(), F.col(old)).otherwise(new).alias(old)
    return rows.select("item_id", pick("vector", fresh), pick("m", F.col("_m")), pick("v", F.col("_v")))


def train(rows: DataFrame, columns: list[str], label: str, dim: int = 8, hidden: tuple[int, ...] = (16,), batches: int = 8, rounds: int = 20, rate: float = 0.01, optimizer: str = "adam", decay: float = 0.0, validation: float = 0.1, patience: int = 3, seed: int = 42) -> Model:
    """Of rows (item_id, label, the columns): a model of the chance that the label is 1. Rows without an item or label are left out; nulls in columns count as 0. A hash of the row deals it to the share that is held out, or to one of the mini-batches; a round takes each once. decay holds for adamw."""
    if optimizer not in OPTIMIZERS:
        raise ValueError(f"optimizer must be one of {OPTIMIZERS}, not {optimizer!r}")
    spark = rows.sparkSession
    decay = decay if optimizer == "adamw" else 0.0
    dealt = rows.where(F.col("item_id").isNotNull() & F.col(label).isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), _inputs(rows, columns).alias("x"), F.col(label).cast("double").alias("y"))
    h = F.xxhash64("item_id", "x", "y", F.lit(seed), F.monotonically_increasing_id())
    part = F.when(F.pmod(h, F.lit(1000)) < round(1000 * validation), -1).otherwise(F.pmod(F.shiftright(h, 16), F.lit(batches))).cast("int")
    place = shared_path(spark, "batches")
    dealt.withColumn("part", part).write.partitionBy("part").parquet(place)
    data = spark.read.schema("item_id long, x array<double>, y double, part int").parquet(place)
    held = data.where("part = -1")

    def put(df: DataFrame) -> str:
        path = shared_path(spark, "embeddings")
        df.write.parquet(path)
        return path

    none = F.array_repeat(F.lit(0.0), dim)
    table = "item_id long, vector array<double>, m array<double>, v array<double>"
    path = put(data.select("item_id").distinct().select("item_id", new_vector("item_id", dim, seed).alias("vector"), none.alias("m"), none.alias("v")))
    layers = new_layers([dim + len(columns), *hidden, 1], seed)
    m = v = np.zeros(_flat(layers).size)
    best, best_path, best_layers, waited, step, losses = math.inf, path, layers, 0, 0, []
    known = lambda p: spark.read.schema(table).parquet(p)
    for _ in range(rounds):
        seen, lost = 0, 0.0
        for b in range(batches):
            met = data.where(F.col("part") == b).join(known(path).select("item_id", "vector"), "item_id")
            out = shared_path(spark, "gradients")
            met.select("item_id", "vector", "x", "y").mapInArrow(_gradients_of(layers, dim), _GRADIENTS).write.parquet(out)
            grads = spark.read.schema(_GRADIENTS).parquet(out)
            few = max(1, int(math.sqrt(grads.rdd.getNumPartitions())))
            sums = grads.where("item_id IS NULL").coalesce(few).mapInArrow(_summed, _GRADIENTS).collect()
            n = sum(r["n"] for r in sums)
            if n:
                step += 1
                g = np.sum([r["g"] for r in sums], axis=0) / n
                seen, lost = seen + n, lost + sum(r["loss"] for r in sums)
                flat = _flat(layers)
                if optimizer == "sgd":
                    flat = flat - rate * g
                else:
                    m, v = BETA1 * m + (1 - BETA1) * g, BETA2 * v + (1 - BETA2) * g * g
                    flat = flat - rate * (m / (1 - BETA1**step)) / (np.sqrt(v / (1 - BETA2**step)) + EPS) - rate * decay * flat
                layers = _shaped(flat, layers)
                old, path = path, put(_amended(known(path), grads.where("item_id IS NOT NULL"), dim, n, step, optimizer, rate, decay))
                if old != best_path:
                    delete(spark, old)
            delete(spark, out)
        if not seen:
            break
        score = held.join(known(path).select("item_id", "vector"), "item_id").select("vector", "x", "y").mapInArrow(_loss_of(layers), _GRADIENTS).agg(F.sum("loss"), F.sum("n")).first()
        loss = score[0] / score[1] if score[1] else lost / seen
        losses.append((lost / seen, loss))
        if loss < best:
            if best_path != path:
                delete(spark, best_path)
            best, best_path, best_layers, waited = loss, path, layers, 0
        else:
            waited += 1
            if waited >= patience:
                break
    if path != best_path:
        delete(spark, path)
    delete(spark, place)
    return Model(best_layers, known(best_path).select("item_id", "vector"), columns, dim, losses)


def scores(model: Model, rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, and score. Items that the model doesn't know have an embedding of zeros."""
    schema = rows.select(*keep).withColumn("score", F.lit(0.0)).schema
    layers, wanted = model.layers, list(keep)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.concatenate([_matrix(batch.column(c), batch.num_rows) for c in ("_vector", "_x")], 1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in wanted), pa.array(forward(layers, x)[0])], names=[*wanted, "score"])

    table = model.embeddings.select(F.col("item_id").alias("_item"), F.col("vector").alias("_known"))
    met = rows.select(*keep, *([] if "item_id" in keep else ["item_id"]), _inputs(rows, model.columns).alias("_x")).join(table, F.col("item_id") == F.col("_item"), "left")
    none = F.array_repeat(F.lit(0.0), model.dim)
    return met.select(*keep, "_x", F.coalesce("_known", none).alias("_vector")).mapInArrow(run, schema)

"""A perceptron with an input for every item, trained on all rows at once by L-BFGS or gradient descent.

As one input in many is 1, the first layer's product with the items' inputs is a lookup: an
item's weights are a row of a table, found and amended by key, and no row is widened to as
many numbers as there are items. Rows of an item are kept in blocks of some hundred, equal
ones once with their number, so an item's weights meet its rows a block at a time and an
item of very many rows is dealt over many tasks. The other weights are few and go out with
each pass.

L-BFGS needs the earlier steps and changes of gradients only by their dot products, and a
direction is a sum of them: they lie beside each item's weights, tasks sum up dot products,
and the driver gets a small matrix of them. A step that doesn't lower the loss is halved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.embedding import Layers, _flat, _matrix, _shaped, new_vector
from basketry.storage import Rounds, delete, shared_path

BLOCK = 128
#: Rows that numpy takes at once.
AT_ONCE = 16_384
HALVINGS, LEAST_FALL, GD_RATE = 10, 1e-4, 0.03
#: Weights start evenly between -START and START, divided by the number of inputs of their layer, items' inputs and that of unknown ones included, as Spark ML's do.
START = 2.4


@dataclass
class Perceptron:
    """layers: weights and constants from the columns to two outputs; an item's vector is added to the first layer's sums. vectors: (key, vector). shared: the vector of items not trained on. losses: the mean loss at the start and after each step."""

    layers: Layers
    vectors: DataFrame
    shared: list[float]
    columns: list[str]
    width: int | None
    losses: list[float]


def key_of(width: int | None) -> Column:
    """An item's input: its own, or with width one of so many. Rows without an item have the empty key."""
    item = F.col("item_id").cast("string")
    own = F.concat(F.lit("="), item) if width is None else F.pmod(F.xxhash64(item), F.lit(width)).cast("string")
    return F.when(item.isNull(), "").otherwise(own)


def inputs(columns: list[str]) -> Column:
    def known(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x), F.raise_error(F.lit(f"{c} has no number in some row"))).otherwise(x)

    return F.array(*(known(c) for c in columns)).cast("array<double>")


def forward(layers: Layers, x: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The chances of both labels, and each layer's inputs."""
    entered = [x]
    for k, (w, b) in enumerate(layers):
        z = entered[-1] @ w + b + (0 if k else vectors)
        if k < len(layers) - 1:
            entered.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), entered


def gradients(layers: Layers, x: np.ndarray, vectors: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums over rows, each counted n times, of the gradients of all layers in one vector; the gradient of each row's vector; the summed loss."""
    p, entered = forward(layers, x, vectors)
    hit = np.eye(2)[y.astype(int)]
    loss = float(-(n * np.log(np.maximum((p * hit).sum(1), 1e-300))).sum())
    back, parts = (p - hit) * n[:, None], []
    for k in range(len(layers) - 1, -1, -1):
        parts.append(np.concatenate([(entered[k].T @ back).ravel(), back.sum(0)]))
        if k:
            back = (back @ layers[k][0].T) * entered[k] * (1 - entered[k])
    return np.concatenate(parts[::-1]), back, loss


def direction(dots: np.ndarray) -> np.ndarray:
    """Of the dot products of m steps, m changes of gradients and the gradient: the share of each in the direction to go."""
    m = len(dots) // 2
    share, first = np.zeros(2 * m + 1), {}
    share[-1] = -1.0
    good = [i for i in range(m) if dots[i, m + i] > 1e-12 * dots[m + i, m + i]]
    for i in reversed(good):
        first[i] = dots[i] @ share / dots[i, m + i]
        share[m + i] -= first[i]
    share *= dots[good[-1], m + good[-1]] / dots[m + good[-1], m + good[-1]] if good else 1 / math.sqrt(dots[-1, -1])
    for i in good:
        share[i] += first[i] - dots[m + i] @ share / dots[i, m + i]
    return share


def _moved(w: np.ndarray, h: np.ndarray, share: np.ndarray, a: float) -> np.ndarray:
    return w + a * np.einsum("k,nkd->nd", share, h)


def remembered(h: np.ndarray, step: np.ndarray, g: np.ndarray, pairs: int) -> np.ndarray:
    """h (n x (steps, changes, gradient) x d) after a step to where the gradient is g; the last pairs stay."""
    m = h.shape[1] // 2
    old = 1 if m == pairs else 0
    return np.concatenate([h[:, old:m], step[:, None], h[:, m + old : 2 * m], (g - h[:, -1])[:, None], g[:, None]], 1)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


_VECTOR = "key string, vector array<double>"
_SUMS = "key string, g array<double>"
_STATE = "key string, w array<double>, h array<double>"


def _at(share: np.ndarray, a: float, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h = _matrix(batch.column("h"), batch.num_rows).reshape(batch.num_rows, -1, dim)
                yield pa.RecordBatch.from_arrays([batch.column("key"), _lists(_moved(_matrix(batch.column("w"), batch.num_rows), h, share, a))], names=["key", "vector"])

    return run


def _gradients_of(layers: Layers, dim: int):
    """Of blocks with their items' vectors: each block's gradient of the vector. A row without a key is a task's sum for the layers, then the summed loss and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_flat(layers).size + 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            y, n = (batch.column(c).flatten().to_numpy(False) for c in ("ys", "ns"))
            x, vectors = batch.column("xs").flatten().to_numpy(False).reshape(len(y), len(layers[0][0])), _matrix(batch.column("vector"), batch.num_rows)
            ends = np.cumsum(batch.column("ys").value_lengths().to_numpy(False))
            starts, out = np.concatenate([[0], ends[:-1]]), np.zeros((batch.num_rows, dim))
            k = 0
            while k < batch.num_rows:
                end = max(k + 1, int(np.searchsorted(ends, starts[k] + AT_ONCE, "right")))
                rows = slice(starts[k], ends[end - 1])
                g, back, loss = gradients(layers, x[rows], np.repeat(vectors[k:end], ends[k:end] - starts[k:end], 0), y[rows], n[rows])
                total += np.concatenate([g, [loss, n[rows].sum()]])
                out[k:end] = np.add.reduceat(back, starts[k:end] - starts[k], 0)
                k = end
            yield pa.RecordBatch.from_arrays([batch.column("key"), _lists(out)], names=["key", "g"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), _lists(total[None])], names=["key", "g"])

    return run


def _stepped(share: np.ndarray, a: float, dim: int, first: bool, pairs: int):
    """Items' weights after the step. A row without a key is a task's sum of dot products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            w, g = _matrix(batch.column("w"), rows), _matrix(batch.column("g"), rows)
            h = _matrix(batch.column("h"), rows).reshape(rows, -1, dim)
            fresh = _moved(w, h, share, a)
            h = g[:, None] if first or not pairs else remembered(h, fresh - w, g, pairs)
            total = total + np.einsum("nkd,nld->kl", h, h)
            yield pa.RecordBatch.from_arrays([batch.column("key"), _lists(fresh), _lists(h.reshape(rows, -1))], names=["key", "w", "h"])
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.list_(pa.float64())), _lists(total.reshape(1, -1))], names=["key", "w", "h"])

    return run


def _total(table: DataFrame, column: str) -> np.ndarray:
    """The sum, place by place, of the lists in rows without a key."""
    got = table.where("key IS NULL").select(F.posexplode(column)).groupBy("pos").agg(F.sum("col").alias("x")).collect()
    return np.array([r["x"] for r in sorted(got, key=lambda r: r["pos"])])


def blocks_of(rows: DataFrame) -> DataFrame:
    """(key, xs, ys, ns) of distinct rows (key, x, y, n): about BLOCK in each."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    dealt = rows.join(sizes, "key").withColumn("_bin", F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("_n") / BLOCK)))
    packed = dealt.groupBy("key", "_bin").agg(F.collect_list(F.struct("x", "y", "n")).alias("r"))
    return packed.select("key", F.flatten("r.x").alias("xs"), F.col("r.y").alias("ys"), F.col("r.n").alias("ns"))


def train(df: DataFrame, columns: list[str], label: str, hidden: tuple[int, ...] = (16, 8), width: int | None = None, steps: int = 50, solver: str = "l-bfgs", tolerance: float = 1e-6, pairs: int = 10, seed: int = 42) -> Perceptron:
    """Of rows (item_id, label, the columns). Rows without a label aren't trained on; those without an item train the input of unknown ones. Training ends early when a step lowers the loss by less than that share of it. L-BFGS keeps the last pairs of steps and changes of gradients; gd takes steps of a fixed rate."""
    spark = df.sparkSession
    paths = {name: shared_path(spark, name) for name in ("rows", "blocks")}
    known = df.where(F.col(label).isNotNull()).select(key_of(width).alias("key"), inputs(columns).alias("x"), F.col(label).cast("double").alias("y"))
    known.groupBy("key", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")).write.parquet(paths["rows"])
    rows = spark.read.schema("key string, x array<double>, y double, n double").parquet(paths["rows"])
    if rows.isEmpty():
        delete(spark, paths["rows"])
        raise ValueError("no rows to train on")
    blocks_of(rows).write.parquet(paths["blocks"])
    delete(spark, paths["rows"])
    blocks = spark.read.schema("key string, xs array<double>, ys array<double>, ns array<double>").parquet(paths["blocks"])

    sizes, rng = [len(columns), *hidden, 2], np.random.default_rng(seed)
    dim, quasi = sizes[1], solver == "l-bfgs"
    keys = blocks.select("key").distinct()
    spread = [START / n for n in (len(columns) + (width or keys.count() + 1), *hidden)]
    layers = [(rng.uniform(-c, c, (a, b)), rng.uniform(-c, c, b)) for c, a, b in zip(spread, sizes, sizes[1:])]
    states, sums = Rounds(spark, "weights"), Rounds(spark, "gradients")
    read = lambda state: state.where("key IS NOT NULL")
    state = states.next(keys.select("key", F.transform(new_vector("key", dim, seed), lambda v: v * (spread[0] / 0.05)).alias("w"), F.array_repeat(F.lit(0.0), dim).alias("h")))

    def tried(layers: Layers, share: np.ndarray, a: float) -> tuple[DataFrame, np.ndarray, float]:
        """The gradients after such a step, those of the layers, and the loss."""
        there = read(state).mapInArrow(_at(share, a, dim), _VECTOR)
        got = sums.next(blocks.join(there, "key").mapInArrow(_gradients_of(layers, dim), _SUMS))
        total = _total(got, "g")
        return got.where("key IS NOT NULL").groupBy("key").agg(F.array(*(F.sum(F.col("g")[j]) / total[-1] for j in range(dim))).alias("g")), total[:-2] / total[-1], total[-2] / total[-1]

    def stepped(grads: DataFrame, share: np.ndarray, a: float, first: bool = False) -> DataFrame:
        return states.next(read(state).join(grads, "key").mapInArrow(_stepped(share, a, dim, first, pairs if quasi else 0), _STATE))

    flat, none = _flat(layers), np.zeros(1)
    grads, g, loss = tried(layers, none, 0.0)
    state, own, losses = stepped(grads, none, 0.0, first=True), g[None, None], [loss]
    for _ in range(steps):
        dots = _total(state, "h").reshape(own.shape[1], -1) + own[0] @ own[0].T
        if not dots[-1, -1] > 0:
            break
        share, a = (direction(dots), 1.0) if quasi else (np.array([-1.0]), GD_RATE)
        slope = float(dots[-1] @ share)
        for _ in range(HALVINGS if quasi else 1):
            fresh = _moved(flat[None], own, share, a)[0]
            grads, g, now = tried(_shaped(fresh, layers), share, a)
            if not quasi or now <= loss + LEAST_FALL * a * slope:
                break
            a /= 2
        else:
            break
        state = stepped(grads, share, a)
        own = remembered(own, (fresh - flat)[None], g[None], pairs) if quasi else g[None, None]
        flat, layers, last, loss = fresh, _shaped(fresh, layers), loss, now
        losses.append(loss)
        if abs(last - loss) <= tolerance * max(abs(last), abs(loss)):
            break
    for path in (paths["blocks"], *sums.paths):
        delete(spark, path)
    vectors = read(state).select("key", F.col("w").alias("vector"))
    shared = vectors.where("key = ''").first()
    return Perceptron(layers, vectors, shared["vector"] if shared else [0.0] * dim, list(columns), width, losses)


def scores(model: Perceptron, rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, and score: the chance of label 1."""
    schema = rows.select(*keep).withColumn("score", F.lit(0.0)).schema
    layers, wanted = model.layers, list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("_x").flatten().to_numpy(False).reshape(batch.num_rows, len(layers[0][0]))
                p = forward(layers, x, _matrix(batch.column("_vector"), batch.num_rows))[0][:, 1]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in wanted), pa.array(p)], names=[*wanted, "score"])

    met = rows.select(*keep, key_of(model.width).alias("_key"), inputs(model.columns).alias("_x")).join(model.vectors.withColumnRenamed("key", "_key"), "_key", "left")
    shared = F.array(*(F.lit(float(v)) for v in model.shared))
    return met.select(*keep, "_x", F.coalesce("vector", shared).alias("_vector")).mapInArrow(run, schema)

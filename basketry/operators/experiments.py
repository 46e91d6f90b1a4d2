"""Parameter grids, names of experiments, searches and what they leave behind."""

from __future__ import annotations

import json
import math
import random
import uuid
from collections.abc import Callable, Iterable
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(**values: Iterable) -> list[dict]:
    """Every combination of the values, the last name's changing fastest."""
    return [dict(zip(values, x)) for x in product(*values.values())]


def funnel(first: int, depth: int, least: int = 1) -> list[int]:
    """Sizes of layers, each half of the one before."""
    return [max(least, first >> i) for i in range(depth)]


def uniform(size: int, depth: int) -> list[int]:
    return [size] * depth


def experiment_name(embedding: int, layers: list[int], epochs: int, activation: str, rate: float, number: str, longest: int = 31) -> str:
    """Such as e100_l64-64_ep280_rel_lr0.0001_7, cut to the longest name that a sheet may have."""
    return f"e{embedding}_l{'-'.join(map(str, layers))}_ep{epochs}_{activation[:3]}_lr{rate}_{number}"[:longest]


def search(rows: DataFrame, estimator: Estimator, params: list[dict], share: float = 0.8, seed: int = 42, parallelism: int = 4) -> tuple[Model, DataFrame]:
    """The best model by area under the curve on held-out rows (features, label), and a row (trial, params, auc) for each set of parameters."""
    maps = [{estimator.getParam(k): v for k, v in p.items()} for p in params]
    split = TrainValidationSplit(estimator=estimator, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(), trainRatio=share, seed=seed, parallelism=parallelism)
    fitted = split.fit(rows)
    trials = [(i, {k: str(v) for k, v in p.items()}, float(m)) for i, (p, m) in enumerate(zip(params, fitted.validationMetrics))]
    return fitted.bestModel, rows.sparkSession.createDataFrame(trials, "trial int, params map<string,string>, auc double")


def save_experiment(path: str, model: Model, trials: DataFrame, predictions: DataFrame | None = None) -> None:
    """The model, its trials as JSON and predictions as Parquet, each in a folder of its own below path."""
    model.write().overwrite().save(f"{path}/model")
    trials.write.mode("overwrite").json(f"{path}/trials")
    if predictions is not None:
        predictions.write.mode("overwrite").parquet(f"{path}/predictions")


def errors(scored: DataFrame, score: str, label: str) -> DataFrame:
    """(n, mae, mse, log_loss) of scores against 0/1 labels, in one pass."""
    p, y = F.col(score).cast("double"), F.col(label).cast("double")
    inside = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = -(y * F.log(inside) + (1 - y) * F.log(1 - inside))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(p - y)).alias("mae"), F.avg((p - y) ** 2).alias("mse"), F.avg(loss).alias("log_loss"))


def experiment_folder(base: str, *name, **more) -> str:
    """The folder of an experiment below base, by its name."""
    return f"{base.rstrip('/')}/{experiment_name(*name, **more)}"


#: Trials before proposals follow them, candidates of a proposal, and the share of trials that count as good.
STARTUP, CANDIDATES, GOOD = 10, 48, 0.2


class Study:
    """A search that learns from its trials and goes on where it was stopped.

    The space gives each parameter as ("uniform", least, most), ("log", least, most),
    ("int", least, most) or ("choice", values). Trials are kept in a folder, one for each,
    written under a passing name and renamed when whole; a trial that a broken run has left
    is run again. What is proposed depends on the seed and the trials before alone. After
    some at random, good and other trials are each told by a density of every parameter
    (Parzen's: a bell around each value, and one over the range), and of candidates drawn
    from the good ones' the one is tried that they favour most over the others'. A choice is
    drawn from the good trials', so none is given up for good.
    """

    def __init__(self, spark: SparkSession, folder: str, space: dict[str, tuple], seed: int = 42):
        self.spark, self.folder, self.space, self.seed = spark, folder.rstrip("/"), space, seed

    def trials(self) -> list[dict]:
        """All that are whole: trial, params, value; as many rows as were run."""
        try:
            rows = self.spark.read.schema("trial int, params string, value double").json(f"{self.folder}/trial=*").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted(({"trial": r["trial"], "params": json.loads(r["params"]), "value": r["value"]} for r in rows), key=lambda t: t["trial"])

    def run(self, objective: Callable[[dict], float], trials: int) -> dict:
        """The best trial after that many, those of earlier runs included; the objective is to be large. A value that is no number is the worst."""
        done = self.trials()
        for number in range(len(done), trials):
            params = self.propose(done)
            value = float(objective(params))
            done.append({"trial": number, "params": params, "value": None if math.isnan(value) else value})
            self._keep(done[-1])
        return max(done, key=lambda t: (_value(t), -t["trial"]))

    def _keep(self, trial: dict) -> None:
        row = [(trial["trial"], json.dumps(trial["params"]), trial["value"])]
        self.spark.createDataFrame(row, "trial int, params string, value double").coalesce(1).write.json(draft := f"{self.folder}/_draft-{uuid.uuid4().hex}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        target = path(f"{self.folder}/trial={trial['trial']}")
        if files.exists(target) or not files.rename(path(draft), target):
            raise RuntimeError(f"another run has kept trial {trial['trial']} in {self.folder}")

    def propose(self, done: list[dict]) -> dict:
        rng = random.Random(f"{self.seed} {len(done)}")
        if len(done) < STARTUP:
            return {k: _drawn(rng, s) for k, s in self.space.items()}
        ranked = sorted(done, key=lambda t: (-_value(t), t["trial"]))
        cut = max(1, math.ceil(GOOD * len(ranked)))
        out = {}
        for name, spec in self.space.items():
            good, rest = ([t["params"][name] for t in part] for part in (ranked[:cut], ranked[cut:]))
            drawn = [_near(rng, spec, good) for _ in range(1 if spec[0] == "choice" else CANDIDATES)]
            out[name] = max(drawn, key=lambda x: _density(spec, good, x) - _density(spec, rest, x))  # noqa: B023
        return out


def _value(trial: dict) -> float:
    return -math.inf if trial["value"] is None else trial["value"]


def _scale(spec: tuple, x: float) -> float:
    """A number's place in its range, from 0 to 1."""
    kind, least, most = spec
    return (math.log(x / least) / math.log(most / least) if kind == "log" else (x - least) / (most - least)) if most > least else 0.5


def _unscale(spec: tuple, u: float):
    kind, least, most = spec
    u = min(1.0, max(0.0, u))
    return least * (most / least) ** u if kind == "log" else round(least + u * (most - least)) if kind == "int" else least + u * (most - least)


def _drawn(rng: random.Random, spec: tuple):
    return rng.choice(spec[1]) if spec[0] == "choice" else _unscale(spec, rng.random())


def _width(n: int) -> float:
    return max(0.03, 0.5 * n**-0.7)


def _near(rng: random.Random, spec: tuple, values: list):
    """A draw from the density of values."""
    k = rng.randrange(len(values) + 1)
    if k == len(values):
        return _drawn(rng, spec)
    if spec[0] == "choice":
        return values[k]
    return _unscale(spec, rng.gauss(_scale(spec, values[k]), _width(len(values))))


def _density(spec: tuple, values: list, x) -> float:
    """The logarithm of the density at x."""
    if spec[0] == "choice":
        return math.log((sum(v == x for v in values) + 1) / (len(values) + len(spec[1])))
    w, at = _width(len(values) or 1), _scale(spec, x)
    bells = sum(math.exp(-(((at - _scale(spec, v)) / w) ** 2) / 2) / (w * math.sqrt(2 * math.pi)) for v in values)
    return math.log((bells + 1) / (len(values) + 1))

"""Clustering, splits, and classification with Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators import perceptron
from basketry.storage import Rounds, saved


def reduced(vectors: DataFrame, share: float = 0.95) -> DataFrame:
    """Adds reduced: the fewest principal components that explain the share of variance."""
    n = len(vectors.select("features").first()[0])
    model = PCA(k=n, inputCol="features", outputCol="all").fit(vectors)
    k, total = 0, 0.0
    while k < n and total < share:
        total += model.explainedVariance[k]
        k += 1
    return PCA(k=k, inputCol="features", outputCol="reduced").fit(vectors).transform(vectors)


def clusters(vectors: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    rows = reduced(vectors)
    return KMeans(k=k, seed=seed, featuresCol="reduced").fit(rows).transform(rows)


def standardised(vectors: DataFrame) -> DataFrame:
    """features with mean 0 and deviation 1 in every place."""
    scaler = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True)
    return scaler.fit(vectors).transform(vectors).drop("features").withColumnRenamed("_scaled", "features")


def silhouettes(vectors: DataFrame, ks) -> DataFrame:
    """(k, silhouette) of clusters of the standardised, reduced vectors."""
    rows = reduced(standardised(vectors)).select("reduced").cache()
    evaluator = ClusteringEvaluator(featuresCol="reduced")
    scores = [(k, float(evaluator.evaluate(KMeans(k=k, seed=42, featuresCol="reduced").fit(rows).transform(rows)))) for k in ks]
    rows.unpersist()
    return vectors.sparkSession.createDataFrame(scores, "k int, silhouette double")


def split_by_time(df: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Earlier and later dates, so that no test row is older than a training row."""
    cut = df.agg(F.percentile_approx(F.unix_date("d"), share)).first()[0]
    return df.where(F.unix_date("d") <= cut), df.where(F.unix_date("d") > cut)


def split_at_random(df: DataFrame, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows dealt by chance. Rows of one item and time may fall on both sides; use split_by_time to measure a forecast."""
    first, rest = df.randomSplit([share, 1 - share], seed)
    return first, rest


def split_stratified(df: DataFrame, label: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Of each label's rows about the same share on either side: rows whose hash, dealt evenly, lies below the share's, counted to one row. The same rows every time, whatever the partitions; rows are ranked in bins of hashes that grow in number with each label's rows, so no task gets a label as a whole."""
    hashed = df.withColumn("_hash", F.xxhash64(*df.columns))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(label, "_label")
    # Bins of about 100,000 rows.
    rows = hashed.join(F.broadcast(sizes) if sizes.limit(10_001).count() <= 10_000 else sizes, hashed[label].eqNullSafe(sizes["_label"]))
    rows = rows.withColumn("_bin", F.pmod("_hash", F.floor(F.col("_n") / 100_000) + 1))
    rows = rows.withColumn("_place", F.percent_rank().over(Window.partitionBy(label, "_bin").orderBy("_hash")))
    extra = ("_hash", "_label", "_n", "_bin", "_place")
    return rows.where(F.col("_place") < share).drop(*extra), rows.where(F.col("_place") >= share).drop(*extra)


def with_item_rate(rows: DataFrame, label: str, name: str = "item_rate", weight: float = 10.0) -> DataFrame:
    """Adds how often the label was 1 in the item's rows of earlier days, drawn to the rate of all rows of earlier days (0 on the first) as if that had been seen `weight` times. A row's own day never counts, so nothing of its label leaks into it. Rows are (item_id, d, label, ...); the rates by day are a row for each."""
    hit = F.col(label).cast("double")
    past = Window.partitionBy("item_id").orderBy(F.unix_date("d")).rangeBetween(Window.unboundedPreceding, -1)
    by_day = rows.groupBy("d").agg(F.sum(hit).alias("_hits"), F.count(hit).alias("_seen"))
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    prior = by_day.select("d", F.coalesce(F.try_divide(F.sum("_hits").over(before), F.sum("_seen").over(before)), F.lit(0.0)).alias("_prior"))
    known = rows.select("*", F.coalesce(F.sum(hit).over(past), F.lit(0.0)).alias("_own"), F.count(hit).over(past).alias("_times")).join(prior, "d", "left")
    rate = (F.col("_own") + weight * F.coalesce("_prior", F.lit(0.0))) / (F.col("_times") + weight)
    return known.select(*rows.columns, rate.alias(name))


def fit_each_item(rows: DataFrame, columns: list[str], label: str, steps: int = 20, rate: float = 0.5, decay: float = 0.0) -> DataFrame:
    """(item_id, weights): a logistic regression of its own for every item, the first weight being the constant. All are fitted together: a step joins the rows with their item's weights and sums up gradients by item, before the shuffle too, so a step is one pass over the rows however many items there are. Nulls count as 0."""
    n = len(columns) + 1
    values = F.array(F.lit(1.0), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    slim = saved(rows.where("item_id IS NOT NULL").select("item_id", values.alias("x"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL"), "rows")
    rounds = Rounds(rows.sparkSession, "weights")
    weights = rounds.next(slim.select("item_id").distinct().withColumn("weights", F.array_repeat(F.lit(0.0), n)))
    for _ in range(steps):
        met = slim.join(weights, "item_id").withColumn("_error", score_of("weights", "x") - F.col("y"))
        sums = met.groupBy("item_id").agg(F.array(*(F.avg(F.col("_error") * F.col("x")[j]) for j in range(n))).alias("g"), F.first("weights").alias("weights"))
        weights = rounds.next(sums.select("item_id", F.zip_with("weights", "g", lambda w, g: w - rate * (g + decay * w)).alias("weights")))
    return weights


def score_of(weights: str, values: str) -> Column:
    dot = F.aggregate(F.zip_with(weights, values, lambda w, x: w * x), F.lit(0.0), lambda a, x: a + x)
    return 1 / (1 + F.exp(-dot))


def next_basket(latest: DataFrame, weights: DataFrame, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """Of each item's latest row, the chance by the item's own weights that it is in the next basket: item_id, score, expected, rank."""
    values = F.array(F.lit(1.0), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    scored = latest.withColumn("_x", values).join(weights, "item_id").select("item_id", "d", score_of("weights", "_x").alias("score"))
    return next_trip(scored, threshold)


def boosted_model(rows: DataFrame, trees: int = 10, depth: int = 4, validation: float = 0.0, patience: float = 0.01, seed: int = 42):
    """Boosted trees of (features, label). With validation, that share of rows isn't trained on, and training ends early when the loss on them no longer falls by `patience`."""
    trainer = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, validationTol=patience)
    if not validation:
        return trainer.fit(rows)
    held = F.pmod(F.xxhash64("features", "label"), F.lit(1000)) < round(1000 * validation)
    return trainer.setParams(validationIndicatorCol="_validation").fit(rows.withColumn("_validation", held))


def boosted_scores(df: DataFrame, columns: list[str], label: str, trees: int = 10, validation: float = 0.1) -> DataFrame:
    """Scores of all rows by trees over the columns and the item's rate so far (its number has no order to split by), trained on the earlier dates, ended early by the loss on a part of them."""
    rows = VectorAssembler(inputCols=[*columns, "item_rate"], outputCol="features").transform(with_item_rate(df, label)).withColumn("label", F.col(label).cast("double"))
    train, _ = split_by_time(rows)
    model = boosted_model(train.select("features", "label"), trees, validation=validation)
    return model.transform(rows).select("item_id", "d", label, vector_to_array("probability")[1].alias("score"))


def auc(scored: DataFrame, label: str, metric: str = "areaUnderROC") -> float:
    """The area under the curve; metric areaUnderPR for the curve of precision by recall."""
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol=label, metricName=metric).evaluate(scored.withColumn(label, F.col(label).cast("double")))


SOLVERS = ("l-bfgs", "gd")


def perceptron_scores(df: DataFrame, columns: list[str], label: str, layers: tuple[int, ...] = (16, 8), width: int | None = None, steps: int = 50, solver: str = "l-bfgs") -> DataFrame:
    """Scores by a perceptron over the columns and the item. Every item has an input of its own, so the first layer's weights are its embedding; items not trained on share one. With width, items are hashed to so many inputs instead, which bounds the model but lets items collide."""
    if solver not in SOLVERS:
        raise ValueError(f"solver must be one of {SOLVERS}, not {solver!r}")
    train, _ = split_by_time(df)
    return perceptron.scores(perceptron.train(train, columns, label, layers, width or None, steps, solver), df, ["item_id", "d", label])


def gain_importance(df: DataFrame, columns: list[str], label: str, trees: int = 5) -> DataFrame:
    """(feature, importance) of boosted trees."""
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(df).withColumn("label", F.col(label).cast("double"))
    found = GBTClassifier(maxIter=trees, maxDepth=4, seed=42).fit(rows).featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(columns, map(float, found))), "feature string, importance double")


def next_trip(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of (item_id, d, score): each item's latest score, whether it is expected on the next trip, and its rank among all; items of one score share a rank."""
    last = scored.groupBy("item_id").agg(F.max_by("score", "d").alias("score"))
    # Ranks by the number of items with each score: a row per item isn't brought to one task, but one per score.
    better = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    ranks = last.groupBy("score").agg(F.count(F.lit(1)).alias("n")).select("score", better.alias("rank"))
    return last.join(ranks, "score").select("item_id", "score", (F.col("score") >= threshold).alias("expected"), "rank")

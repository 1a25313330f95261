"""Models and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from tidemark.operators import windows as W
from tidemark.operators.rollups import error_metrics
from tidemark.operators.storage import checkpoint, small, written


def regressor(features: Sequence[str], label: str, kind: str = "boosted", trees: int = 20, depth: int = 5, seed: int = 7) -> Pipeline:
    """Boosted trees, or a forest. Trees are fitted over partitions; nothing is collected."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    options = {"featuresCol": "features", "labelCol": label, "maxDepth": depth, "seed": seed}
    model = GBTRegressor(maxIter=trees, **options) if kind == "boosted" else RandomForestRegressor(numTrees=trees, **options)
    return Pipeline(stages=[assemble, model])


#: Rows that a task of a fit goes over, at most on average.
FIT_ROWS = 1_000_000


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows for a fit, in as many equal parts as cores or a multiple, since all cores wait for the slowest part at each level of
    each tree. Parts and their order follow from the rows alone, so a fit is the same however the rows lay in files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    order = [*keys, *[c for c in df.columns if c not in keys]]
    return df.repartition(cores * max(1, -(-df.count() // (cores * FIT_ROWS))), *order).sortWithinPartitions(*order)


def train_regressor(df: DataFrame, features: Sequence[str], label: str, entity: str, ts: str, share: float = 0.8, **options) -> tuple[PipelineModel, DataFrame]:
    """Fit on the earlier part of each entity, predict the later part; (model, predictions of the later part)."""
    split = W.temporal_split(written(df, "features"), entity, ts, share)  # features are worked out once
    assemble, learner = regressor(features, label, **options).getStages()
    train = dealt(split.where("is_train").select(*dict.fromkeys([ts, entity, label, *features])), [ts, entity])
    ready = assemble.transform(train).select(label, "features").persist(StorageLevel.DISK_ONLY)  # read three times before the fit keeps its own form
    try:
        model = PipelineModel([assemble, learner.fit(ready)])
    finally:
        ready.unpersist()
    return model, model.transform(split.where("NOT is_train"))


def regression_scores(predictions: DataFrame, label: str) -> dict[str, float]:
    return {m: RegressionEvaluator(labelCol=label, metricName=m).evaluate(predictions) for m in ("mae", "rmse", "r2")}


#: Hex digits of a hash range, and so 4,096 ranges for each label.
RANGE_DIGITS = 3


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], share: float = 0.8, seed: int = 7) -> DataFrame:
    """``is_train`` for the first ``share`` of each label's rows (to the nearest row) in the order of a hash of their keys.

    The split depends on keys, label and seed alone, not on how the rows lie in partitions. Rows are counted by ranges of the
    hash; only in the range where a label's share ends are they put in order. Rows with the same keys may stand
    on either side of that end, as any of them may. A null label is a label.
    """
    text = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    rows = df.withColumn("_hash", F.md5(F.concat_ws(":", *text, F.lit(str(seed))).cast("binary"))).withColumn("_range", F.substring("_hash", 1, RANGE_DIGITS))
    counts = rows.groupBy(F.col(label).alias("_label"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy("_label")
    upto = F.sum("_n").over(over.orderBy("_r"))
    cut = F.floor(F.sum("_n").over(over) * F.lit(share) + 0.5).cast("bigint")
    ends = counts.select("_label", "_r", F.greatest(F.lit(0), F.least("_n", cut - upto + F.col("_n"))).alias("_take"), "_n")  # of a range: how many train
    placed = rows.join(small(written(ends, "ranges")), rows[label].eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_r")))
    whole = (F.col("_take") == 0) | (F.col("_take") == F.col("_n"))
    order = Window.partitionBy("_label", "_range").orderBy("_hash", *keys)
    clear = placed.where(whole).withColumn("is_train", F.col("_take") > 0)
    split = placed.where(~whole).withColumn("is_train", F.row_number().over(order) <= F.col("_take"))
    return clear.unionByName(split).drop("_hash", "_range", "_label", "_r", "_take", "_n")


def train_classifier(df: DataFrame, features: Sequence[str], label: str, entity: str, ts: str, share: float = 0.8, stratified: bool = False, trees: int = 15, depth: int = 4, seed: int = 7, keys: Sequence[str] = ()) -> tuple[PipelineModel, DataFrame]:
    """Medians for missing values, classes weighted to equal sums, temporal or stratified split (by ``keys``, or entity and time)."""
    if stratified:
        split = checkpoint(stratified_split(df, label, keys or [entity, ts], share, seed))
    else:
        split = W.temporal_split(written(df, "features"), entity, ts, share)
    train = split.where("is_train")
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
    filled = [f"{f}_filled" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="skip"),
        GBTClassifier(featuresCol="features", labelCol=label, weightCol="_weight", maxIter=trees, maxDepth=depth, seed=seed),
    ]
    model = Pipeline(stages=stages).fit(train.withColumn("_weight", weight))
    return model, model.transform(split.where("NOT is_train").withColumn("_weight", F.lit(1.0)))


def classification_scores(predictions: DataFrame, label: str) -> dict[str, float]:
    """ROC area, precision and recall."""
    area = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC").evaluate(predictions)
    hits = predictions.agg(F.count(F.when((F.col("prediction") == 1) & (F.col(label) == 1), 1)), F.count(F.when(F.col("prediction") == 1, 1)), F.count(F.when(F.col(label) == 1, 1))).first()
    return {"auc": area, "precision": hits[0] / max(hits[1], 1), "recall": hits[0] / max(hits[2], 1)}


def score(df: DataFrame, model: PipelineModel, keys: Sequence[str], actual: str, suffix: str, version: int) -> DataFrame:
    """A prediction table; an empty input gives an empty table of the same columns."""
    p = model.transform(df)
    return p.select(*keys, F.col(actual).alias(f"actual_{suffix}"), F.col("prediction").alias(f"predicted_{suffix}"), (F.col("prediction") - F.col(actual)).alias(f"forecast_error_{suffix}"), F.lit(version).cast("int").alias("model_version"), F.current_timestamp().alias("scored_at"))


def leaderboard(scores: Mapping[str, DataFrame], predicted: str, actual: str) -> DataFrame:
    """Candidates by mean absolute error; each is one row by the time they meet."""
    rows = [error_metrics(df, predicted, actual).withColumn("model", F.lit(name)) for name, df in scores.items()]
    out = rows[0]
    for one in rows[1:]:
        out = out.unionByName(one)
    return out.orderBy("mae", "model")


@dataclass(frozen=True)
class Candidate:
    """A way to predict. Either a column that is the prediction, or the mean of the label by ``keys`` over the training
    rows (the mean of all of them where a key is new), or a regressor over ``features`` with ``options`` of ``regressor``."""

    column: str | None = None
    keys: Sequence[str] = ()
    features: Sequence[str] = ()
    options: Mapping[str, object] = field(default_factory=dict)

    def predict(self, train: DataFrame, test: DataFrame, label: str) -> DataFrame:
        if self.column:
            return test.withColumn("prediction", F.col(self.column).cast("double"))
        if self.features:
            return regressor(self.features, label, **self.options).fit(train).transform(test)
        overall = train.agg(F.avg(label)).first()[0]
        means = train.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).agg(F.avg(label).alias("_mean"))
        met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)])
        return test.join(means, met, "left").withColumn("prediction", F.coalesce("_mean", F.lit(overall)))


def rolling_origins(df: DataFrame, ts: str, folds: int) -> list[int]:
    """``folds`` + 1 points in time, in microseconds, that cut the time from the first row to the last into equal parts; a fold
    trains on what lies before its point and is tested on what lies from there to the next one."""
    low, high = df.agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))), F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()
    return [] if low is None else [low + (high + 1 - low) * i // (folds + 1) for i in range(1, folds + 2)]


#: Rows of a search of which fits side by side keep their parts in memory. A boosted fit keeps some 200 bytes for each row it
#: trains on, and works out anew what no longer fits, round upon round.
ROWS_AT_ONCE = 24_000_000


def side_by_side(rows: int, at_once: int) -> int:
    """How many fits run at once: fewer the more rows there are, as one fit of many rows keeps all machines busy by itself."""
    return max(1, min(at_once, ROWS_AT_ONCE // max(rows, 1)))


def search(df: DataFrame, candidates: Mapping[str, Candidate], label: str, ts: str, folds: int = 3, at_once: int = 4) -> DataFrame:
    """Errors of each candidate in each fold (model, fold, mae, rmse, mape, bias, n).

    The assembly is written once and read by all fits, ``at_once`` of which run side by side, or fewer where rows are many. Rows without a label or
    time take no part. A fold in which there is nothing to train on, or nothing to test, has no row.
    """
    rows = written(df.where(F.col(label).isNotNull() & F.col(ts).isNotNull()), "search")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = rolling_origins(rows, ts, folds)

    def one(job: tuple[int, str]) -> list[tuple]:
        i, name = job
        train, test = rows.where(at < ends[i]), rows.where((at >= ends[i]) & (at < ends[i + 1]))
        if train.isEmpty() or test.isEmpty():
            return []
        found = error_metrics(candidates[name].predict(train, test, label), "prediction", label).first()
        return [(name, i + 1, found["mae"], found["rmse"], found["mape"], found["bias"], found["n"])]

    with ThreadPool(side_by_side(rows.count(), at_once)) as pool:
        found = pool.map(inheritable_thread_target(df.sparkSession)(one), [(i, name) for i in range(len(ends) - 1) for name in candidates], chunksize=1)
    return df.sparkSession.createDataFrame([r for part in found for r in part], "model string, fold int, mae double, rmse double, mape double, bias double, n bigint")


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Features by importance, most important first."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, weights, strict=True), key=lambda x: (-x[1], x[0]))


def against_published(df: DataFrame, model: str, published: str, actual: str) -> DataFrame:
    """Errors of the model and of the published forecast side by side."""
    e, p = F.abs(F.col(model) - F.col(actual)), F.abs(F.col(published) - F.col(actual))
    return df.agg(F.avg(e).alias("model_mae"), F.avg(p).alias("published_mae"), ((F.avg(p) - F.avg(e)) / F.avg(p) * 100).alias("improvement_pct"), F.count(F.when(e < p, 1)).alias("n_better"), F.count(F.lit(1)).alias("n"))

"""Models of segments with Spark ML: cross-validated boosted trees, calibrated boom classifiers, importances.

A model of a segment and fold is a fit of its own. The rows are written once, in parts by segment and fold, so that a fit reads
its own parts only, and AT_ONCE fits run side by side, each in a scheduler pool of its own (which share the executors evenly where the
session's spark.scheduler.mode is FAIR). The data stay on the executors; the driver holds the counts of the parts.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any, NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import checkpoints_on, cut, scratch_folder
from ..functions.stats import existing
from .metrics import average_precision, mae_r2, roc_auc

#: Fits that run at once: a fit is many short jobs, between which it waits for the driver.
AT_ONCE = 8
#: Rows of a task of a regression's fit. A tree is some ten stages, so that small fits cost what their tasks cost to start.
TASK_ROWS = 100_000


def assembler(features: list[str]) -> list:
    """Median imputation and a feature vector. Fitted on training rows only."""
    filled = [f"{f}__filled" for f in features]
    return [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features")]


def regressor(trees: int = 300, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=3, seed=seed)


def classifier(trees: int = 200, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, minInstancesPerNode=5, seed=seed)


class _Parts(NamedTuple):
    """Rows written by segment ("all" where none is named; an empty one reads as null) and fold, and (rows, positives) of each part: a handful."""

    rows: DataFrame
    counts: dict[tuple[Any, Any], tuple[int, int]]

    def folds(self) -> list[tuple[Any, Any]]:
        """(segment, fold) of segments with another fold to learn from."""
        return sorted(((s, f) for s, f in self.counts if any(t == s and g != f for t, g in self.counts)), key=str)

    def train(self, segment: Any, fold: Any) -> DataFrame:
        return self._of(segment).where(~F.col("__fold").eqNullSafe(F.lit(fold)))

    def gathered(self, segment: Any, fold: Any) -> DataFrame:
        """The training rows in as few tasks as TASK_ROWS allows."""
        rows = sum(n for (s, f), (n, _) in self.counts.items() if s == segment and f != fold)
        return self.train(segment, fold).coalesce(1 + rows // TASK_ROWS)

    def test(self, segment: Any, fold: Any) -> DataFrame:
        return self._of(segment).where(F.col("__fold").eqNullSafe(F.lit(fold)))

    def _of(self, segment: Any) -> DataFrame:
        return self.rows.where(F.col("__segment").eqNullSafe(F.lit(segment)))

    def positives(self, segment: Any, fold: Any) -> tuple[int, int]:
        """In the fold, and in the segment's other folds."""
        return self.counts[segment, fold][1], sum(n for (s, f), (_, n) in self.counts.items() if s == segment and f != fold)


def _parted(rows: DataFrame, *, label: str, fold: str, segment: str | None) -> _Parts:
    """The rows with a label, and a segment and fold, as ``label`` in double precision. Parts of very different sizes are written
    in files of like size."""
    named = F.lit("all") if segment is None else F.col(segment).cast("string")
    used = rows.where(F.col(label).isNotNull()).withColumns({"label": F.col(label).cast("double"), "__segment": named, "__fold": F.col(fold).cast("string")})
    used = used.where(F.col("__segment").isNotNull() & F.col("__fold").isNotNull())
    checkpoints_on(rows.sparkSession)  # boosting adds to its lineage with every tree
    folder = scratch_folder(rows.sparkSession, "parts")
    used.hint("rebalance", "__segment", "__fold").write.partitionBy("__segment", "__fold").parquet(folder)
    kept = rows.sparkSession.read.schema(used.schema).parquet(folder).select(used.columns)
    counts = kept.groupBy("__segment", "__fold").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("pos")).collect()
    return _Parts(kept, {(r["__segment"], r["__fold"]): (r["n"], r["pos"]) for r in counts})


def _at_once(spark: SparkSession, tasks: list[Callable[[], Any]]) -> list[Any]:
    """What the tasks give, in their order; AT_ONCE of them run at a time."""

    def in_pool(k: int, task: Callable[[], Any]) -> Any:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{k % AT_ONCE}")
        return task()

    with ThreadPoolExecutor(AT_ONCE) as pool:
        started = [pool.submit(inheritable_thread_target(lambda k=k, task=task: in_pool(k, task))) for k, task in enumerate(tasks)]
        return [s.result() for s in started]


def cv_predictions(rows: DataFrame, *, features: list[str], target: str, fold: str, segment: str | None = None, trees: int = 300) -> DataFrame:
    """All rows with prediction (0 at least), each by a model of its segment that did not see its fold (the row's own season).
    Rows without a target, segment or fold are left out, and so is a segment with one fold only."""
    features = existing(rows, features)
    parts = _parted(rows, label=target, fold=fold, segment=segment)
    fits = [lambda s=s, f=f: Pipeline(stages=[*assembler(features), regressor(trees)]).fit(parts.gathered(s, f)) for s, f in parts.folds()]
    scored = [model.transform(parts.test(s, f)) for (s, f), model in zip(parts.folds(), _at_once(rows.sparkSession, fits), strict=True)]
    none = rows.limit(0).withColumn("prediction", F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, [x.select(*rows.columns, F.greatest("prediction", F.lit(0.0)).alias("prediction")) for x in scored], none)


def cv_metrics(predicted: DataFrame, *, target: str, fold: str) -> DataFrame:
    """Mean absolute error and R2 of each fold, and of all under fold null. Predictions are made once and written, since both read them."""
    predicted = cut(predicted.select(target, "prediction", fold))
    every = mae_r2(predicted, actual=target, predicted="prediction").withColumn(fold, F.lit(None).cast(predicted.schema[fold].dataType))
    return mae_r2(predicted, actual=target, predicted="prediction", within=[fold]).unionByName(every)


def _weighted(train: DataFrame) -> DataFrame:
    """Weight of positives: negatives / positives."""
    n = train.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).first()
    return train.withColumn("weight", F.when(F.col("label") == 1, float(n["neg"]) / max(1, n["pos"])).otherwise(1.0))


def _raw(model, rows: DataFrame, features: list[str]) -> DataFrame:
    """The rows with raw, the classifier's own probability."""
    made = model.transform(rows.drop("features", "rawPrediction", "probability", "prediction", *[f"{f}__filled" for f in features]).withColumn("weight", F.lit(1.0)))
    return made.withColumn("raw", vector_to_array("probability")[1])


def boom_predictions(rows: DataFrame, *, features: list[str], label: str, fold: str, segment: str | None = None, trees: int = 200, least_positives: int = 5, calibration_folds: int = 3) -> DataFrame:
    """All rows of a segment's folds with enough positives, with prob: mean of ``calibration_folds`` classifiers of the
    segment, each calibrated by isotonic regression on the part of the training rows that it did not see."""
    features = existing(rows, features)
    parts = _parted(rows.withColumn("part", F.pmod(F.xxhash64(*features, fold), F.lit(calibration_folds))), label=label, fold=fold, segment=segment)
    wanted = [x for x in parts.folds() if min(parts.positives(*x)) >= least_positives]

    def fit(s: Any, f: Any, k: int) -> tuple:
        train = parts.train(s, f)
        model = Pipeline(stages=[*assembler(features), classifier(trees)]).fit(_weighted(train.where(F.col("part") != k)))
        calibrated = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="iso")
        return model, calibrated.fit(_raw(model, train.where(F.col("part") == k), features))

    fits = _at_once(rows.sparkSession, [lambda s=s, f=f, k=k: fit(s, f, k) for s, f in wanted for k in range(calibration_folds)])
    out = rows.limit(0).withColumn("prob", F.lit(None).cast("double"))
    for at, (s, f) in enumerate(wanted):
        scored = parts.test(s, f)
        for k, (model, iso) in enumerate(fits[at * calibration_folds : (at + 1) * calibration_folds]):
            kept = scored.columns
            scored = iso.transform(_raw(model, scored, features)).select(*kept, F.col("iso").alias(f"prob_{k}"))
        mean = sum((F.col(f"prob_{k}") for k in range(1, calibration_folds)), F.col("prob_0")) / calibration_folds
        out = out.unionByName(scored.select(*rows.columns, F.round(mean, 3).alias("prob")))
    return out


def boom_metrics(predicted: DataFrame, *, label: str, fold: str) -> DataFrame:
    """ROC AUC and average precision of each fold."""
    auc = roc_auc(predicted, label=label, score="prob", within=[fold]).select(fold, "positives", "negatives", "auc")
    return auc.join(average_precision(predicted, label=label, score="prob", within=[fold]).select(fold, "average_precision"), fold)


def back_test(rows: DataFrame, *, features: list[str], label: str, fold: str, year: int, segment: str | None = None, trees: int = 200) -> DataFrame:
    """Rows of one season with prob, by a classifier of their segment fitted on the other seasons only; segments that have no
    other season are left out."""
    features = existing(rows, features)
    parts = _parted(rows, label=label, fold=fold, segment=segment)
    wanted = [(s, f) for s, f in parts.folds() if f == str(year)]
    fits = _at_once(rows.sparkSession, [lambda s=s, f=f: Pipeline(stages=[*assembler(features), classifier(trees)]).fit(_weighted(parts.train(s, f))) for s, f in wanted])
    scored = [_raw(model, parts.test(s, f), features) for (s, f), model in zip(wanted, fits, strict=True)]
    none = rows.limit(0).withColumn("prob", F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, [x.select(*rows.columns, F.round("raw", 3).alias("prob")) for x in scored], none)


def importances(rows: DataFrame, *, features: list[str], target: str, segment: str | None = None, trees: int = 300, digits: int = 4) -> DataFrame:
    """segment, feature, importance of a regression on all rows, by segment where one is named."""
    features = existing(rows, features)
    parts = _parted(rows.withColumn("__all", F.lit(0)), label=target, fold="__all", segment=segment)
    named = sorted((s for s, _ in parts.counts), key=str)
    models = _at_once(rows.sparkSession, [lambda s=s: Pipeline(stages=[*assembler(features), regressor(trees)]).fit(parts.test(s, "0").coalesce(1 + parts.counts[s, "0"][0] // TASK_ROWS)) for s in named])
    found = [(None if segment is None else s, f, round(float(x), digits)) for s, model in zip(named, models, strict=True) for f, x in zip(features, model.stages[-1].featureImportances.toArray(), strict=True)]
    return rows.sparkSession.createDataFrame(found, "segment string, feature string, importance double")

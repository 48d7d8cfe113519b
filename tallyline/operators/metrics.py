"""Figures of merit of predictions, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import prefixed
from ..functions.stats import measure, safe_div, squared_deviations


def mae_r2(rows: DataFrame, *, actual: str, predicted: str, within: list[str] | None = None) -> DataFrame:
    """Mean absolute error and R2 by group; R2 is null where all actual values are equal."""
    keys = within or []
    used = rows.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    error = measure(actual) - measure(predicted)
    sums = used.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.abs(error)).cast("double").alias("abs_sum"), F.sum(error * error).cast("double").alias("sse"), squared_deviations(actual).alias("spread"))
    return sums.select(*keys, "n", (F.col("abs_sum") / F.col("n")).alias("mae"), (1 - safe_div("sse", "spread")).alias("r2"))


def _by_score(rows: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    """Positives and negatives by distinct score: what the curves need, and no more."""
    used = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return used.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def roc_auc(rows: DataFrame, *, label: str, score: str, within: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve (ties count half) by group; null without both classes. Runs over distinct scores, whose
    negatives below are added up by ranges."""
    keys = within or []
    steps = prefixed(_by_score(rows, label, score, keys), within=keys, order=["score"], sums={"below": "neg"})
    wins = F.sum(F.col("pos") * (2 * F.col("below") + F.col("neg")))
    return steps.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), safe_div(wins, 2 * F.sum("pos") * F.sum("neg")).alias("auc"))


def average_precision(rows: DataFrame, *, label: str, score: str, within: list[str] | None = None) -> DataFrame:
    """Step sum of precision over recall steps by group; null without positives. Runs over distinct scores, as ``roc_auc``."""
    keys = within or []
    steps = prefixed(_by_score(rows, label, score, keys), within=keys, order=[F.col("score").desc()], sums={"tp": "pos", "fp": "neg"})
    tp = F.col("tp") + F.col("pos")
    part = F.round(F.col("pos") * tp / (tp + F.col("fp") + F.col("neg")), 9).cast("decimal(28,9)")
    return steps.groupBy(*keys).agg(F.sum("pos").alias("positives"), safe_div(F.sum(part), F.sum("pos")).alias("average_precision"))

"""Queries of models and of their figures of merit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, metrics, models, seasons
from .base import events, orders, query, table
from .season_queries import rolled

FEATURES = ["n", "value_sum", "value_mean", "value_std", "value_max"]
TREES, BOOM_TREES = 300, 200  # of the queries' models, as the operators' own defaults


@query("""SELECT count(*) AS n, CAST(sum(abs(CAST(n_chars AS DECIMAL(18,4)) - CAST(length(text) AS DECIMAL(18,4)))) AS DOUBLE) / count(*) AS mae, CAST(1 AS DOUBLE) AS r2 FROM documents""")
def mae_r2_lengths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("n_chars").alias("actual"), F.length("text").alias("predicted"))
    return metrics.mae_r2(docs, actual="actual", predicted="predicted")


@query("""WITH x AS (SELECT c_mktsegment AS segment, CAST(c_acctbal AS DECIMAL(18,4)) AS y, CAST(c_nationkey * 400 AS DECIMAL(18,4)) AS p FROM customer),
    s AS (SELECT segment, count(*) AS n, CAST(sum(abs(y - p)) AS DOUBLE) AS a, CAST(sum(CAST(y - p AS DECIMAL(19,4)) * CAST(y - p AS DECIMAL(19,4))) AS DOUBLE) AS sse, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(CAST(y AS DECIMAL(19,4)) * CAST(y AS DECIMAL(19,4))) AS DOUBLE) AS syy FROM x GROUP BY segment)
    SELECT segment, n, a / n AS mae, 1 - sse / nullif(syy - sy * sy / n, 0) AS r2 FROM s""")
def mae_r2(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("actual"), (F.col("c_nationkey") * 400).alias("predicted"))
    return metrics.mae_r2(rows, actual="actual", predicted="predicted", within=["segment"])


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


SCORED = """d AS (SELECT lang, n_chars AS score, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {SCORED}, s AS (SELECT *, sum(neg) OVER (PARTITION BY lang ORDER BY score) - neg AS below FROM d)
    SELECT lang, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives, CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / nullif(CAST(2 * sum(pos) * sum(neg) AS DOUBLE), 0) AS auc FROM s GROUP BY lang""")
def auc(spark, sf_dir):
    return metrics.roc_auc(_scored(spark, sf_dir), label="quality", score="n_chars", within=["lang"])


@query(f"""WITH {SCORED}, s AS (SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS seen FROM d WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
    SELECT lang, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(CAST(round(pos * tp / CAST(seen AS DOUBLE), 9) AS DECIMAL(28,9))) AS DOUBLE) / nullif(CAST(sum(pos) AS DOUBLE), 0) AS average_precision FROM s GROUP BY lang""")
def avg_precision(spark, sf_dir):
    return metrics.average_precision(_scored(spark, sf_dir), label="quality", score="n_chars", within=["lang"])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasons.yoy_pairs(rolled(spark, sf_dir), entity=["entity"], season="season", games="n", target="value_sum", least_games=2, short_games=3, season_games=4)


def _segment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the segment in which a customer has most orders of the season."""
    segment = seasons.primary_category(orders(spark, sf_dir), keys=["entity", "season"], category="segment").drop("n_rows")
    pairs = _pairs(spark, sf_dir).select("entity", "season", *FEATURES, "adjusted_target")  # medians hold every value of a key
    return pairs.join(segment, ["entity", "season"])


@query()
def gbt_cv(spark, sf_dir):
    """Mean absolute error and R2 by left-out season, of a model for each segment and season."""
    predicted = models.cv_predictions(_segment_pairs(spark, sf_dir), features=FEATURES, target="adjusted_target", fold="season", segment="segment", trees=TREES)
    return models.cv_metrics(predicted, target="adjusted_target", fold="season")


@query()
def feature_importance(spark, sf_dir):
    return models.importances(_segment_pairs(spark, sf_dir), features=FEATURES, target="adjusted_target", segment="segment", trees=TREES)


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.lagged(events(spark, sf_dir), keys=["entity", "position"], order=["ts", "event_id"], measures=["points"])
    rows = features.labelled(rows, segment="position", measure="points", thresholds={"click": 20.0, "view": 20.0, "purchase": 20.0, "error": 20.0, "signup": 20.0}, week="week")
    return rows.withColumn("fold", (F.col("week") % 3).cast("int"))


LAGGED = ["points_roll", "points_roll_std", "points_past", "points_past_std"]


@query()
def boom_calibrated(spark, sf_dir):
    """ROC AUC and average precision by left-out fold of calibrated probabilities, of models of each position."""
    predicted = models.boom_predictions(_weekly(spark, sf_dir), features=LAGGED, label="boom", fold="fold", segment="position", trees=BOOM_TREES)
    return models.boom_metrics(predicted, label="boom", fold="fold")


@query()
def boom_back_test(spark, sf_dir):
    """Probabilities of one fold by a model of the others for each position, summed up by entity."""
    scored = models.back_test(_weekly(spark, sf_dir), features=LAGGED, label="boom", fold="fold", year=0, segment="position", trees=BOOM_TREES)
    return features.boom_summary(scored, keys=["entity"], probability="prob", actual="boom", points="points")

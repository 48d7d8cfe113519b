import inspect

import pytest

from tallyline.operators import models
from tallyline.plans import model_queries

SF = "/root/testdata/sf0.001"


def test_gbt_cv_holds_out_every_season(spark, monkeypatch):
    monkeypatch.setattr(model_queries, "TREES", 1)
    target = model_queries._pairs(spark, SF).where("adjusted_target IS NOT NULL")
    want = {r["season"] for r in target.select("season").distinct().collect()}
    assert {r["season"] for r in model_queries.gbt_cv(spark, SF).collect()} == want | {None} and min(want) < 1998


def test_model_rows_hold_what_the_models_read(spark):
    rows = model_queries._segment_pairs(spark, SF)
    assert rows.columns == ["entity", "season", *model_queries.FEATURES, "adjusted_target", "segment"]
    assert "percentile" not in rows._jdf.queryExecution().executedPlan().toString()


def test_metrics_of_folds_make_the_predictions_once(spark):
    met = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    rows = spark.range(60).selectExpr("CAST(id % 3 AS INT) AS season", "CAST(id AS DOUBLE) AS target", "CAST(id + 1 AS DOUBLE) AS prediction")
    got = models.cv_metrics(rows.mapInArrow(seen, rows.schema), target="target", fold="season").collect()
    assert {(r["season"], r["n"], r["mae"]) for r in got} == {(0, 20, 1.0), (1, 20, 1.0), (2, 20, 1.0), (None, 60, 1.0)} and met.value == 60


@pytest.mark.parametrize(("query", "operator"), [("gbt_cv", "cv_predictions"), ("feature_importance", "importances"), ("boom_calibrated", "boom_predictions"), ("boom_back_test", "back_test")])
def test_queries_fit_as_many_trees_as_their_operators(spark, monkeypatch, query, operator):
    class Met(Exception):
        pass

    def asked(*_, **given):
        raise Met(given["trees"])

    whole = inspect.signature(getattr(models, operator)).parameters["trees"].default
    monkeypatch.setattr(models, operator, asked)
    with pytest.raises(Met) as met:
        getattr(model_queries, query)(spark, SF)
    assert met.value.args == (whole,) and whole >= 200


def test_small_fits_are_one_task_and_boosting_is_checkpointed(spark, monkeypatch):
    rows = spark.range(400, numPartitions=8).selectExpr("CAST(id % 4 AS INT) AS fold", "CAST(id AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS y")
    parts = models._parted(rows, label="y", fold="fold", segment=None)
    assert parts.gathered("all", "1").rdd.getNumPartitions() == 1 and parts.gathered("all", "1").count() == 300
    monkeypatch.setattr(models, "TASK_ROWS", 100)
    assert parts.gathered("all", "1").rdd.getNumPartitions() > 1 and spark.sparkContext.getCheckpointDir() is not None

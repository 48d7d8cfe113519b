"""Models on tables whose answer is known: segments apart, folds held out, calibrated probabilities, leakage."""

import random

import pytest
from pyspark.sql import functions as F

from tallyline.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    """Segment a: the target is 10 x, segment b: 100 - 10 x; a season of its own offset that only leakage could tell."""
    rng, out = random.Random(1), []
    for k in range(240):
        x, segment, season = rng.uniform(0, 5), "ab"[k % 2], 2020 + k % 3
        out.append((segment, season, x, None if k % 7 == 0 else rng.random(), 10 * x if segment == "a" else 100 - 10 * x))
    return spark.createDataFrame(out, "segment string, season int, x double, noise double, target double").cache()


def test_segments_have_their_own_models(spark, rows):
    apart = models.cv_predictions(rows, features=["x", "noise", "absent"], target="target", fold="season", segment="segment", trees=40)
    assert apart.count() == 240 and apart.columns == [*rows.columns, "prediction"]
    error = apart.groupBy("segment").agg(F.avg(F.abs(F.col("prediction") - F.col("target"))).alias("e")).collect()
    together = models.cv_predictions(rows, features=["noise"], target="target", fold="season", trees=3).agg(F.avg(F.abs(F.col("prediction") - F.col("target")))).first()[0]
    assert len(error) == 2 and all(r["e"] < 8 for r in error) and together > 15
    measured = models.cv_metrics(apart, target="target", fold="season").collect()
    assert {r["season"] for r in measured} == {2020, 2021, 2022, None} and all(r["r2"] > 0.8 for r in measured)


def test_a_fold_is_not_seen_by_its_own_model(spark):
    """Within a season the target is a constant that no other season has: only a model that saw it could hit it."""
    df = spark.createDataFrame([(2020 + s, float(s), 1000.0 * s + 1) for s in range(3) for _ in range(12)], "season int, x double, target double")
    got = models.cv_predictions(df, features=["x"], target="target", fold="season", trees=5)
    assert got.where(F.abs(F.col("prediction") - F.col("target")) < 500).count() == 0


def test_calibrated_probabilities_by_segment(spark):
    rng, out = random.Random(3), []
    for k in range(600):
        x, segment = rng.random(), "ab"[k % 2]
        out.append((segment, k % 3, x, None if k % 11 == 0 else rng.random(), int(rng.random() < (x if segment == "a" else 1 - x))))
    df = spark.createDataFrame(out, "segment string, fold int, x double, y double, label int")
    got = models.boom_predictions(df, features=["x", "y"], label="label", fold="fold", segment="segment", trees=5)
    assert got.count() == 600
    by = {r["segment"]: r for r in got.groupBy("segment").agg(F.corr("prob", "x").alias("c"), F.avg("prob").alias("p"), F.avg("label").alias("l"), F.min("prob").alias("low"), F.max("prob").alias("high")).collect()}
    assert by["a"]["c"] > 0.6 and by["b"]["c"] < -0.6
    assert all(abs(r["p"] - r["l"]) < 0.08 and 0 <= r["low"] <= r["high"] <= 1 for r in by.values())
    assert all(r["auc"] > 0.7 for r in models.boom_metrics(got.where("segment = 'a'"), label="label", fold="fold").collect())
    rare = df.withColumn("label", F.when(F.col("fold") == 0, 0).otherwise(F.col("label")))
    assert {r["fold"] for r in models.boom_predictions(rare, features=["x"], label="label", fold="fold", trees=2).select("fold").distinct().collect()} == {1, 2}
    back = models.back_test(df, features=["x"], label="label", fold="fold", year=2, segment="segment", trees=5)
    assert back.count() == 200 and back.where("segment = 'b'").agg(F.corr("prob", "x")).first()[0] < -0.5


def test_importances_and_medians(spark, rows):
    found = {(r["segment"], r["feature"]): r["importance"] for r in models.importances(rows, features=["x", "noise"], target="target", segment="segment", trees=5).collect()}
    assert len(found) == 4 and found["a", "x"] > 0.8 and found["b", "x"] > 0.8
    imputer = models.assembler(["noise"])[0].fit(rows)
    median = rows.agg(F.percentile_approx("noise", 0.5, 100000)).first()[0]
    assert abs(imputer.surrogateDF.first()["noise"] - median) < 1e-9

import random

import numpy as np
import pytest

from tallyline.llm import toxicity
from tallyline.llm.queries import op2_toxicity


def corpus(n):
    rng = random.Random(7)
    plain = ["river", "stone", "cloud", "window", "garden", "letter", "silver", "market", "winter", "pathway", "lesson", "trasher"]
    bad = ["trash", "idiot", "moron"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(4, 60))]
        label = int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 4) if label else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), label))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, "l") for i, t, _ in rows], "doc_id bigint, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1), (99999, 1)], "doc_id bigint, toxic int")
    return docs, labels, toxicity.fit_toxicity(docs, labels), {i: y for i, _, y in rows}


def test_held_out_rows(spark, fitted):
    docs, _, model, truth = fitted
    scored = toxicity.score_toxicity(docs, model).withColumn("held", toxicity.held_out(toxicity.F.col("doc_id"))).collect()
    held = [r for r in scored if r["held"]]
    assert 0.15 < len(held) / len(scored) < 0.25
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scored)


def test_held_out_labels_change_nothing(spark, fitted):
    docs, labels, model, _ = fitted
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(labels.doc_id), 1 - labels.toxic).otherwise(labels.toxic))
    again = toxicity.fit_toxicity(docs, turned)
    assert (again.buckets == model.buckets).all() and np.allclose(again.weights, model.weights)


def test_edge_rows(spark, fitted):
    _, _, model, _ = fitted
    rows = [(1, None, 0.1), (2, "", 0.1), (None, "you idiot trash moron", 0.1), (3, "river " * 200000, 0.1), (3, "river " * 200000, 0.1), (4, "a", 0.1)]
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id bigint, text string, score double"), model).collect()
    assert len(got) == 6 and {r["doc_id"]: r["predicted"] for r in got} == {1: 0, 2: 0, None: 1, 3: 0, 4: 0}
    assert got[0]["score"] == got[1]["score"]
    assert toxicity.score_toxicity(spark.createDataFrame([], "doc_id bigint, text string"), model).count() == 0


def test_without_labels_of_both_classes(spark, fitted):
    docs, labels, _, _ = fitted
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs.limit(3), none).first()["score"] == 0.5
    clean = toxicity.fit_toxicity(docs, labels.where("toxic = 0"))
    assert toxicity.score_toxicity(docs.limit(3), clean).first()["score"] < 0.01
    assert toxicity.drop_toxic(docs, labels.where("toxic = 0")).count() == docs.count()


def test_query_on_given_tables(spark):
    got = op2_toxicity(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 200

"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Fit: from a bounded sample of labelled rows, count for hashed n-grams the toxic and other texts that hold them, keep the
FEATURES n-grams that tell the classes apart best, scale each presence by its log-count ratio and fit a logistic
regression on the scaled features with Spark ML. Score: one pass over all texts with the product of ratio and weight.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, carried, cut_lineage, hash_sample, kind_of, text_of

#: Labelled rows that the classifier is fitted on, at most: those with the smallest hash of their id.
TRAIN_ROWS = 16_000
#: Tasks that go over the sample; each gives a count for every bucket at most.
TRAIN_TASKS = 8
#: n-grams that become features, at most.
FEATURES = 8_192
#: An n-gram is a candidate only if so many training texts hold it.
LEAST_TEXTS = 4
LENGTHS = (4, 5, 6, 7)
BUCKET_BITS = 20
SMOOTHING = 1.0
PENALTY = 1e-4
#: Folds of the split that keeps a fifth of the rows out of the fit.
FOLDS = 5


def ngram_buckets(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the n-grams of a text, one array for each length; white space counts as one space."""
    points = np.frombuffer(f" {' '.join(text.split())} ".encode("utf-32-le"), dtype="<u4")
    h = np.zeros(len(points), dtype=np.uint32)
    for n in range(1, LENGTHS[-1] + 1):
        if n > len(points):
            return
        h = (h[: len(points) - n + 1] if n > 1 else h) * np.uint32(0x01000193) + points[n - 1 :]
        if n in LENGTHS:
            yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - BUCKET_BITS)


def present(text: str, chosen: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text, those marked in ``chosen`` only if it is given."""
    found = [b if chosen is None else b[chosen[b]] for b in ngram_buckets(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint32)


@dataclass
class ToxicityModel:
    """Buckets in use, their weights (log-count ratio x coefficient) and the intercept; of bounded size."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def scores(self, texts: Iterable[str]) -> list[float]:
        if not hasattr(self, "_tables"):  # made once where the model is used, never sent
            table = np.zeros(1 << BUCKET_BITS, dtype=np.float64)
            chosen = np.zeros(1 << BUCKET_BITS, dtype=bool)
            table[self.buckets], chosen[self.buckets] = self.weights, True
            self._tables = table, chosen
        table, chosen = self._tables
        sums = (self.intercept + table[present(text, chosen)].sum() for text in texts)
        return [float(1 / (1 + np.exp(-np.clip(s, -500, 500)))) for s in sums]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of the fit; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(label, text) of a bounded sample of labelled rows outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND label_id IS NOT NULL")
    known = known.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("label").alias("label"))
    sample = hash_sample(known, "label_id", known.count(), TRAIN_ROWS)
    texts = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"))
    found = texts.join(F.broadcast(sample), F.col("doc") == F.col("label_id")).select("label_id", "label", "text")
    # Read once: the fit goes over the sample twice, and the sample over all texts.
    return cut_lineage(found.repartition(TRAIN_TASKS, "label_id")).select("label", "text")


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fits on labelled rows outside the held-out fold; without rows of both classes the score is the base rate."""
    bound_batches(docs)
    texts = _training_texts(docs, labels, id_col, text_col, label_col)

    totals = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    zeros, ones = totals.get(0, 0), totals.get(1, 0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"], strict=True):
                counts[label][present(text)] += 1
        seen = np.flatnonzero(counts.sum(axis=0))
        yield pd.DataFrame({"bucket": seen, "zeros": counts[0][seen], "ones": counts[1][seen]})

    if not zeros or not ones:
        rate = (ones + 0.5) / (zeros + ones + 1)
        return ToxicityModel(np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log(rate / (1 - rate))))
    counts = texts.mapInPandas(count, "bucket long, zeros long, ones long").groupBy("bucket").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    gap = F.abs(F.col("ones") / F.lit(ones) - F.col("zeros") / F.lit(zeros))
    spread = F.sqrt((F.col("ones") + F.col("zeros") + 1) / F.lit(ones + zeros))
    best = counts.where(F.col("ones") + F.col("zeros") >= LEAST_TEXTS).orderBy((gap / spread).desc(), "bucket").limit(FEATURES).collect()
    buckets = np.array([r["bucket"] for r in best], dtype=np.int64)
    if not len(buckets):
        return ToxicityModel(buckets, np.zeros(0), float(np.log(ones / zeros)))
    p = np.array([r["ones"] for r in best]) + SMOOTHING
    q = np.array([r["zeros"] for r in best]) + SMOOTHING
    ratio = np.log((p / (ones + 2 * SMOOTHING)) / (q / (zeros + 2 * SMOOTHING)))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chosen = np.zeros(1 << BUCKET_BITS, dtype=bool)
        chosen[buckets] = True
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"].astype(float), "terms": [present(t, chosen).astype(str).tolist() for t in batch["text"]]})

    terms = texts.mapInPandas(features, "label double, terms array<string>")
    vectors = CountVectorizerModel.from_vocabulary([str(b) for b in buckets], inputCol="terms", outputCol="held", binary=True)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(ratio), inputCol="held", outputCol="features").transform(vectors.transform(terms)).select("label", "features").persist()
    # Scaled by the ratios already; standardising would undo that.
    fit = LogisticRegression(regParam=PENALTY, standardization=False, maxIter=60).fit(scaled)
    scaled.unpersist()
    return ToxicityModel(buckets, ratio * fit.coefficients.toArray(), float(fit.intercept))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1), predicted (1 from 0.5 on).

    Only the text enters a score; null counts as empty, and an empty text scores the intercept. Texts are read whole.
    Null ids and repeated rows each keep their row; other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """
    bound_batches(docs)
    rows = docs.select(carried(id_col).alias("doc"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["score"] = model.scores(batch.pop("text"))
            yield batch

    scored = rows.mapInPandas(run, "doc string, score double")
    return scored.select(F.col("doc").cast(kind_of(docs, id_col)).alias(id_col), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, all columns. Each text is scored in the row that holds it: null counts
    as empty, rows with a null id and repeated ones are judged by their text like others, and an empty table stays empty."""
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores("" if t is None else t for t in texts))

    return docs.where(score(F.col(text_col)) < 0.5)

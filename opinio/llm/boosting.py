"""Boosted trees with isotonic calibration over a table of features, by Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the uncalibrated probability in a score. Calibration makes steps; within one,
#: this keeps the order of the trees.
UNCALIBRATED = 0.001


@dataclass(frozen=True)
class Calibrated:
    """Trees with calibration, or only a ``rate`` where nothing could be learned."""

    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None
    rate: float

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``score`` from its ``features``, which it drops."""
        if self.trees is None:
            return df.drop("features").withColumn("score", F.lit(self.rate))
        ready = df.withColumn("features", array_to_vector("features"))
        raw = self.trees.transform(ready)
        raw = raw.withColumn("_raw", vector_to_array("probability")[1])
        out = self.steps.transform(raw) if self.steps else raw.withColumn("_step", F.col("_raw"))
        blend = (1 - UNCALIBRATED) * F.col("_step") + UNCALIBRATED * F.col("_raw")
        return out.select(*[c for c in df.columns if c != "features"], F.least(F.lit(1.0), blend).alias("score"))


def fit(rows: DataFrame, rounds: int = 20, depth: int = 3, seed: int = 7, parts: int | None = 4) -> Calibrated:
    """Fit from ``(features array<double>, label int, calibrate boolean)``.

    Trees learn from the rows that are not for calibration. Without rows of both classes
    the score is the share of ones, and zero without rows. ``parts`` None leaves rows where
    they lie.
    """
    rows = rows.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"), "calibrate")
    # Of a bounded sample a few partitions make its many short jobs short.
    rows = (rows.repartition(parts) if parts else rows).persist()
    counts = {(r["calibrate"], r["label"]): r["count"] for r in rows.groupBy("calibrate", "label").count().collect()}
    ones, zeros = counts.get((False, 1.0), 0), counts.get((False, 0.0), 0)
    if not ones or not zeros:
        total = sum(counts.values())
        rows.unpersist()
        return Calibrated(None, None, (sum(n for (_, y), n in counts.items() if y) / total) if total else 0.0)
    booster = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, seed=seed)
    trees = booster.fit(rows.filter("not calibrate"))
    steps = None
    if counts.get((True, 1.0)) and counts.get((True, 0.0)):
        held = trees.transform(rows.filter("calibrate")).withColumn("_raw", vector_to_array("probability")[1])
        steps = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_step").fit(held.select("_raw", "label"))
    rows.unpersist()
    return Calibrated(trees, steps, 0.0)

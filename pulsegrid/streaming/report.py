"""From windows to a report: any scorer, a threshold from the normal windows, the gate, and what it is worth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from .gate import Gate, wakes


def scored(windows: DataFrame, score: Callable[[Column], Column]) -> DataFrame:
    """windows (device_id, t, samples, ...) with the `score` that a function of their samples gives: an expression, or a pandas UDF around a model."""
    return windows.withColumn("score", score(F.col("samples")).cast("double")).drop("samples")


def report(scores: DataFrame, target: float = 0.95, **gate) -> DataFrame:
    """One row: the threshold (the target quantile of the scores of label 0), windows, wakes, and AUC, sensitivity and specificity at the threshold, for (device_id, t, score, label)."""
    threshold = metrics.calibration(scores, target).first()["threshold"]
    if threshold is None:
        raise ValueError("no normal window to calibrate with")
    woke = wakes(scores.select("device_id", "t", "score"), Gate(threshold, **gate)).agg(F.count("*").alias("wakes"))
    n = scores.agg(F.count("*").alias("windows"))
    one = n.join(F.broadcast(woke)).join(F.broadcast(metrics.roc(scores, threshold)))  # a row each
    return one.select(F.lit(threshold).alias("threshold"), "*")

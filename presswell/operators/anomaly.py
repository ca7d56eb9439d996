"""Anomaly scores of a weekly panel by z-scores against earlier weeks."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswell.config import ANOMALY_METRICS, ANOMALY_WINDOW
from presswell.operators.trends import ordered


def anomaly_scores(panel: DataFrame, metrics: list[str] = ANOMALY_METRICS, window: int = ANOMALY_WINDOW, series: list[str] | None = None) -> DataFrame:
    """``panel`` with anomaly_score: the greatest absolute z-score of the metrics.

    The baseline is the ``window`` rows before the week, all of them present;
    a metric whose baseline doesn't vary counts as unknown. Metrics that the
    panel lacks are skipped; without any the score is NULL.
    """
    frame = ordered(series).rowsBetween(-window, -1)
    scores = []
    for m in metrics:
        if m not in panel.columns:
            logging.getLogger(__name__).warning("no column %s in the panel", m)
            continue
        spread = F.stddev_samp(m).over(frame)
        z = (F.col(m) - F.avg(m).over(frame)) / spread
        scores.append(F.abs(F.when((F.count(m).over(frame) == window) & (spread > 0), z)))
    best = F.lit(None).cast("double") if not scores else scores[0] if len(scores) == 1 else F.greatest(*scores)
    return panel.withColumn("anomaly_score", best)

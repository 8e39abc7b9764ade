"""Answers as a stream: deliveries repeated within a delay are dropped, scores kept by trial and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(results: DataFrame, delay: str = "7 days", time_col: str = "loaded_at") -> DataFrame:
    """Stream of answers without repeated ``result_id`` within the watermark."""
    return results.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["result_id"])


def windowed_scores(results: DataFrame, width: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Right and all answers by trial and window of the time answered; answers later than the delay are not counted."""
    return (
        results.withWatermark("recorded_at", delay).groupBy(F.window("recorded_at", width), "trial_number")
        .agg(F.count_if(F.coalesce("correct", F.lit(False))).alias("n_correct"), F.count(F.lit(1)).alias("n_total"))
        .select("trial_number", F.col("window.start").alias("start"), "n_correct", "n_total")
    )

"""Naive benchmark of a panel: forecasts, alignment and scores in one Catalyst plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagmill.operators.panel import date_slice, is_bounded
from lagmill.operators.scoring import evaluate, naive_forecasts
from lagmill.plans.defaults import EVALUATION_START, REGIMES, SAMPLE_END


def naive_benchmark(panel: DataFrame, grain: str, start: str | None = EVALUATION_START, end: str | None = SAMPLE_END,
                    regimes: Mapping[str, tuple[str, str]] = REGIMES, layout: str = "tidy") -> DataFrame:
    """Scores of the naive forecasts inside [start, end]; history before ``start`` is not used."""
    return evaluate(naive_forecasts(date_slice(panel, start, end), grain), regimes, layout=layout)


def autoregression(panel: DataFrame, grain: str, warmup: int, value: str = "value") -> DataFrame:
    """One-lag least squares refitted on all earlier rows at each row, as running sums of one window.

    (series_id, ts, actual, forecast) from row ``warmup`` on, with the fit on rows before the forecast row only."""
    if not is_bounded(grain):
        raise ValueError("aggregate the panel to an hour or coarser first")
    w = W.partitionBy("series_id").orderBy("ts")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    rows = panel.withColumns({"_x": F.lag(value, 1).over(w), "_row": F.row_number().over(w)})
    slope, level = F.regr_slope(F.col(value), F.col("_x")), F.regr_intercept(F.col(value), F.col("_x"))
    fitted = rows.withColumn("forecast", level.over(before) + slope.over(before) * F.col("_x"))
    kept = fitted.where((F.col("_row") > warmup) & F.col("forecast").isNotNull() & F.col(value).isNotNull())
    return kept.select("series_id", "ts", F.col(value).alias("actual"), "forecast")

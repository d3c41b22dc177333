"""Naive forecasts and forecast scores, overall and per regime."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagmill.functions.columns import same_sign, within
from lagmill.operators.panel import SERIES, is_bounded, over_series, positioned, running_mean_before

FULL = "full"
METRICS = ("rmse", "mae", "hit_rate")
NAIVE_NAMES = {"zero": "Naive_Zero", "persistence": "Naive_Persistence", "mean": "Naive_RollingMean_12"}


def align(actual: DataFrame, forecast: DataFrame, keys: Sequence[str] = (*SERIES, "ts")) -> DataFrame:
    """Rows with an actual and a forecast on the same key; rows with a NULL on either side are left out."""
    return (
        actual.where(F.col("actual").isNotNull())
        .join(forecast.where(F.col("forecast").isNotNull()), list(keys), "inner")
    )


def naive_forecasts(panel: DataFrame, grain: str, value: str = "value") -> DataFrame:
    """Zero, previous-value and mean-of-all-earlier-values forecasts of each row, one row per model.

    All three come from the same partitioning of the panel; no join is needed to align them with the actual."""
    df = over_series(positioned(panel, grain), lambda w: {"_last": F.lag(value, 1).over(w)}, grain, back=1)
    df = running_mean_before(df, value, "_mean", grain)
    forecasts = F.array(
        F.struct(F.lit(NAIVE_NAMES["zero"]).alias("model"), F.lit(0.0).alias("forecast")),
        F.struct(F.lit(NAIVE_NAMES["persistence"]).alias("model"), F.col("_last").alias("forecast")),
        F.struct(F.lit(NAIVE_NAMES["mean"]).alias("model"), F.col("_mean").alias("forecast")))
    rows = df.select("series_id", "ts", F.col(value).alias("actual"), F.inline(forecasts))
    return rows.where(F.col("actual").isNotNull() & F.col("forecast").isNotNull())


def rolled_persistence(panel: DataFrame, grain: str, value: str = "value") -> DataFrame:
    """Previous value, where the first row of a series gets the last value of the series (wrap-around)."""
    if not is_bounded(grain):
        raise ValueError("the wrap-around reference needs a grain of an hour or coarser")
    w = W.partitionBy("series_id").orderBy("ts")
    last = F.last(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return panel.withColumn("forecast", F.when(F.row_number().over(w) == 1, last).otherwise(F.lag(value, 1).over(w)))


def metric_columns(actual: Column, forecast: Column, condition: Column | None = None) -> dict[str, Column]:
    """RMSE, MAE and hit rate over the rows where ``condition`` holds and both sides are present."""
    ok = actual.isNotNull() & forecast.isNotNull()
    ok = ok if condition is None else ok & condition
    error = F.when(ok, actual - forecast)
    return {
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "hit_rate": F.avg(F.when(ok, same_sign(actual, forecast))),
    }


def evaluate(forecasts: DataFrame, regimes: Mapping[str, tuple[str, str]], keys: Sequence[str] = (*SERIES, "model"),
             ts: str = "ts", actual: str = "actual", forecast: str = "forecast", layout: str = "tidy") -> DataFrame:
    """Scores per key over all rows and over each regime, by one conditional aggregation without copies of rows.

    ``layout='tidy'``: (keys, pos, scope, n, rmse, mae, hit_rate); ``'wide'``: one row per key with columns
    RMSE_full, MAE_full, HitRate_full, RMSE_<regime>, ... in this order. Empty regimes give NULL."""
    keys = list(keys)
    a, f = F.col(actual), F.col(forecast)
    scopes = {FULL: F.lit(True), **{name: within(F.col(ts), *ends) for name, ends in regimes.items()}}
    aggs, rows, wide = [], [], []
    for i, (scope, inside) in enumerate(scopes.items()):
        for m, column in metric_columns(a, f, inside).items():
            aggs.append(column.alias(f"{m}{i}"))
        aggs.append(F.count(F.when(inside & a.isNotNull() & f.isNotNull(), 1)).alias(f"n{i}"))
        rows.append(F.struct(
            F.lit(i).alias("pos"), F.lit(scope).alias("scope"), F.col(f"n{i}").alias("n"),
            *[F.col(f"{m}{i}").alias(m) for m in METRICS]))
        wide += [F.col(f"{m}{i}").alias(f"{label}_{scope}") for m, label in zip(METRICS, ("RMSE", "MAE", "HitRate"))]
    scored = forecasts.groupBy(*keys).agg(*aggs)
    if layout == "wide":
        return scored.select(*keys, *wide)
    return scored.select(*keys, F.inline(F.array(*rows)))


def shifted_naive_scores(panel: DataFrame, grain: str, regimes: Mapping[str, tuple[str, str]],
                         value: str = "value") -> DataFrame:
    """Scores of the wrap-around persistence in its original counting.

    Overall the first row is left out. Per regime RMSE and hit rate use all rows, while MAE leaves out the first row
    of the regime and divides by its row count minus one (NULL for a single row)."""
    rolled = rolled_persistence(panel, grain, value)
    w = W.partitionBy("series_id")
    scopes = {FULL: F.lit(True), **{name: within(F.col("ts"), *ends) for name, ends in regimes.items()}}
    firsts = {f"_first{i}": F.min(F.when(inside, F.col("ts"))).over(w) for i, inside in enumerate(scopes.values())}
    df, aggs, rows = rolled.withColumns(firsts), [], []
    a, f = F.col(value), F.col("forecast")
    for i, (scope, inside) in enumerate(scopes.items()):
        later = inside & (F.col("ts") > F.col(f"_first{i}"))
        metrics = metric_columns(a, f, later if scope == FULL else inside)
        aggs += [metrics["rmse"].alias(f"rmse{i}"), metric_columns(a, f, later)["mae"].alias(f"mae{i}"),
                 metrics["hit_rate"].alias(f"hit_rate{i}")]
        rows.append(F.struct(F.lit(scope).alias("scope"), *[F.col(f"{m}{i}").alias(m) for m in METRICS]))
    return df.groupBy("series_id").agg(*aggs).select("series_id", F.inline(F.array(*rows)))

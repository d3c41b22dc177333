"""Stationarity transforms by code, as window expressions over a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagmill.functions.columns import ratio, safe_ln
from lagmill.operators.panel import over_series, positioned

CODES = {
    1: "level",
    2: "first difference",
    3: "second difference",
    4: "log",
    5: "log difference",
    6: "second log difference",
    7: "difference of the growth rate",
}


def transform_column(code: int, x: Column, once: Column, twice: Column) -> Column:
    """Transform ``code`` from the value and its values one and two spans back."""
    if code == 1:
        return x
    if code == 2:
        return x - once
    if code == 3:
        return (x - once) - (once - twice)
    if code == 4:
        return safe_ln(x)
    if code == 5:
        return safe_ln(x) - safe_ln(once)
    if code == 6:
        return (safe_ln(x) - safe_ln(once)) - (safe_ln(once) - safe_ln(twice))
    if code == 7:
        return (ratio(x, once) - 1) - (ratio(once, twice) - 1)
    raise ValueError(f"unknown transform code {code}")


def transform(panel: DataFrame, grain: str, code: int | None = None, span: int = 1, value: str = "value") -> DataFrame:
    """Replace ``value`` by its transform. The code is the argument, or the ``tcode`` column of each row."""
    lags = {"_once": span, "_twice": 2 * span}
    df = over_series(
        positioned(panel, grain), lambda w: {c: F.lag(value, k).over(w) for c, k in lags.items()}, grain, back=2 * span,
    )
    args = F.col(value), F.col("_once"), F.col("_twice")
    if code is not None:
        result = transform_column(code, *args)
    else:
        result = F.when(F.col("tcode") == 1, transform_column(1, *args))
        for c in list(CODES)[1:]:
            result = result.when(F.col("tcode") == c, transform_column(c, *args))
        message = F.concat(F.lit("unknown transform code "), F.coalesce(F.col("tcode").cast("string"), F.lit("NULL")))
        result = result.otherwise(F.raise_error(message).cast("double"))
    return df.withColumn(value, result).drop("_once", "_twice")


def make_stationary(panel: DataFrame, dim_series: DataFrame, grain: str, span: int = 1) -> DataFrame:
    """Transform every series by its code, then drop the leading dates on which some series has no value yet.

    ``dim_series`` (series_id, tcode) is joined without a hint: its size follows the number of series, so the choice
    of join is left to adaptive execution. A series without a code is an error."""
    coded = panel.join(dim_series.select("series_id", "tcode"), "series_id", "left")
    return trim_incomplete_start(transform(coded, grain, span=span))


def trim_incomplete_start(panel: DataFrame) -> DataFrame:
    """Panel form of the leading-gap trim: a date is complete when every series has a value on it."""
    per_date = panel.groupBy("ts").agg(F.count("value").alias("_filled"))
    series = panel.agg(F.count_distinct("series_id").alias("_series"))
    first = (
        per_date.join(F.broadcast(series), F.col("_filled") == F.col("_series"))
        .agg(F.min("ts").alias("_first"))
    )
    kept = panel.join(F.broadcast(first), F.col("_first").isNull() | (F.col("ts") >= F.col("_first")))
    return kept.drop("_first")

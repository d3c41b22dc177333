"""Regimes kept as a table: an interval join of any number of ranges, which may overlap and differ by series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagmill.functions.columns import require_columns
from lagmill.operators.panel import SERIES
from lagmill.operators.scoring import metric_columns

BUCKET_DAYS = 32


def _bucket(moment: Column, days: int) -> Column:
    return F.floor(F.date_diff(moment.cast("date"), F.lit("1970-01-01").cast("date")) / F.lit(days))


def _ends(regimes: DataFrame) -> tuple[Column, Column]:
    """(last moment or day of a regime, whether ``ts`` lies before its end): a date counts as a whole day."""
    last = F.col("ends")
    if dict(regimes.dtypes)["ends"] == "date":
        return last, F.col("ts").cast("date") <= last
    return last, F.col("ts") <= last


def with_regimes(panel: DataFrame, regimes: DataFrame, keys: Sequence[str] = SERIES, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """Panel rows once for every regime that holds them, with its ``regime`` name; rows outside all regimes are left out.

    ``regimes`` has (keys..., regime, starts, ends); both ends are inclusive, days whole, and a NULL end is open. Regimes may
    overlap; one that ends before it starts holds nothing. With ``keys=()`` they hold for all series. Other columns of
    ``regimes`` are not read; a ``regime`` column of ``panel`` is replaced. Rows with a NULL ``ts`` or key meet no regime.

    Regimes are cut to the dates that the panel has and then into buckets of ``bucket_days``; both sides meet on (keys,
    bucket), and the exact range is checked afterwards. A regime has one piece per bucket and a row one bucket, so no pair
    is formed twice. A series with a large share of the rows is dealt out by bucket; what is left of it adaptive execution
    can split.
    """
    keys = list(keys)
    require_columns(panel, [*keys, "ts"], "panel")
    require_columns(regimes, [*keys, "regime", "starts", "ends"], "regimes")
    panel = panel.drop("regime")
    span = panel.groupBy(*keys).agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    listed = regimes.select(*keys, "regime", "starts", "ends")
    # Without keys the span is a single row.
    spanned = listed.join(span, keys) if keys else listed.join(F.broadcast(span))
    last, before_end = _ends(regimes)
    first = F.greatest(_bucket(F.col("starts"), bucket_days), _bucket(F.col("_from"), bucket_days))
    final = F.least(_bucket(last, bucket_days), _bucket(F.col("_to"), bucket_days))
    pieces = spanned.select(*keys, "regime", "starts", "ends", first.alias("_first"), final.alias("_final")).where("_first <= _final").select(
        *keys, "regime", "starts", "ends", F.explode(F.sequence("_first", "_final")).alias("_bucket"))
    inside = (F.col("starts").isNull() | (F.col("ts") >= F.col("starts"))) & (F.col("ends").isNull() | before_end)
    return (
        panel.withColumn("_bucket", _bucket(F.col("ts"), bucket_days)).join(pieces, [*keys, "_bucket"]).where(inside)
        .select(*panel.columns, "regime"))


def regime_table_stats(panel: DataFrame, regimes: DataFrame, keys: Sequence[str] = SERIES, value: str = "value",
                       regime_keys: Sequence[str] = SERIES, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """Count, mean and sample deviation per key and regime that holds rows."""
    x = F.col(value)
    return with_regimes(panel, regimes, regime_keys, bucket_days).groupBy(*keys, "regime").agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))


def evaluate_regime_table(forecasts: DataFrame, regimes: DataFrame, keys: Sequence[str] = (*SERIES, "model"),
                          regime_keys: Sequence[str] = SERIES, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """RMSE, MAE and hit rate per key and regime that holds rows; ``n`` counts rows with an actual and a forecast."""
    a, f = F.col("actual"), F.col("forecast")
    scores = [c.alias(name) for name, c in metric_columns(a, f).items()]
    return with_regimes(forecasts, regimes, regime_keys, bucket_days).groupBy(*keys, "regime").agg(
        F.count(F.when(a.isNotNull() & f.isNotNull(), 1)).alias("n"), *scores)

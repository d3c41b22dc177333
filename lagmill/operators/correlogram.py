"""Autocorrelation and partial autocorrelation of each series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lagmill.operators.panel import is_bounded, over_series, with_positions

LAGS = 40


def acf_arrays(panel: DataFrame, grain: str, lags: int = LAGS, value: str = "value") -> DataFrame:
    """(series_id, n, acf array of lags 0..lags). All lag products come from one window and one aggregation, so no row
    is copied per lag; missing values are left out first."""
    rows = panel.where(F.col(value).isNotNull())
    if not is_bounded(grain):
        rows = with_positions(rows, grain)
    means = rows.groupBy("series_id").agg(F.avg(value).alias("_mean"))
    centered = rows.join(means, "series_id").withColumn("_d", F.col(value) - F.col("_mean"))
    lagged = over_series(
        centered, lambda w: {f"_l{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)}, grain, back=lags)
    products = [F.sum(F.col("_d") * F.col("_d")).alias("_p0")]
    products += [F.coalesce(F.sum(F.col("_d") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_p{k}") for k in range(1, lags + 1)]
    sums = lagged.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), *products)
    total = F.nullif(F.col("_p0"), F.lit(0.0))
    return sums.select("series_id", "n", F.array(*[F.col(f"_p{k}") / total for k in range(lags + 1)]).alias("acf"))


def acf(panel: DataFrame, grain: str, lags: int = LAGS, value: str = "value") -> DataFrame:
    """(series_id, lag, acf, band): band is the half width of the 95% interval under no correlation beyond ``lag``."""
    arrays = acf_arrays(panel, grain, lags, value)
    rows = arrays.select("series_id", "n", "acf", F.posexplode("acf").alias("lag", "r"))
    inner = F.expr("aggregate(slice(acf, 2, greatest(lag - 1, 0)), 0D, (s, r) -> s + r * r)")
    band = F.when(F.col("lag") > 0, F.lit(1.959963984540054) * F.sqrt((1 + 2 * inner) / F.col("n")))
    return rows.select("series_id", "lag", F.col("r").alias("acf"), F.coalesce(band, F.lit(0.0)).alias("band"))


@pandas_udf(T.ArrayType(T.DoubleType()))
def _partial(acfs: pd.Series) -> pd.Series:
    """Durbin-Levinson recursion over a batch of series at once."""
    r = np.vstack(acfs.to_numpy()).astype(float)
    out = np.ones_like(r)
    phi = np.zeros((len(r), 0))
    for k in range(1, r.shape[1]):
        past = r[:, k - 1:0:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            last = (r[:, k] - (phi * past).sum(1)) / (1.0 - (phi * r[:, 1:k]).sum(1))
        phi = np.column_stack([phi - last[:, None] * phi[:, ::-1], last])
        out[:, k] = last
    return pd.Series(list(out))


def pacf(panel: DataFrame, grain: str, lags: int = LAGS, value: str = "value") -> DataFrame:
    """(series_id, lag, pacf), from the autocorrelations; the recursion sees one short array per series."""
    arrays = acf_arrays(panel, grain, lags, value).where(~F.exists("acf", lambda r: r.isNull()))
    return arrays.select("series_id", F.posexplode(_partial("acf")).alias("lag", "pacf"))
